"""Plain versions of the operators, one document or pair at a time."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(links, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard(docs):
    """{id: (set size, component)} of {id: text}."""
    s = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and 4 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b])]
    c = components(links, ids)
    return {i: (len(s[i]), c[i]) for i in ids}


def statistics(text):
    t = text or ""
    w = WORD.findall(t)
    runs = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)
