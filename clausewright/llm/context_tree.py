"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, and each decision (after some bits of the byte) has its
own tree of contexts: the ``DEPTH`` bytes before, nearest first (Willems, Shtarkov and
Tjalkens, 1995). A node estimates a bit by Krichevsky-Trofimov counts; its weighted
probability is the mean of its own and of the product of its children's, so all depths are
mixed, each by how well it coded the training texts. Contexts that training never met
inherit from the next shorter one. A text is coded after and up to an end symbol, so the
probabilities of all texts sum to one; the score is its log10, and ``bits_per_byte`` the
code length per byte, the end counted.

Only distinct grams (context and byte, one integer) travel:

* Tasks cut texts into pieces and deal these into blocks of at most ``BLOCK`` bytes. A block
  sends its distinct grams with their training counts, packed by lot. A lot holds whole
  subtrees: the contexts that share the two nearest bytes, or three where two are hot.
  There are ``LOTS`` lots for each shuffle partition, which has to grow with the corpus.
* A lot merges the counts of all blocks, computes its subtrees from the leaves up, and
  sends what their roots pass on. The nodes above all subtrees, at most
  ``256 * (1 + 256 + HOT)`` rows, are finished on the driver and broadcast.
* Lots answer each block with the log probabilities of its grams, in order; the block,
  met with its own texts again, adds them up. Parts of long texts are summed at the end.

So a task holds one block, or the distinct grams of one lot, whatever a key's share of
the corpus. The counts are over all training texts, exact, and grow with them. The words of
the unigram base travel the same way, as hashes of 63 bits: two of w different words share
one with a chance of about w^2 / 2^64.

Defined results: a null or empty text is the end symbol alone, one token. Rows whose id is
null count as training. Repeated rows each count and are each scored. Very long texts and
words are read in pieces. Without training texts every bit costs one bit and the base is 0.
Ties do not arise. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import shuffle_partitions, written
from .textnum import lower, mix, text_bytes, word_hashes, word_spans

DEPTH = 5
BLOCK, PIECE, SLICE = 32 << 20, 1 << 20, 1 << 20
EDGE = 0xFF
END = 1
HOT = 200
LOTS = 4
_BITS = 8 * DEPTH
_CODEC = pa.Codec("zstd", 1)
_TABLE = 1 << 16
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE) - 0.5))]) + lgamma(0.5)
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE)))])


# --- Estimates and weights


def _log_gamma(table: np.ndarray, k: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(k, _TABLE - 1)]
    big = np.flatnonzero(k >= _TABLE)
    if len(big):
        z = k[big] + more
        out[big] = (z - 0.5) * np.log(z) - z + 0.5 * log(2 * pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(_HALF, zeros, 0.5) + _log_gamma(_HALF, ones, 0.5) - _log_gamma(_WHOLE, zeros + ones, 1.0) - log(pi)


def nodes(key: np.ndarray, n: np.ndarray, j: int, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of bit j in the contexts of sorted ``key`` (context, byte), seen ``n`` times.

    ``below`` has the children's log probabilities, at one row of each child's node; None
    at the deepest level. For every row: whether its node was seen, its estimate of the
    row's bit, its share against its children, and its weighted log probability, which
    stands at the node's first row only.
    """
    node, bit = key >> (8 - j), (key >> (7 - j)) & 1
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    total, ones = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
    own = log_estimate(total - ones, ones)
    if below is None:
        weighted, share = own, np.ones(len(first))
    else:
        weighted = np.logaddexp(own, np.add.reduceat(below, first)) - log(2)
        share = np.exp(own - log(2) - weighted)
    at = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(key)]])))
    up = np.zeros(len(key))
    up[first] = weighted
    return total[at] > 0, (np.where(bit, ones[at], (total - ones)[at]) + 0.5) / (total[at] + 1), share[at], up


def _parents(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the next shorter contexts, sorted, and the place of each row's parent."""
    return np.unique((key >> 16 << 8) | (key & 255), return_inverse=True)


@dataclass
class Subtree:
    """The contexts below and at ``root`` bytes, from distinct sorted grams with training counts; absent ones have 0."""

    key: np.ndarray
    n: np.ndarray
    root: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        key, n = self.key, self.n
        for depth in range(DEPTH, self.root - 1, -1):
            shorter, at = _parents(key) if depth > self.root else (key[:0], key[:0])
            self.levels.append((key, n, at))
            if depth > self.root:
                key, n = shorter, np.bincount(at, weights=n, minlength=len(shorter)).astype(np.int64)

    def bit(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """What bit j of the root's rows passes up, and for each gram the predicted probability of its bit; NaN where no context was seen."""
        below, value, where = None, None, np.arange(len(self.key))
        for key, n, at in self.levels:
            seen, own, share, up = nodes(key, n, j, below)
            own, share, seen = own[where], share[where], seen[where]
            value = np.where(seen, own, np.nan) if value is None else np.where(np.isnan(value), np.where(seen, own, np.nan), share * own + (1 - share) * value)
            if len(at):
                below = np.bincount(at, weights=up, minlength=at.max() + 1)
                where = at[where]
        return up, value


@dataclass
class Top:
    """The nodes above the shards: per (context, byte) and bit, what a predicted probability p of a shard becomes: a + b p, or f where it has none."""

    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    f: np.ndarray

    def mixed(self, parent: np.ndarray, byte: np.ndarray, j: int, p: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, (parent << 8) | byte)
        return np.where(np.isnan(p), self.f[at, j], self.a[at, j] + self.b[at, j] * p)


def top_of(context: np.ndarray, byte: np.ndarray, n: np.ndarray, up: np.ndarray) -> Top:
    """From the sums of what shards pass up, by parent context (one byte, or 256 + two bytes) and byte."""
    two = context >= 256
    key2, n2, up2 = ((context[two] - 256) << 8) | byte[two], n[two], up[two]
    order = np.argsort(key2)
    key2, n2, up2 = key2[order], n2[order], up2[order]
    to1, at2 = _parents(key2)
    key1 = np.unique(np.concatenate([(context[~two] << 8) | byte[~two], to1]))
    own1, via1 = np.searchsorted(key1, (context[~two] << 8) | byte[~two]), np.searchsorted(key1, to1)[at2]
    add = lambda at, x, size: np.bincount(at, weights=x, minlength=size)
    n1 = (add(own1, n[~two], len(key1)) + add(via1, n2, len(key1))).astype(np.int64)
    key0, at1 = _parents(key1)
    n0 = add(at1, n1, len(key0)).astype(np.int64)
    a, b, f = (np.empty((len(key1) + len(key2), 8)) for _ in range(3))
    for j in range(8):
        levels = []
        if len(key2):
            levels.append(nodes(key2, n2, j, up2[:, j]))
        passed = add(own1, up[~two][:, j], len(key1)) + (add(via1, levels[0][3], len(key1)) if len(key2) else 0)
        one = nodes(key1, n1, j, passed)
        seen, own, share, _ = nodes(key0, n0, j, add(at1, one[3], len(key0)))
        f0 = np.where(seen, own, 0.5)
        a0, b0 = np.where(seen, share * own, 0.5), np.where(seen, 1 - share, 0.0)

        def longer(level, at, a, b, f):
            seen, own, share, _ = level
            a, b, f = a[at], b[at], f[at]
            return np.where(seen, a + b * share * own, f), np.where(seen, b * (1 - share), 0.0), np.where(seen, a + b * own, f)

        first = longer(one, at1, a0, b0, f0)
        second = longer(levels[0], via1, *first) if len(key2) else [np.empty(0)] * 3
        for out, x, y in zip((a, b, f), first, second, strict=True):
            out[:, j] = np.concatenate([x, y])
    return Top(np.concatenate([key1, key2 + (256 << 8)]), a, b, f)


# --- Pieces, grams and words


def grams(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each place the bytes before it, nearest first, and its own, as one integer."""
    out = np.zeros(high - low, np.int64)
    for back in range(1, DEPTH + 1):
        out = (out << 8) | data[low - back : high - back]
    return (out << 8) | data[low:high]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    if len(parts) > 1:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    if len(key) == 0:
        return key, n
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def distinct(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys, and how many of each are of training texts."""
    if len(key) == 0:
        return key, key
    both = np.sort(key.astype(np.uint64) << np.uint64(1) | train.astype(np.uint64))
    key = (both >> np.uint64(1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat((both & np.uint64(1)).astype(np.int64), first)


def looked_up(key: np.ndarray, value: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked gram, which is among the sorted ``key``; asked for in order, some at a time, which is kinder to caches."""
    out, some = np.empty(len(asked)), 1 << 16
    for i in range(0, len(asked), some):
        part = asked[i : i + some].astype(np.uint64)
        both = np.sort(part << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
        gram = (both >> np.uint64(16)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        out[i + (both & np.uint64(0xFFFF)).astype(np.int64)] = np.repeat(value[np.searchsorted(key, gram[first])], np.diff(first, append=len(gram)))
    return out


class Tally:
    """Distinct keys and training counts, merged whenever what waits has outgrown what is merged."""

    def __init__(self) -> None:
        self.parts, self.size, self.base = [], 0, 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.size += len(key)
        if self.size > 2 * self.base + (1 << 18):
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1 or self.size != self.base:
            self.parts = [merged(self.parts)]
            self.size = self.base = len(self.parts[0][0])
        return self.parts[0]


@dataclass
class Pieces:
    """Some pieces side by side: their bytes, with the context before each and the end after a last one."""

    before: list[bytes]
    data: list[np.ndarray]
    last: list[bool]

    def __post_init__(self) -> None:
        self.plain = np.concatenate([*self.data, np.zeros(0, np.uint8)])
        self.at = np.concatenate([[0], np.cumsum([len(d) for d in self.data])]).astype(np.int64)
        end = np.array([EDGE], np.uint8)
        self.all = np.concatenate([x for b, d, z in zip(self.before, self.data, self.last, strict=True) for x in (np.frombuffer(b, np.uint8), d, end[: int(z)])])
        self.length = np.array([len(d) + z for d, z in zip(self.data, self.last, strict=True)], np.int64)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Grams and the index of their piece, about ``SLICE`` at a time."""
        owner = np.repeat(np.arange(len(self.length)), self.length + DEPTH)
        start = np.cumsum(self.length + DEPTH) - self.length
        real = np.arange(len(self.all)) >= start[owner]
        for low in range(DEPTH, len(self.all), SLICE):
            high = min(low + SLICE, len(self.all))
            yield grams(self.all, low, high)[real[low:high]], owner[low:high][real[low:high]]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens, ends included, and the index of their piece."""
        starts, ends, first = word_spans(self.plain, self.at)
        hashes = (word_hashes(self.plain, starts, ends, False) >> np.uint64(1)).astype(np.int64)
        over = np.flatnonzero(self.last)
        return np.concatenate([hashes, np.full(len(over), END)]), np.concatenate([np.repeat(np.arange(len(self.data)), np.diff(first)), over])


def cut_text(text: np.ndarray, most: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, bool]]:
    """Pieces of about ``most`` bytes that end before white space, each with the bytes before it; a longer word stays whole."""
    space, low = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D)), 0
    while True:
        high = low + most
        if high >= len(text):
            high = len(text)
        else:
            rest = np.flatnonzero(space[high : high + most])
            while len(rest) == 0 and high < len(text):
                high = min(high + most, len(text))
                rest = np.flatnonzero(space[high : high + most])
            high += int(rest[0]) if len(rest) else 0
        before = text[max(0, low - DEPTH) : low].tobytes()
        yield bytes([EDGE]) * (DEPTH - len(before)) + before, text[low:high], high == len(text)
        if high == len(text):
            return
        low = high


def packed(x: np.ndarray) -> bytes:
    """Integers, sorted or small, as compressed differences."""
    raw = np.diff(x, prepend=np.int64(0)).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    raw = _CODEC.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int64))


def _cuts(label: np.ndarray) -> list[tuple[int, int]]:
    edge = [0, *(1 + np.flatnonzero(label[1:] != label[:-1])).tolist(), len(label)]
    return [(i, j) for i, j in zip(edge[:-1], edge[1:], strict=True) if i < j]


#: What a row of keys is: words, subtrees of two bytes, subtrees of three; and the sizes of the subtrees of a block.
WORDS, TWO, THREE, SIZES = 0, 2, 3, 9


def places(key: np.ndarray, kind: int, lots: int) -> np.ndarray:
    """The lot of each key; grams of one subtree are in one lot."""
    subtree = key if kind == WORDS else key >> (_BITS - 8 * (kind - 1))
    return (mix(subtree.astype(np.uint64) + np.uint64(kind)) % np.uint64(lots)).astype(np.int64)


def dealt(key: np.ndarray, lots: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted grams their first lot, kind and last lot: those of hot subtrees are dealt again by three bytes."""
    first = places(key, TWO, lots)
    again = np.isin(key >> (_BITS - 8), hot)
    return first, np.where(again, THREE, TWO), np.where(again, places(key, THREE, lots), first)


_TEXTS = "block long, uid long, id long, held boolean, piece long, before binary, data binary, last boolean, kind int, lot int, key binary, n binary"


def _arrow(kinds: str) -> pa.Schema:
    of = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, of[kind]) for name, kind in (c.split() for c in kinds.split(", "))])


def _by_lot(key: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    order = np.argsort(place, kind="stable")
    key, n, place = key[order], n[order], place[order]
    for i, j in _cuts(place):
        yield int(place[i]), packed(key[i:j]), packed(n[i:j])


def _blocks(lots: int, most: int, piece: int):
    """Pieces as rows, and the distinct grams and words of each block by lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), _arrow(_TEXTS)
        row = block = in_block = waiting = 0
        tallies, pending, train, rows = (Tally(), Tally()), ([], [], []), [], []

        def count() -> None:
            nonlocal waiting
            if not train:
                return
            pieces, flags = Pieces(*pending), np.array(train)
            for key, owner in pieces.grams():
                tallies[0].add(*distinct(key, flags[owner]))
            words, owner = pieces.words()
            tallies[1].add(*distinct(words, flags[owner]))
            for x in (*pending, train):
                x.clear()
            waiting = 0

        def closed() -> None:
            nonlocal tallies, block, in_block
            count()
            if in_block:
                name = (part << 32) | block
                (key, n), (word, times) = tallies[0].result(), tallies[1].result()
                subtree = key >> (_BITS - 8)
                edge = np.array([i for i, _ in _cuts(subtree)])
                rows.append({"block": name, "kind": SIZES, "key": packed(subtree[edge]), "n": packed(np.diff(edge, append=len(key)))})
                for kind, k, c in ((TWO, key, n), (WORDS, word, times)):
                    rows.extend({"block": name, "kind": kind, "lot": lot, "key": x, "n": y} for lot, x, y in _by_lot(k, c, places(k, kind, lots)))
                tallies, block, in_block = (Tally(), Tally()), block + 1, 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []

        for b in batches:
            data, at = text_bytes(b.column("text"))
            ids, held = b.column("id").to_pylist(), b.column("held").to_pylist()
            for i in range(b.num_rows):
                uid, row = (part << 40) | row, row + 1
                for number, (before, text, last) in enumerate(cut_text(lower(data[at[i] : at[i + 1]]), piece)):
                    rows.append({"block": (part << 32) | block, "uid": uid, "id": ids[i], "held": held[i], "piece": number, "before": before, "data": text.tobytes(), "last": last})
                    for x, y in zip(pending, (before, text, last), strict=True):
                        x.append(y)
                    train.append(not held[i])
                    waiting, in_block = waiting + len(text) + 1, in_block + len(text) + 1
                    if in_block >= most:
                        closed()
                    elif waiting >= SLICE:
                        count()
                    if waiting == 0:
                        yield from sent()
        closed()
        yield from sent()

    return run


# --- Lots


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each subtree of two bytes how many grams the blocks send."""
    tally = Tally()
    for b in batches:
        for key, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True):
            tally.add(unpacked(key), unpacked(n))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.result()], ["subtree", "size"])


_ASKED = "block long, kind int, lot int, first int, key binary, n binary"


def _dealt_again(lots: int, hot: np.ndarray):
    """Grams of hot subtrees get their kind and lot by three bytes; ``first`` is the lot they had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = set(places(hot << (_BITS - 8), TWO, lots).tolist())
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["kind"] == WORDS or r["lot"] not in mine:
                    rows.append(r | {"first": r["lot"]})
                    continue
                key, n = unpacked(r["key"]), unpacked(r["n"])
                first, kind, lot = dealt(key, lots, hot)
                for k in (TWO, THREE):
                    own = kind == k
                    rows += [{"block": r["block"], "kind": k, "lot": place, "first": r["lot"], "key": x, "n": y} for place, x, y in _by_lot(key[own], n[own], lot[own])]
            yield pa.RecordBatch.from_pylist(rows, _arrow(_ASKED))

    return run


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


_MERGED = "kind int, lot int, key binary, n binary, parent int, byte int, count long, " + ", ".join(f"v{j} double" for j in range(8)) + ", tokens long, types long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per lot and kind its merged counts, and what its roots pass up; for words the sums of the base."""
    schema, at, tally = _arrow(_MERGED), None, Tally()

    def closed() -> Iterator[pa.RecordBatch]:
        (kind, lot), (key, n) = at, tally.result()
        rows = [{"kind": kind, "lot": lot, "key": packed(key[i : i + (1 << 20)]), "n": packed(n[i : i + (1 << 20)])} for i in range(0, len(key), 1 << 20)]
        if kind == WORDS:
            rows.append({"tokens": int(n.sum()), "types": int((n > 0).sum())})
        yield pa.RecordBatch.from_pylist(rows, schema)
        if kind != WORDS:
            tree = Subtree(key, n, kind)
            own, count, _ = tree.levels[-1]
            above = (own >> 16) + (256 if kind == THREE else 0)
            columns = {"parent": above, "byte": own & 255, "count": count} | {f"v{j}": tree.bit(j)[0] for j in range(8)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(len(own), f.type) for f in schema], schema=schema)

    for r in _rows(batches):
        if (r["kind"], r["lot"]) != at:
            if at is not None:
                yield from closed()
            at, tally = (r["kind"], r["lot"]), Tally()
        tally.add(unpacked(r["key"]), unpacked(r["n"]))
    if at is not None:
        yield from closed()


_ANSWER = "block long, kind int, lot int, first int, answer binary"


def _answered(top):
    """Per lot and kind, sorted so that its counts come first: the answers to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, parts, key, value, rows = _arrow(_ANSWER), None, [], None, None, []
        for r in _rows(batches):
            if (r["kind"], r["lot"]) != at:
                at, parts, key = (r["kind"], r["lot"]), [], None
            if not r["asks"]:
                parts.append((unpacked(r["key"]), unpacked(r["n"])))
                continue
            if key is None:
                (key, n), parts, kind = merged(parts), [], r["kind"]
                if kind == WORDS:
                    value = n.astype(np.float64)
                else:
                    tree, value = Subtree(key, n, kind), np.zeros(len(key))
                    above = (key >> (_BITS + 16 - 8 * kind)) + (256 if kind == THREE else 0)
                    for j in range(8):
                        value += np.log10(top.value.mixed(above, key & 255, j, tree.bit(j)[1]))
            rows.append({c: r[c] for c in ("block", "kind", "lot", "first")} | {"answer": value[np.searchsorted(key, unpacked(r["key"]))].tobytes()})
            if len(rows) >= 64:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


# --- Scores

_PART = "uid long, id long, held boolean, n_bytes long, n_tokens long, n_known long, base double, score double"


def _scored(tokens: int, types: int, lots: int, hot: np.ndarray):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.sort_by([("uid", "ascending"), ("piece", "ascending")])
        before, last = texts.column("before").to_pylist(), texts.column("last").to_pylist()
        data = [np.frombuffer(x.as_buffer(), np.uint8) for x in texts.column("data")]
        edge = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
        runs, i = [], 0
        while i < len(data):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + SLICE, "right")) - 1)
            runs.append((i, j))
            i = j
        each = lambda: ((i, j, Pieces(before[i:j], data[i:j], last[i:j])) for i, j in runs)
        seen = (Tally(), Tally())
        for i, j, pieces in each():
            for key, _ in pieces.grams():
                seen[0].add(*distinct(key, np.zeros(len(key), bool)))
            words, _ = pieces.words()
            seen[1].add(*distinct(words, np.zeros(len(words), bool)))

        (key, _), (word, _) = seen[0].result(), seen[1].result()
        told = answers.sort_by([("kind", "ascending"), ("first", "ascending"), ("lot", "ascending")])

        def in_order(kinds: tuple[int, ...], order: np.ndarray) -> np.ndarray:
            """The answers, dealt back to the places of the sorted keys."""
            own = told.filter(pa.compute.is_in(told.column("kind"), pa.array(kinds, pa.int32())))
            out = np.empty(len(order))
            out[order] = np.frombuffer(b"".join(own.column("answer").to_pylist()))
            return out

        first, kind, lot = dealt(key, lots, hot)
        value = in_order((TWO, THREE), np.lexsort((lot, first, kind)))
        count = in_order((WORDS,), np.argsort(places(word, WORDS, lots), kind="stable"))
        out = np.zeros((4, len(data)))
        cost = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
        for i, j, pieces in each():
            for k, owner in pieces.grams():
                out[3, i:j] += np.bincount(owner, weights=looked_up(key, value, k), minlength=j - i)
            w, owner = pieces.words()
            at = np.searchsorted(word, w)
            out[0, i:j] += np.bincount(owner, minlength=j - i)
            out[1, i:j] += np.bincount(owner, weights=count[at] > 0, minlength=j - i)
            out[2, i:j] += np.bincount(owner, weights=cost[at], minlength=j - i)
        kept = texts.select(["uid", "id", "held"])
        return pa.table([*kept.columns, pa.array(np.diff(edge) - 1), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array(out[3])], schema=_arrow(_PART))

    return run


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row; rows where ``held`` is true are not learnt from. A block has about ``block`` bytes, and no result depends on it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    lots = LOTS * shuffle_partitions(spark)
    blocks = written(rows.mapInArrow(_blocks(lots, block, piece), _TEXTS))
    every = blocks.where(F.col("kind") == SIZES).select("key", "n").mapInArrow(_sizes, "subtree long, size long").groupBy("subtree").agg(F.sum("size").alias("size"))
    total = every.agg(F.sum("size")).head()[0] or 0
    hot = np.array(sorted(r[0] for r in every.where(F.col("size") * HOT > total).select("subtree").collect()), np.int64)
    asked = blocks.where(F.col("kind") < SIZES).select("block", "kind", "lot", "key", "n").mapInArrow(_dealt_again(lots, hot), _ASKED)
    order = lambda df, *by: df.repartition("lot").sortWithinPartitions("lot", "kind", *by)
    known = written(order(asked).select("kind", "lot", "key", "n").mapInArrow(_counted, _MERGED))
    sums = known.agg(F.sum("tokens"), F.sum("types")).head()
    above = known.where("parent is not null").groupBy("parent", "byte").agg(F.sum("count").alias("count"), *(F.sum(f"v{j}").alias(f"v{j}") for j in range(8))).collect()
    cells = np.array([tuple(r) for r in above], np.float64).reshape(len(above), 11)
    whole = np.array([r["count"] for r in above], np.int64)
    top = spark.sparkContext.broadcast(top_of(cells[:, 0].astype(np.int64), cells[:, 1].astype(np.int64), whole, cells[:, 3:]) if above else None)
    none = lambda kind: F.lit(None).cast(kind)
    both = known.where("lot is not null").select("kind", "lot", F.lit(False).alias("asks"), none("long").alias("block"), none("int").alias("first"), "key", "n").unionAll(asked.select("kind", "lot", F.lit(True), "block", "first", "key", none("binary")))
    answers = order(both, "asks").mapInArrow(_answered(top), _ANSWER)
    texts = blocks.where("kind is null").select("block", "uid", "id", "held", "piece", "before", "data", "last")
    parts = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(sums[0] or 0, sums[1] or 0, lots, hot), _PART)
    found = parts.groupBy("uid", "id", "held").agg(*(F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base", "score")))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return found.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(sums[0] or 0).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", bits.alias("bits_per_byte"))
