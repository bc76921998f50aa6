"""SQL for the queries of this subpackage that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from . import chat_format, quality_rules, url_filter

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) AS (SELECT x, y FROM link UNION SELECT a, y FROM reach JOIN link ON b = x),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = doc_id
"""

_HOST = _LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
_K = url_filter.ORDER


def _rules(pick: int) -> str:
    out = "CASE"
    for rule in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        site, slash, prefix = rule[0].partition("/")
        out += f" WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{slash}{prefix}') THEN '{rule[pick]}'"
    return out + " END"


_COLUMNS = ["r", *(f"a{f}" for f in range(url_filter.FOLDS))]


def _levels() -> str:
    out = []
    each = lambda form: ", ".join(form.format(x=x) for x in _COLUMNS)
    for k in range(_K + 1):
        below = each(f"1.0 / {url_filter.ALPHABET} AS l_{{x}}") if k == 0 else each("low.p_{x} AS l_{x}")
        joined = "" if k == 0 else f" JOIN m{k - 1} low ON low.g = substr(l.g, 2)"
        out.append(f"""
l{k} AS (SELECT substr(g, {_K + 1 - k}) AS g, {each("sum({x}) AS {x}")} FROM counts GROUP BY 1),
c{k} AS (SELECT substr(g, 1, {k}) AS h, {each("sum({x}) AS n_{x}, count(*) FILTER ({x} > 0) AS t_{x}")} FROM l{k} GROUP BY 1),
m{k} AS (SELECT g, {each("CASE WHEN n_{x} > 0 THEN ({x} + t_{x} * l_{x}) / (n_{x} + t_{x}) ELSE l_{x} END AS p_{x}")}
  FROM (SELECT l.g, {each("l.{x}, c.n_{x}, c.t_{x}")}, {below} FROM l{k} l JOIN c{k} c ON c.h = substr(l.g, 1, {k}){joined}))""")
    return ",".join(out)


OP3 = rf"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
u AS (SELECT DISTINCT url, {_LOWER.format("regexp_extract(url, '(?s)^.*?://(.*)$', 1)")} AS t, regexp_matches(host, 'adult|bets|casino|pills|spam') AS bad,
  ('0x' || substr(md5(host), 1, 7))::BIGINT % {url_filter.FOLDS} AS fold FROM p WHERE contains(url, '://')),
g AS (SELECT url, bad, fold, unnest(list_transform(range(1, length(t) + 1), lambda i: substr(repeat(chr(2), {_K}) || t, i, {_K + 1}))) AS g FROM u),
counts AS (SELECT g, (count(*) FILTER (bad))::DOUBLE AS r, {", ".join(f"(count(*) FILTER (NOT bad AND fold <> {f}))::DOUBLE AS a{f}" for f in range(url_filter.FOLDS))} FROM g GROUP BY g),
{_levels()},
scores AS (SELECT url, bad, coalesce(avg(CASE fold {" ".join(f"WHEN {f} THEN ln(p_a{f}) - ln(p_r)" for f in range(url_filter.FOLDS))} END), 0) AS score FROM u LEFT JOIN g USING (url, bad, fold) LEFT JOIN m{_K} USING (g) GROUP BY url, bad),
b AS (SELECT floor(score * 1000) AS b, count(*) FILTER (NOT bad) AS a, count(*) FILTER (bad) AS r FROM scores GROUP BY 1),
f AS (SELECT b, sum(a) OVER (ORDER BY b) AS upto, sum(a) OVER () AS every_a, sum(r) OVER () AS every_r FROM b),
cut AS (SELECT least(0, min(b) FILTER (upto > every_a::DOUBLE * {url_filter.FALSE_BLOCKS}::DOUBLE) / 1000) AS t FROM f WHERE every_a > 0 AND every_r > 0)
SELECT page_id, host, path, {_rules(0)} AS rule, coalesce({_rules(1)}, CASE WHEN score < (SELECT t FROM cut) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN scores USING (url)
"""

_CONTROL = "[<\\[]\\\\*(?:" + "|".join("".join(f"[{c}]" if c in "|[]" else c for c in x[1:]) for x in chat_format.CONTROL).replace("[[]", "\\[").replace("[]]", "\\]").replace("[|]", "\\|") + ")"
OP4 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, {len(chat_format.OPEN + chat_format.CLOSE) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars FROM c),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
  count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(sum(chars) FILTER (ahead = 0), 0))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT x, y FROM link UNION SELECT a, y FROM reach JOIN link ON b = x),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT x, count(*) AS c FROM link GROUP BY x)
SELECT vec_id, coalesce(c, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN low ON a = vec_id LEFT JOIN n ON x = vec_id
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([1.0, 2.0, 3.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS every, sum(w) OVER () AS all_w FROM s),
b AS (SELECT *, row_number() OVER q AS pos, (every - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (all_w - coalesce(sum(w) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM o WINDOW q AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, pos) FROM b WHERE cap >= level * w) * w), cap) AS target FROM b),
e AS (SELECT d.doc_id, d.source, d.size, source_size, target, least(3.0, target / nullif(source_size, 0)) AS f, u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(coalesce(f, 0))::BIGINT AS whole, f - floor(f) AS part FROM e),
k AS (SELECT *, sum(size) OVER (PARTITION BY source, part > 0 ORDER BY u / (1 - u), doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 <= target - sum(whole * size) OVER (PARTITION BY source) AS fits FROM r)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN part > 0 AND fits THEN 1 ELSE 0 END) * size AS taken FROM k
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_dot_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5
"""

_G = quality_rules.GAMMA
_SMALL = quality_rules.SMALLEST


def _op9() -> str:
    rate = lambda n, d: f"CASE WHEN {d} > 0 THEN greatest(0::DOUBLE, {n}::DOUBLE - {quality_rules.NOISE}::DOUBLE * sqrt({n}::DOUBLE)) / {d}::DOUBLE ELSE 0 END"
    metric = {"symbol_ratio": rate("n_symbols", "word_chars"), "dup_line_ratio": rate("n_dup_lines", "n_lines"), "repeat_ratio": rate("n_repeat_words", "n_words")}
    level = "CASE metric " + " ".join(f"WHEN '{m}' THEN {q}::DOUBLE" for m, q in quality_rules.LEVELS.items()) + " END"
    value = lambda q: f"min(CASE WHEN upto >= every::DOUBLE * {q} THEN bucket END)"
    point = lambda b: f"CASE WHEN {b} <= 0 THEN 0.0 ELSE {_SMALL}::DOUBLE * pow({_G!r}::DOUBLE, {b} - 1) * {2 * _G / (1 + _G)!r}::DOUBLE END"
    fits = " AND ".join(f"coalesce({m} <= max_{m}, true)" for m in metric)

    def limits(name: str, keys: str, up: str = "") -> str:
        both = f"{keys}, " if keys else ""
        mine = f"""{name}_o AS (SELECT {both}metric, n, hi + {quality_rules.SPREAD}::DOUBLE * (hi - mid) AS lim FROM (SELECT {both}metric, max(every) AS n, {point(value(level))} AS hi, {point(value("0.5::DOUBLE"))} AS mid
  FROM (SELECT *, sum(n) OVER (PARTITION BY {both}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {both}metric) AS every FROM (SELECT {both}metric, bucket, sum(n) AS n FROM bk GROUP BY ALL)) GROUP BY {both}metric))"""
        lean = f"(o.lim * o.n + u.lim * {quality_rules.WEIGHT}) / (o.n + {quality_rules.WEIGHT})"
        shared = " AND o.lang IS NOT DISTINCT FROM u.lang" if up == "lim_l" else ""
        last = f"SELECT {both.replace('lang', 'o.lang')}o.metric, {lean} AS lim FROM {name}_o o JOIN {up} u ON o.metric = u.metric{shared}" if up else f"SELECT metric, lim FROM {name}_o"
        return f"{mine},\n{name} AS ({last})"

    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], chr(32)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
st AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
x AS (SELECT *, {", ".join(f"{e} AS {m}" for m, e in metric.items())}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM st),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM x WHERE NOT base_failed" for m in metric)}),
bk AS (SELECT lang, source, metric, CASE WHEN v <= {_SMALL} THEN 0 ELSE ceil(ln(v / {_SMALL}::DOUBLE) / ln({_G!r}::DOUBLE)) END AS bucket, count(*) AS n FROM long GROUP BY ALL),
{limits("lim_a", "")},
{limits("lim_l", "lang", "lim_a")},
{limits("lim", "lang, source", "lim_l")},
wide AS (SELECT lang, source, {", ".join(f"max(lim) FILTER (metric = '{m}') AS max_{m}" for m in metric)} FROM lim GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fits} AS kept
FROM x LEFT JOIN wide ON x.lang IS NOT DISTINCT FROM wide.lang AND x.source IS NOT DISTINCT FROM wide.source
"""


ORACLES = {"op1_jaccard_join": OP1, "op3_url_filter": OP3, "op4_chat_format": OP4, "op7_embedding_dedup": OP7, "op8_source_mix": OP8, "op9_quality_rules": _op9(), "op11_hard_negatives": OP11}
