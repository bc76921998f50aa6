"""Scalar functions over names, questions and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from . import query, views


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _first(column: str, classes, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, w)} THEN '{n}'" for n, w in classes.items()) + f" ELSE '{default}' END"


@query(f"SELECT doc_id, {_first('source', views.FIXTURE_PATTERNS, 'UNKNOWN')} AS regulation FROM documents")
def detect_regulation(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.detect_regulation(F.col("source"), views.FIXTURE_PATTERNS).alias("regulation"))


@query(f"WITH {views.CORPUS} SELECT doc_id, printf('%s_policy_%06d', source, doc_id) || '_' || printf('%04d', doc_id % 7) AS chunk_id FROM corpus")
def chunk_ids(spark, d):
    return views.corpus(spark, d).select("doc_id", T.chunk_id(F.col("paper_id"), F.col("doc_id") % 7).alias("chunk_id"))


@query(f"WITH {views.CORPUS} SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_type END, 'policy') AS doc_type, coalesce(CASE WHEN doc_id % 5 <> 0 THEN regulation END, 'UNKNOWN') AS regulation, coalesce(CASE WHEN doc_id % 4 = 0 THEN paper_id END, paper_id || ':' || doc_id) AS chunk_id FROM corpus")
def metadata_fill(spark, d):
    c, some = views.corpus(spark, d), lambda m, k, col: F.when(F.col("doc_id") % m == k, F.col(col))
    return c.select("doc_id", T.filled(some(3, 0, "doc_type"), "policy").alias("doc_type"), T.filled(F.when(F.col("doc_id") % 5 != 0, F.col("regulation")), "UNKNOWN").alias("regulation"), T.filled(some(4, 0, "paper_id"), F.concat_ws(":", "paper_id", F.col("doc_id").cast("string"))).alias("chunk_id"))


@query("SELECT doc_id, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any('text', w)} THEN '{n}' END" for n, w in views.FIXTURE_KEYWORDS.items()) + "], lambda x: x IS NOT NULL), ','), ''), 'UNKNOWN') AS jurisdictions FROM documents")
def keyword_jurisdictions(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.array_join(T.detect_jurisdictions(F.col("text"), keywords=views.FIXTURE_KEYWORDS), ",").alias("jurisdictions"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'GDPR,CCPA,HIPAA,NIST' WHEN turn % 3 = 1 THEN 'HIPAA,GDPR' ELSE 'NIST' END AS jurisdictions FROM conversations")
def normalized_jurisdictions(spark, d):
    t = views.table(spark, d, "conversations")
    given = F.when(F.col("turn") % 3 == 0, F.array(F.lit("all"))).when(F.col("turn") % 3 == 1, F.array(F.lit(" hipaa"), F.lit("gdpr"), F.lit("HIPAA"), F.lit("SOX"))).otherwise(F.array(F.lit("sox")))
    return t.select("conv_id", "turn", F.array_join(T.normalize_jurisdictions(given, F.array(F.lit("NIST"))), ",").alias("jurisdictions"))


_ROLE_TEXT = "replace(role || '_' || text, '_', ' ')"


@query(f"SELECT conv_id, turn, {_first(_ROLE_TEXT, vocab.OBLIGATION_KEYWORDS, 'other')} AS type FROM conversations")
def obligation_types(spark, d):
    t = views.table(spark, d, "conversations")
    return t.select("conv_id", "turn", T.obligation_type(F.concat_ws("_", "role", "text")).alias("type"))


@query("SELECT doc_id, coalesce('Article ' || nullif(regexp_extract('see art. ' || doc_id || '(2) and ' || source, '(?i)\\b(?:article|art\\.?)\\s*(\\d+[a-z]?(?:\\(\\d+\\))?)', 1), ''), '') AS article FROM documents")
def article_refs(spark, d):
    text = F.concat(F.lit("see art. "), F.col("doc_id").cast("string"), F.lit("(2) and "), F.col("source"))
    return views.table(spark, d, "documents").select("doc_id", T.article_reference(text).alias("article"))


@query(f"SELECT conv_id, turn, CASE WHEN {_any('text', vocab.COVERAGE_SIGNALS)} AND NOT {_any('text', vocab.AUDIT_WORDS)} THEN 'coverage' ELSE 'audit' END AS intent, {_any('text', vocab.CROSS_DOCUMENT_SIGNALS)} AS across, CASE WHEN {_any('text', vocab.FRESH_SIGNALS)} THEN 'fresh' ELSE 'internal' END AS recency FROM conversations")
def intent(spark, d):
    x = F.col("text")
    return views.table(spark, d, "conversations").select("conv_id", "turn", T.intent(x).alias("intent"), T.is_cross_document(x).alias("across"), T.needs_fresh(x).alias("recency"))


_RAW = "CASE event_id % 3 WHEN 0 THEN '[' || props || ', ' || props || ']' WHEN 1 THEN props ELSE '[]' END"


@query(f"WITH k AS (SELECT json_keys(props)[1] AS k FROM events ORDER BY event_id LIMIT 1), r AS (SELECT event_id, {_RAW} AS raw FROM events) SELECT event_id, CASE WHEN json_type(raw) = 'ARRAY' THEN 'list' ELSE 'object' END AS kind, CASE WHEN json_type(raw) = 'ARRAY' THEN json_array_length(raw) ELSE 0 END::INT AS n_items, json_extract_string(raw, '$.' || k) AS first_value, json_extract_string(raw, '$[1].' || k) AS second_item FROM r, k")
def model_output_parse(spark, d):
    """Lists, empty lists and objects in fences; objects in place of lists give no rows."""
    e = views.table(spark, d, "events")
    key = _first_key(e)
    raw = F.expr(_RAW)
    fenced = F.concat(F.lit("```json\n"), raw, F.lit("\n```"))
    items = T.parsed_list(fenced, f"struct<`{key}`:string>")
    kind = F.when(F.startswith(T.unfenced(fenced), F.lit("[")), "list").otherwise("object")
    return e.select("event_id", kind.alias("kind"), F.size(items).alias("n_items"), F.get_json_object(T.unfenced(fenced), f"$.{key}").alias("first_value"), F.get(items, F.lit(1))[key].alias("second_item"))


def _first_key(e) -> str:
    return e.orderBy("event_id").select(F.json_object_keys("props")[0]).head()[0]


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), s AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '') AS e, min(i) AS i FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s WHERE e <> ''), g AS (SELECT doc_id, string_agg(e, '|' ORDER BY i) AS entities FROM k WHERE r <= 15 GROUP BY doc_id) SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(entities, '') END AS entities FROM documents LEFT JOIN g USING (doc_id)""")
def entity_clean(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.array_join(T.clean_entities(F.split("text", " ")), "|").alias("entities"))


@query("SELECT l_orderkey, l_linenumber, round_even(greatest(0, least(100, 100 - l_quantity / 6 * 10)), 1) AS compliance, CASE WHEN round_even(greatest(0, least(100, 100 - l_quantity / 6 * 10)), 1) >= 85 THEN 'STRONG' WHEN round_even(greatest(0, least(100, 100 - l_quantity / 6 * 10)), 1) >= 65 THEN 'MODERATE' WHEN round_even(greatest(0, least(100, 100 - l_quantity / 6 * 10)), 1) >= 40 THEN 'WEAK' ELSE 'CRITICAL' END AS rating FROM lineitem")
def ratings(spark, d):
    c = T.risk_to_compliance(F.col("l_quantity") / 6)
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("compliance")).withColumn("rating", T.rating(F.col("compliance")))


def _sql_alias() -> str:
    h = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(name, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"
    return f"'privacy_policy_' || (abs({h} % 900) + 100) || '.pdf'"


@query(f"WITH {views.CORPUS}, n AS (SELECT doc_id, paper_id AS name FROM corpus) SELECT doc_id, {_sql_alias()} AS alias FROM n")
def anonymize_names(spark, d):
    return views.corpus(spark, d).select("doc_id", T.pseudonym(F.col("paper_id")).alias("alias"))


def _sql_pseudonyms(text: str) -> str:
    for real, alias in vocab.POLICY_ALIASES.items():
        loose = real.removesuffix(".pdf").replace("_", "[ _-]").replace("-privacy", "[ _-]privacy")
        text = f"regexp_replace({text}, '{real.replace('.', '[.]')}', '{alias}', 'gi')"
        text = f"regexp_replace({text}, '{loose}', '{alias.removesuffix('.pdf')}', 'gi')"
    for name, alias in vocab.COMPANY_NAMES.items():
        text = f"regexp_replace({text}, '{name}', '{alias}', 'gi')"
    return text


_NAMED = "coalesce(text, '') || ' Google zoom_privacy_policy.pdf, uber privacy-policy and META'"


@query(f"SELECT doc_id, {_sql_pseudonyms(_NAMED)} AS text FROM documents")
def anonymize_texts(spark, d):
    named = F.concat(F.coalesce("text", F.lit("")), F.lit(" Google zoom_privacy_policy.pdf, uber privacy-policy and META"))
    return views.table(spark, d, "documents").select("doc_id", T.pseudonymize(named).alias("text"))


_LABEL = "trim(regexp_replace(regexp_replace(raw, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH r AS (SELECT doc_id, concat_ws('_', source, text) AS raw FROM documents), l AS (SELECT doc_id, {_LABEL} AS label FROM r)
SELECT doc_id, CASE WHEN label = '' THEN 'Compliance Evidence' WHEN length(regexp_replace(label, '(?i)[^a-f0-9]', '', 'g')) >= 12 THEN 'Policy Evidence' WHEN contains(lower(label), 'gdpr') THEN 'GDPR Requirement' WHEN contains(lower(label), 'hipaa') THEN 'HIPAA Requirement' WHEN contains(lower(label), 'ccpa') THEN 'CCPA Requirement' WHEN contains(lower(label), 'nist') THEN 'NIST Control'
  WHEN contains(lower(label), 'gap') OR contains(lower(label), 'missing') THEN 'Compliance Gap' WHEN contains(lower(label), 'recommend') THEN 'Recommended Fix' WHEN length(label) > 46 THEN substr(label, 1, 43) || '...' ELSE label END AS label FROM l""")
def graph_labels(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.clean_label(F.concat_ws("_", "source", "text")).alias("label"))


@query("SELECT n_name AS node, CASE WHEN contains(lower(n_name), 'risk') OR contains(lower(n_name), 'gap') THEN 'risk' WHEN ends_with(lower(n_name), '.pdf') OR contains(lower(n_name), 'policy') THEN 'policy' ELSE 'evidence' END AS category FROM nation UNION ALL SELECT DISTINCT source || '_policy.pdf', 'policy' FROM documents")
def node_categories(spark, d):
    names = views.table(spark, d, "nation").select(F.col("n_name").alias("node")).unionAll(views.table(spark, d, "documents").select(F.concat("source", F.lit("_policy.pdf"))).distinct())
    return names.select("node", T.node_category(F.col("node")).alias("category"))


@query("""SELECT n_name AS src, r_name AS dst, 'conflicts with' || CASE WHEN n_nationkey % 2 = 0 THEN ' (' || n_nationkey || ' days vs 72 hours)' ELSE '' END AS relation,
  CASE WHEN n_nationkey % 2 = 0 THEN '- **' || n_name || '** requires ' || n_nationkey || ' days, while **' || r_name || '** requires 72 hours.' ELSE '- **' || n_name || '** vs **' || r_name || '**' END || ' note' AS note, '(' || n_name || ') --[CONFLICTS_WITH]--> (' || r_name || ')  [GDPR]' AS triple FROM nation JOIN region ON n_regionkey = r_regionkey""")
def conflict_notes(spark, d):
    n, r = views.table(spark, d, "nation"), views.table(spark, d, "region")
    a = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.col("n_nationkey").cast("string"), F.lit(" days")))
    src, dst, b = F.col("n_name"), F.col("r_name"), F.lit("72 hours")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(src.alias("src"), dst.alias("dst"), T.relation_label(F.lit(None).cast("string"), a, b).alias("relation"), T.conflict_note(src, dst, a, b, F.lit("note")).alias("note"), T.triple_text(src, F.lit("CONFLICTS_WITH"), dst, F.lit("GDPR")).alias("triple"))


@query("SELECT vec_id, CASE WHEN e >= 0 THEN 1 / (1 + e) END AS grade, coalesce(1 / (1 + e) >= 0.3, false) AS sufficient, coalesce(try_cast(trim(label::VARCHAR) AS INT), 0) AS answer, coalesce(try_cast(trim(label::VARCHAR) AS INT), 0) >= 3 AS answer_ok FROM (SELECT vec_id, label, abs(embedding[1])::DOUBLE * 30 AS e FROM embeddings)")
def grades(spark, d):
    g, a = T.retrieval_grade(F.abs(F.col("embedding")[0]).cast("double") * 30), T.answer_grade(F.concat(F.lit(" "), F.col("label").cast("string"), F.lit("\n")))
    return views.table(spark, d, "embeddings").select("vec_id", g["grade"].alias("grade"), g["sufficient"].alias("sufficient"), a["grade"].alias("answer"), a["sufficient"].alias("answer_ok"))
