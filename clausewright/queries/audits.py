"""Obligations, gaps, scores, groups, coverage and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import audit
from . import query, views

_SCORE = "CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 7.5 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 2.5 ELSE 5.0 END::DOUBLE"
_WEIGHT = "CASE regulation WHEN 'GDPR' THEN 0.35 WHEN 'HIPAA' THEN 0.30 WHEN 'CCPA' THEN 0.20 WHEN 'NIST' THEN 0.15 ELSE 0.1 END::DOUBLE"
_COMPLIANCE = "round_even(greatest(0, least(100, 100 - raw * 10)), 1)"


def _risk(gaps: str = "gaps") -> str:
    return f"""oc AS (SELECT document, regulation, count(*) AS n_obligations FROM obligations GROUP BY ALL), gw AS (SELECT document, regulation, sum({_SCORE}) AS w, count(*) AS n_gaps FROM {gaps} GROUP BY ALL),
rr AS (SELECT document, regulation, n_obligations, coalesce(n_gaps, 0) AS n_gaps, least(coalesce(w, 0) / (n_obligations * 10.0) * 10.0, 10.0)::DOUBLE AS raw FROM oc LEFT JOIN gw USING (document, regulation)),
risks AS (SELECT document, regulation, n_obligations, n_gaps, round_even(raw, 2) AS risk, {_COMPLIANCE} AS compliance FROM rr),
dr AS (SELECT document, sum({_WEIGHT} * risk) / sum({_WEIGHT}) AS raw FROM risks GROUP BY document),
docs AS (SELECT document, round_even(raw, 2) AS risk, {_COMPLIANCE} AS compliance FROM dr)"""


def _rating(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'NO DATA' WHEN {c} >= 85 THEN 'STRONG' WHEN {c} >= 65 THEN 'MODERATE' WHEN {c} >= 40 THEN 'WEAK' ELSE 'CRITICAL' END"


_THEMES = ", ".join(f"'{t}'" for t in vocab.GAP_THEMES)
_LABELS = " ".join("WHEN '{}' THEN '{}'".format(t, n.replace("'", "''")) for t, n in vocab.GAP_THEMES.items())
_SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
_GROUPS = f"""gt AS (SELECT document, CASE WHEN theme IN ({_THEMES}) THEN theme ELSE 'other' END AS theme, {_SEV} AS r, obligation_id, severity, regulation FROM gaps),
gg AS (SELECT document, theme, min(r) AS worst, count(*) AS n_gaps, list(regulation ORDER BY r, obligation_id, severity, regulation) AS regs, list(obligation_id ORDER BY r, obligation_id, severity, regulation) AS ids FROM gt GROUP BY ALL),
groups AS (SELECT document, theme, CASE theme {_LABELS} END AS label, list_extract(['critical', 'high', 'medium', 'low', 'info', 'unknown'], worst + 1) AS severity, n_gaps,
  array_to_string(list_transform(list_filter(list_zip(regs, range(1, len(regs) + 1)), lambda z: list_position(regs, z[1]) = z[2]), lambda z: z[1]), ', ') AS regulations, ids[1] AS first_obligation, row_number() OVER (PARTITION BY document ORDER BY worst, list_position([{_THEMES}], theme)) AS position FROM gg)"""


def _risks(spark, d):
    return audit.regulation_risk(views.obligations(spark, d), views.gaps(spark, d))


def _groups(spark, d):
    return audit.gap_groups(views.gaps(spark, d))


@query(f"WITH {views.OBLIGATIONS} SELECT document, regulation, count(*) AS n_obligations FROM obligations GROUP BY ALL")
def obligation_counts(spark, d):
    return audit.obligation_counts(views.obligations(spark, d))


@query(f"WITH {views.GAPS}, {_risk()} SELECT document, regulation, n_obligations, n_gaps, risk, compliance FROM risks")
def reg_risk(spark, d):
    return _risks(spark, d).drop("raw")


@query(f"WITH {views.GAPS}, {_risk()} SELECT document, risk, compliance, {_rating('compliance')} AS rating FROM docs")
def doc_risk(spark, d):
    return audit.document_risk(_risks(spark, d))


@query(f"WITH {views.GAPS}, {_risk()} SELECT regulation, round_even(avg(compliance), 1) AS compliance, count(*) AS documents FROM risks GROUP BY regulation UNION ALL SELECT 'OVERALL', round_even(avg(compliance), 1), count(*) FROM docs")
def audit_scores(spark, d):
    r = _risks(spark, d)
    return audit.audit_scores(r, audit.document_risk(r))


@query(f"WITH {views.GAPS}, {_GROUPS} SELECT document, theme, label, severity, n_gaps, regulations, first_obligation, position::INT AS position FROM groups")
def gap_groups(spark, d):
    return _groups(spark, d).select("document", "theme", "label", "severity", "n_gaps", F.array_join("regulations", ", ").alias("regulations"), F.col("gaps")[0]["key"].alias("first_obligation"), "position")


@query(f"WITH {views.GAPS}, {_GROUPS} SELECT document, theme, severity, position::INT AS position FROM groups WHERE position <= 3")
def top_groups(spark, d):
    return audit.top_groups(_groups(spark, d)).select("document", "theme", "severity", "position")


@query(f"WITH {views.GAPS} SELECT document, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low, count(*) AS n_gaps, bool_or(severity = 'critical') AS any_critical, arg_min(severity, {_SEV}) AS worst FROM gaps GROUP BY document")
def severity_counts(spark, d):
    return audit.document_tally(views.gaps(spark, d))


@query(f"WITH {views.GAPS} SELECT regulation, count(*) AS n_gaps FROM gaps GROUP BY regulation")
def gaps_by_regulation(spark, d):
    return audit.gaps_per_regulation(views.gaps(spark, d))


_NOTE = "CASE WHEN n_chunks = 0 THEN 'No relevant content found in the indexed policy text.' WHEN n_gaps = 0 THEN 'Fully addresses this requirement — no gaps identified.' WHEN n_critical > 0 THEN 'Has relevant language but with **' || n_critical || ' critical** gap' || CASE WHEN n_critical > 1 THEN 's' ELSE '' END || CASE WHEN n_high > 0 THEN ' and ' || n_high || ' high' ELSE '' END || ' — coverage is incomplete.' WHEN n_high > 0 THEN 'Partially addresses this requirement — **' || n_high || ' high-severity** gap' || CASE WHEN n_high > 1 THEN 's' ELSE '' END || ' identified.' ELSE 'Covers this topic with ' || n_gaps || ' minor gap' || CASE WHEN n_gaps = 1 THEN '' ELSE 's' END || '.' END"
_COVERAGE = f"""cv AS (SELECT document, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, coalesce(n_gaps, 0) AS n_gaps FROM (SELECT DISTINCT document FROM obligations)
  LEFT JOIN (SELECT document, count(*) AS n_chunks FROM obligations WHERE document NOT LIKE '%7' GROUP BY document) USING (document) LEFT JOIN (SELECT document, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) AS n_gaps FROM gaps GROUP BY document) USING (document)),
cov AS (SELECT document, n_chunks > 0 AS has_content, n_critical, n_high, n_gaps, {_NOTE} AS note FROM cv)"""


def _coverage(spark, d):
    o = views.obligations(spark, d)
    return audit.coverage(o, o.where("document not like '%7'"), views.gaps(spark, d))


@query(f"WITH {views.GAPS}, {_COVERAGE} SELECT * FROM cov")
def coverage_matrix(spark, d):
    return _coverage(spark, d)


@query(f"WITH {views.GAPS}, {_COVERAGE}, {_GROUPS}, m AS (SELECT document, string_agg(label || ' (' || regulations || ')', '; ' ORDER BY position) AS missing FROM groups WHERE position <= 2 GROUP BY document) SELECT document, has_content, concat_ws(' ', '**' || document || '** —', note, 'Missing: ' || missing) AS line FROM cov LEFT JOIN m USING (document)")
def coverage_report(spark, d):
    return audit.coverage_report(_coverage(spark, d), _groups(spark, d))


@query(f"WITH {views.GAPS}, left_gaps AS (SELECT * FROM gaps WHERE theme NOT IN ('data_retention', 'consent_mechanisms')), {_risk('left_gaps')} SELECT document, risk, compliance, {_rating('compliance')} AS rating FROM docs")
def what_if(spark, d):
    resolved = spark.createDataFrame([("data_retention",), ("consent_mechanisms",)], "theme string")
    return audit.document_risk(audit.regulation_risk(views.obligations(spark, d), audit.without_themes(views.gaps(spark, d), resolved)))


_CRITICAL = ", ".join(f"'{t}'" for t in vocab.CRITICAL_TYPES)


@query(f"WITH {views.OBLIGATIONS} SELECT document, id AS obligation_id, regulation, 'high' AS severity, type AS ob_type FROM obligations WHERE document LIKE '%3' AND type IN ({_CRITICAL})")
def fallback_gaps(spark, d):
    o = views.obligations(spark, d)
    return audit.fallback_gaps(o, o.where("document like '%3'")).select("document", "obligation_id", "regulation", "severity", "ob_type")


@query(f"WITH {views.GAPS} SELECT g.document, obligation_id, line, type AS ob_type, CASE WHEN theme IN ({_THEMES}) THEN theme ELSE 'other' END AS theme FROM gaps g JOIN obligations o ON o.document = g.document AND o.id = obligation_id")
def typed_gaps(spark, d):
    return audit.typed_gaps(views.gaps(spark, d), views.obligations(spark, d)).select("document", "obligation_id", "line", "ob_type", "theme")


@query(f"WITH {views.GAPS}, {_GROUPS} SELECT document, theme, CASE WHEN theme = 'other' THEN '' ELSE 'fix ' || label END AS recommendation FROM groups")
def remediation_join(spark, d):
    g = _groups(spark, d)
    r = g.where("theme <> 'other'").select("document", "theme", F.concat(F.lit("fix "), "label").alias("recommendation"))
    return audit.with_remediation(g, r).select("document", "theme", "recommendation")


@query(f"WITH {views.GAPS}, {_risk()}, j AS (SELECT unnest(['GDPR', 'CCPA', 'HIPAA', 'NIST']) AS regulation) SELECT d.document, j.regulation, CASE WHEN r.risk IS NULL THEN j.regulation || ': no data' ELSE j.regulation || ': ' || printf('%.1f', r.risk) || '/10 — ' || CASE j.regulation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.PENALTY_CAPS.items()) + " END END AS line FROM docs d CROSS JOIN j LEFT JOIN risks r ON r.document = d.document AND r.regulation = j.regulation")
def exposure(spark, d):
    j = spark.createDataFrame([(r,) for r in ("GDPR", "CCPA", "HIPAA", "NIST")], "regulation string")
    return audit.exposure(_risks(spark, d), j)


@query(f"WITH {views.GAPS}, {_risk()}, j AS (SELECT unnest(['GDPR', 'CCPA', 'HIPAA', 'NIST']) AS regulation) SELECT d.document, j.regulation, CASE WHEN r.compliance IS NULL THEN 'N/A' ELSE round_even(r.compliance, 0)::INT || '/100' END AS compliance, {_rating('r.compliance')} AS rating FROM docs d CROSS JOIN j LEFT JOIN risks r ON r.document = d.document AND r.regulation = j.regulation")
def report_rows(spark, d):
    r = _risks(spark, d)
    return audit.report_rows(r, audit.document_risk(r), ["GDPR", "CCPA", "HIPAA", "NIST"])


_J = "(SELECT unnest(['GDPR', 'CCPA', 'HIPAA', 'NIST']) AS regulation, unnest([1, 2, 3, 4]) AS o)"


@query(f"""WITH {views.GAPS}, {_risk()}, {_GROUPS}, t AS (SELECT d.document, string_agg('| ' || j.regulation || ' | ' || CASE WHEN r.compliance IS NULL THEN 'N/A' ELSE round_even(r.compliance, 0)::INT || '/100' END || ' | ' || {_rating('r.compliance')} || ' |', chr(10) ORDER BY o) AS t FROM docs d CROSS JOIN {_J} j LEFT JOIN risks r ON r.document = d.document AND r.regulation = j.regulation GROUP BY d.document),
f AS (SELECT document, string_agg('- **' || label || '** _(' || regulations || ' · ' || upper(severity) || ')_ ' || n_gaps, chr(10) ORDER BY position) FILTER (position <= 3) AS f, count(*) FILTER (position > 3) AS more FROM groups GROUP BY document)
SELECT document, concat_ws(chr(10), '### ' || document || ' — ' || compliance || '/100 ' || {_rating('compliance')}, t, coalesce(f, 'No compliance gaps identified for the queried scope.'), CASE WHEN more > 0 THEN 'Show ' || more || ' more finding(s)' END) AS report FROM docs JOIN t USING (document) LEFT JOIN f USING (document)""")
def reports(spark, d):
    r = _risks(spark, d)
    return audit.reports(r, audit.document_risk(r), _groups(spark, d), ["GDPR", "CCPA", "HIPAA", "NIST"])


@query(f"WITH {views.OBLIGATIONS}, t AS (SELECT DISTINCT c_nationkey AS audit_id, 'policy_' || (c_custkey % 50) AS document FROM customer) SELECT audit_id, document, id, type FROM obligations JOIN t USING (document)")
def audit_obligations(spark, d):
    """An audit per nation, whose targets are the documents of its customers."""
    t = views.table(spark, d, "customer").select(F.col("c_nationkey").alias("audit_id"), F.concat(F.lit("policy_"), F.col("c_custkey") % 50).alias("document"))
    return audit.of_targets(views.obligations(spark, d), t).select("audit_id", "document", "id", "type")


@query(f"WITH {views.GAPS}, {_GROUPS}, n AS (SELECT document, string_agg(regulation || '=' || c, ',' ORDER BY regulation) AS counts FROM (SELECT document, regulation, count(*) AS c FROM obligations GROUP BY ALL) GROUP BY document), l AS (SELECT document, md5(string_agg(severity || obligation_id || regulation || theme, ',' ORDER BY {_SEV}, obligation_id, severity, regulation, theme)) AS gaps FROM gaps GROUP BY document), c AS (SELECT document, count(*) AS n_conflicts FROM (SELECT DISTINCT document, regulation FROM obligations WHERE regulation <> 'CCPA') GROUP BY document) SELECT document, counts, count(theme) AS n_groups, min(theme) FILTER (position = 1) AS first_theme, any_value(gaps) AS gaps, coalesce(any_value(n_conflicts), 0) AS n_conflicts FROM n LEFT JOIN groups USING (document) LEFT JOIN l USING (document) LEFT JOIN c USING (document) GROUP BY document, counts")
def results(spark, d):
    o = views.obligations(spark, d)
    c = o.where("regulation <> 'CCPA'").select("document", F.col("regulation").alias("src"), F.lit("CONFLICTS_WITH").alias("rel"), F.lit("CCPA").alias("dst"), F.lit("differs").alias("description")).distinct()
    out = audit.results(_groups(spark, d), audit.obligation_counts(o), _risks(spark, d), views.gaps(spark, d), c)
    pairs = F.transform(F.array_sort(F.map_entries("obligation_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    lines = F.transform("gaps", lambda g: F.concat(g["severity"], g["obligation_id"].cast("string"), g["regulation"], g["theme"]))
    return out.select("document", F.array_join(pairs, ",").alias("counts"), F.coalesce(F.size("gap_groups"), F.lit(0)).cast("long").alias("n_groups"), F.get("gap_groups", F.lit(0))["theme"].alias("first_theme"), F.md5(F.array_join(lines, ",")).alias("gaps"), F.when(F.col("conflicts").isNull(), 0).otherwise(F.size("conflicts")).cast("long").alias("n_conflicts"))


@query(f"WITH {views.GAPS} SELECT document, obligation_id, line, CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 7.0 WHEN 'medium' THEN 4.0 ELSE 1.0 END::DOUBLE AS weight, rpad(upper(severity), 9, ' ') || rpad(regulation, 7, ' ') || obligation_id AS text FROM gaps")
def gap_summary(spark, d):
    return audit.gap_summary(views.gaps(spark, d).withColumnRenamed("line", "no")).select("document", "obligation_id", F.col("no").alias("line"), "weight", F.col("line").alias("text"))


@query("""WITH x AS (SELECT conv_id, turn, regexp_replace(concat_ws(' ', role, 'states', text), '^\\s+|\\s+$', '', 'g') AS text FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS rn FROM x WHERE length(text) >= 15)
SELECT conv_id AS document, printf('OBL-%04d', turn) AS id, 'GDPR' AS regulation FROM f WHERE rn = 1""")
def obligations(spark, d):
    t = views.table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("pos"), F.col("role").alias("source"), F.lit("states").alias("relation"), F.col("text").alias("target"), F.lit("").alias("regulation"))
    return audit.obligations_from(t.unionAll(t), F.array(F.lit("GDPR"), F.lit("NIST"))).select("document", "id", "regulation")


@query("SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 1")
def scoped_conflicts(spark, d):
    n, r = views.table(spark, d, "nation"), views.table(spark, d, "region")
    mark = F.when(F.col("n_nationkey") % 3 == 0, " GDPR").when(F.col("n_nationkey") % 3 == 1, " NIST").otherwise("")
    c = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", mark).alias("src"), F.col("r_name").alias("dst"), "n_name")
    return audit.scoped_conflicts(c, ["GDPR", "HIPAA"]).select(F.col("n_name").alias("src"), "dst")
