"""Run history, trends, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, relational
from . import query, views


@query(f"WITH {views.RUNS} SELECT run_id, policy_name, compliance_score FROM runs ORDER BY start_time DESC, run_id LIMIT 50")
def history(spark, d):
    return audit.history(views.runs(spark, d)).select("run_id", "policy_name", "compliance_score")


@query(f"WITH {views.RUNS}, p AS (SELECT min(policy_name) AS p FROM runs), h AS (SELECT * FROM runs WHERE policy_name = (SELECT p FROM p) ORDER BY start_time DESC, run_id LIMIT 50) SELECT run_id, policy_name, compliance_score FROM h")
def trends(spark, d):
    r = views.runs(spark, d)
    first = r.agg(F.min("policy_name")).head()[0]
    return audit.trends(r, policy=first).select("run_id", "policy_name", "compliance_score")


@query(f"WITH {views.RUNS} SELECT run_id, policy_name, CASE WHEN run_id % 3 = 0 THEN 'local' ELSE 'server' END AS side FROM runs")
def history_merge(spark, d):
    r = views.runs(spark, d).select("run_id", "policy_name")
    local = r.where("run_id % 3 = 0").withColumn("side", F.lit("local"))
    return relational.merged_history(local, r.withColumn("side", F.lit("server")), ["run_id"])


@query(f"WITH {views.RUNS} SELECT run_id, 'compliance_score' AS metric, compliance_score AS value FROM runs WHERE compliance_score IS NOT NULL UNION ALL SELECT run_id, 'risk', 10 - compliance_score / 10 FROM runs WHERE compliance_score IS NOT NULL")
def run_metrics(spark, d):
    r = views.runs(spark, d).withColumn("risk", 10 - F.col("compliance_score") / 10)
    return audit.run_metrics(r.select("run_id", "compliance_score", "risk"), "run_id", ["compliance_score", "risk"])


@query(f"WITH {views.RUNS} SELECT run_id, coalesce(CASE WHEN run_id % 4 <> 0 THEN compliance_score END, 0.5) AS score FROM runs")
def first_values(spark, d):
    a = F.when(F.col("run_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("compliance_score"))
    return views.runs(spark, d).select("run_id", T.first_of(a, F.lit(0.5)).alias("score"))


@query(f"WITH {views.RUNS} SELECT run_id, CASE run_id % 3 WHEN 0 THEN '?' WHEN 1 THEN 'GDPR, ' || event_type ELSE event_type || ', NIST' END AS frameworks FROM runs")
def framework_labels(spark, d):
    k, e = F.col("run_id") % 3, F.col("event_type")
    r = views.runs(spark, d).select("run_id", F.when(k == 1, F.array(F.lit("GDPR"))).alias("jurisdictions"), F.when(k > 0, F.array(e)).alias("gap_regulations"), F.when(k == 2, F.concat(e, F.lit(" , NIST,"))).alias("jurisdiction_text"))
    return audit.frameworks(r)


@query(f"WITH {views.RUNS} SELECT run_id FROM runs WHERE run_id % 2 = 0 AND run_id % 5 <> 0")
def loggable_runs(spark, d):
    r = views.runs(spark, d).select("run_id", F.when(F.col("run_id") % 2 == 0, F.array(F.lit("GDPR"))).otherwise(F.array().cast("array<string>")).alias("jurisdictions"), F.when(F.col("run_id") % 5 == 0, "which one?").alias("clarification"))
    return audit.loggable(r).select("run_id")


@query(f"""WITH {views.RUNS}, g AS (SELECT e.event_id AS run_id, count(l_orderkey) AS n, count(*) FILTER (l_quantity > 45) AS c, count(*) FILTER (l_quantity > 30 AND l_quantity <= 45) AS h, count(*) FILTER (l_quantity > 15 AND l_quantity <= 30) AS m, count(*) FILTER (l_quantity <= 15) AS l FROM events e LEFT JOIN lineitem ON l_orderkey = event_id GROUP BY ALL)
SELECT run_id, 'Audited ' || policy_name || ' against GDPR. ' || CASE WHEN n = 0 THEN 'No compliance gaps were identified for this query.' ELSE 'Found ' || n || CASE WHEN n = 1 THEN ' gap - ' ELSE ' gaps - ' END || concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN m > 0 THEN m || ' medium' END, CASE WHEN l > 0 THEN l || ' low' END) || '.' END AS summary FROM runs JOIN g USING (run_id)""")
def run_reports(spark, d):
    r = views.runs(spark, d).select("run_id", F.col("policy_name").alias("document"), F.lit("GDPR").alias("frameworks"))
    q = F.col("l_quantity")
    g = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(q > 45, "critical").when(q > 30, "high").when(q > 15, "medium").otherwise("low").alias("severity"))
    return audit.run_reports(r, g)


@query("SELECT coalesce(CASE WHEN doc_id % 4 <> 0 THEN source END, 'unknown') AS paper_id, coalesce(try_cast(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE doc_id::VARCHAR END AS INT), 0) AS page, substr(text, 1, 500) AS text FROM documents")
def source_chunks(spark, d):
    x = views.table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("paper_id"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("doc_id").cast("string")).alias("page"), "text")
    return audit.source_chunks(x)
