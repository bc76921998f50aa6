"""Views that give the driver's tables the shapes of the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGULATION_BY_LANG = {"en": "GDPR", "fr": "CCPA", "de": "HIPAA", "es": "NIST"}
#: Words of the test corpus by class, in place of legal words that it does not have.
FIXTURE_KEYWORDS = {"LICENSE": ("license", "rights reserved"), "MAIL": ("@",), "HEADING": ("###",), "GERMAN": (" der ", " und "), "FRENCH": (" les ", " des ")}
FIXTURE_PATTERNS = {"GDPR": ("src1",), "CCPA": ("src2", "src3"), "HIPAA": ("src15", "src4"), "NIST": ("src5",)}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    reg = F.lit(None).cast("string")
    for lang, r in REGULATION_BY_LANG.items():
        reg = F.when(F.col("lang") == lang, r).otherwise(reg)
    return x.select("doc_id", F.when(F.col("source").isNotNull() & F.col("doc_id").isNotNull(), F.format_string("%s_policy_%06d.pdf", "source", "doc_id")).alias("paper_id"), reg.alias("regulation"), F.when(F.col("doc_id") % 2 == 0, "policy").otherwise("regulation").alias("doc_type"), "source", "lang", "text")


CORPUS = """corpus AS (SELECT doc_id, printf('%s_policy_%06d.pdf', source, doc_id) AS paper_id, CASE lang WHEN 'en' THEN 'GDPR' WHEN 'fr' THEN 'CCPA' WHEN 'de' THEN 'HIPAA' WHEN 'es' THEN 'NIST' END AS regulation,
  CASE WHEN doc_id % 2 = 0 THEN 'policy' ELSE 'regulation' END AS doc_type, source, lang, text FROM documents)"""


def obligations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    reg = F.when(F.col("o_orderstatus") == "F", "GDPR").when(F.col("o_orderstatus") == "O", "HIPAA").otherwise("CCPA")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("o_orderpriority"))
    return o.select(F.concat(F.lit("policy_"), F.col("o_custkey") % 50).alias("document"), F.col("o_orderkey").alias("id"), reg.alias("regulation"), F.coalesce(kind, F.lit("other")).alias("type"))


KINDS = {"1-URGENT": "breach_notification", "2-HIGH": "encryption", "3-MEDIUM": "consent", "4-NOT SPECIFIED": "audit_logging", "5-LOW": "data_retention"}
OBLIGATIONS = f"""obligations AS (SELECT 'policy_' || (o_custkey % 50) AS document, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'GDPR' WHEN 'O' THEN 'HIPAA' ELSE 'CCPA' END AS regulation,
  CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'other' END AS type FROM orders)"""
#: Themes by line number; one name is outside the vocabulary.
THEMES = ("data_retention", "consent_mechanisms", "breach_notification", "security_measures", "recordkeeping", "minor_consent", "unlisted_theme")


def gaps(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    severity = F.when(q > 45, "critical").when(q > 30, "high").when(q > 15, "medium").otherwise("low")
    theme = F.get(F.array(*map(F.lit, THEMES)), (F.col("l_linenumber") - 1) % len(THEMES))
    o = obligations(spark, d).select("document", "id", "regulation")
    return li.join(o, li["l_orderkey"] == o["id"]).select("document", F.col("l_orderkey").alias("obligation_id"), F.col("l_linenumber").alias("line"), "regulation", severity.alias("severity"), theme.alias("theme"))


GAPS = f"""{OBLIGATIONS}, gaps AS (SELECT document, l_orderkey AS obligation_id, l_linenumber AS line, regulation, CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS severity,
  list_extract([{", ".join(f"'{t}'" for t in THEMES)}], (l_linenumber - 1) % {len(THEMES)} + 1) AS theme FROM lineitem JOIN obligations ON l_orderkey = id)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    part = lambda df, a, rel, b: df.select(a.alias("src"), F.lit(rel).alias("rel"), b.alias("dst"))
    nation, region, supplier, customer = (table(spark, d, t) for t in ("nation", "region", "supplier", "customer"))
    n = lambda p, c: F.concat(F.lit(p), F.col(c))
    supplies = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = part(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), "PART_OF", F.col("r_name"))
    out = out.unionAll(part(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), n("S", "s_suppkey"), "APPLIES_TO", F.col("n_name")))
    out = out.unionAll(part(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), n("C", "c_custkey"), "APPLIES_TO", F.col("n_name")))
    return out.unionAll(part(supplies, n("S", "l_suppkey"), "REQUIRES", n("P", "l_partkey")))


EDGES = """edges AS (SELECT n_name AS src, 'PART_OF' AS rel, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'S' || s_suppkey, 'APPLIES_TO', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'APPLIES_TO', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'REQUIRES', 'P' || l_partkey FROM lineitem)"""


def paged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), (F.col("turn") + 1).cast("int").alias("page"), "role", "text")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("policy_"), F.col("user_id")).alias("policy_name"), F.col("ts").alias("start_time"), F.col("value").alias("compliance_score"), "event_type")


RUNS = "runs AS (SELECT event_id AS run_id, 'policy_' || user_id AS policy_name, ts AS start_time, value AS compliance_score, event_type FROM events)"
