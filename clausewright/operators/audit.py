"""Audit scoring: obligations and gaps to risks, compliance, theme groups, coverage and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from .relational import first_wins, top_per_group

DOCUMENT = ("document",)


def obligations_from(triples: DataFrame, jurisdictions: Column, group: Sequence[str] = DOCUMENT, order: str = "pos", shortest: int = 15, keywords: Mapping[str, Sequence[str]] = vocab.OBLIGATION_KEYWORDS) -> DataFrame:
    """(group..., id, regulation, text, article, type) from (group..., pos, source, relation, target, regulation)."""
    text = T.strip(F.concat_ws(" ", "source", "relation", "target"))
    rows = triples.withColumn("text", text).withColumn("low", F.lower("text")).where(F.length("text") >= shortest)
    regulation = F.when(F.coalesce(F.col("regulation"), F.lit("")) != "", F.col("regulation")).otherwise(F.coalesce(F.get(jurisdictions, F.lit(0)), F.lit("UNKNOWN")))
    once = first_wins(rows.withColumn("regulation", regulation), [*group, "low"], [order])
    return once.select(*group, F.format_string("OBL-%04d", F.col(order).cast("int")).alias("id"), "regulation", "text", T.article_reference(F.col("text")).alias("article"), T.obligation_type(F.col("text"), keywords).alias("type"))


def obligation_counts(obligations: DataFrame, group: Sequence[str] = DOCUMENT) -> DataFrame:
    return obligations.groupBy(*group, "regulation").agg(F.count("*").alias("n_obligations"))


def gap_weights(gaps: DataFrame, group: Sequence[str] = DOCUMENT) -> DataFrame:
    return gaps.groupBy(*group, "regulation").agg(F.sum(T.severity_score(F.col("severity"))).alias("weight"), F.count("*").alias("n_gaps"))


def regulation_risk(obligations: DataFrame, gaps: DataFrame, group: Sequence[str] = DOCUMENT) -> DataFrame:
    """(group..., regulation, n_obligations, n_gaps, risk, compliance); regulations without obligations have no score."""
    both = obligation_counts(obligations, group).join(gap_weights(gaps, group), [*group, "regulation"], "left")
    raw = F.least(F.coalesce("weight", F.lit(0.0)) / (F.col("n_obligations") * 10.0) * 10.0, F.lit(10.0))
    return both.select(*group, "regulation", "n_obligations", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), raw.alias("raw")).withColumns({"risk": F.bround("raw", 2), "compliance": T.risk_to_compliance(F.col("raw"))})


def document_risk(risks: DataFrame, group: Sequence[str] = DOCUMENT, weights: Mapping[str, float] = vocab.REGULATION_WEIGHTS) -> DataFrame:
    """(group..., risk, compliance, rating): regulation risks under weights that add up to one over the scored regulations."""
    w = T.lookup(F.col("regulation"), weights, vocab.DEFAULT_WEIGHT)
    out = risks.groupBy(*group).agg((F.sum(w * F.col("risk")) / F.sum(w)).alias("raw"))
    return out.select(*group, F.bround("raw", 2).alias("risk"), T.risk_to_compliance(F.col("raw")).alias("compliance")).withColumn("rating", T.rating(F.col("compliance")))


def audit_scores(risks: DataFrame, documents: DataFrame) -> DataFrame:
    """(regulation, compliance): means over documents with scores, and the overall mean as OVERALL."""
    per = risks.groupBy("regulation").agg(F.bround(F.avg("compliance"), 1).alias("compliance"), F.count("*").alias("documents"))
    return per.unionByName(documents.agg(F.lit("OVERALL").alias("regulation"), F.bround(F.avg("compliance"), 1).alias("compliance"), F.count("*").alias("documents")))


def gap_groups(gaps: DataFrame, group: Sequence[str] = DOCUMENT, order: str = "obligation_id", themes: Mapping[str, str] = vocab.GAP_THEMES) -> DataFrame:
    """(group..., theme, label, severity, n_gaps, regulations, gaps, position): worst group first, then by theme order; gaps by severity."""
    rank = T.severity_rank(F.col("severity"))
    item = F.struct(rank.alias("rank"), F.col(order).alias("key"), F.col("severity"), F.col("regulation"), F.col("description") if "description" in gaps.columns else F.lit(None).cast("string").alias("description"))
    named = gaps.withColumn("theme", T.theme_or_other(F.col("theme"), tuple(themes)))
    grouped = named.groupBy(*group, "theme").agg(F.array_sort(F.collect_list(item)).alias("gaps"), F.min(rank).alias("worst"), F.count("*").alias("n_gaps"))
    names = list(vocab.SEVERITY_ORDER)
    out = grouped.withColumns({
        "label": T.lookup(F.col("theme"), themes, themes["other"]),
        "severity": F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("worst")), F.lit("unknown")),
        "regulations": F.array_distinct(F.transform("gaps", lambda g: g["regulation"])),
        "theme_order": T.lookup(F.col("theme"), {t: i for i, t in enumerate(themes)}, len(themes)),
    })
    return out.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy("worst", "theme_order"))).drop("worst", "theme_order")


def severity_counts(gaps: DataFrame, group: Sequence[str] = DOCUMENT) -> DataFrame:
    levels = {f"n_{s}": F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")}
    return gaps.groupBy(*group).agg(*(c.alias(n) for n, c in levels.items()), F.count("*").alias("n_gaps"), F.bool_or(F.col("severity") == "critical").alias("any_critical"))


def document_tally(gaps: DataFrame, group: Sequence[str] = DOCUMENT) -> DataFrame:
    counts = severity_counts(gaps, group)
    return counts.withColumn("worst", F.when(F.col("n_critical") > 0, "critical").when(F.col("n_high") > 0, "high").when(F.col("n_medium") > 0, "medium").otherwise("low"))


def gaps_per_regulation(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("regulation").agg(F.count("*").alias("n_gaps"))


def without_themes(gaps: DataFrame, resolved: DataFrame) -> DataFrame:
    """Gaps whose theme is not resolved: the input of a what-if score."""
    return gaps.join(resolved.select("theme").distinct(), "theme", "left_anti")


def coverage(documents: DataFrame, chunks: DataFrame, gaps: DataFrame) -> DataFrame:
    """(document, has_content, n_critical, n_high, n_gaps, note) of every audited document."""
    held = chunks.groupBy("document").agg(F.count("*").alias("n_chunks"))
    n = severity_counts(gaps).select("document", "n_critical", "n_high", "n_gaps")
    out = documents.select("document").distinct().join(held, "document", "left").join(n, "document", "left").na.fill(0)
    return out.select("document", (F.col("n_chunks") > 0).alias("has_content"), "n_critical", "n_high", "n_gaps").withColumn("note", F.when(F.col("has_content"), T.coverage_note(F.col("n_gaps"), F.col("n_critical"), F.col("n_high"))).otherwise("No relevant content found in the indexed policy text."))


def fallback_gaps(obligations: DataFrame, failed: DataFrame, critical: Sequence[str] = vocab.CRITICAL_TYPES, chars: int = 120) -> DataFrame:
    """Documents whose analysis failed: each obligation of a critical type is a high gap."""
    rows = obligations.join(failed.select("document").distinct(), "document", "left_semi").where(F.col("type").isin(*critical))
    text = F.col("text") if "text" in obligations.columns else F.col("id").cast("string")
    return rows.select("document", F.col("id").alias("obligation_id"), "regulation", F.lit("missing").alias("status"), T.preview(text, chars).alias("description"), F.lit("high").alias("severity"), F.lit("other").alias("theme"), F.col("type").alias("ob_type"))


def typed_gaps(gaps: DataFrame, obligations: DataFrame) -> DataFrame:
    """Gaps with the type of their obligation, else other, and a theme of the closed vocabulary."""
    kinds = obligations.select("document", F.col("id").alias("obligation_id"), F.col("type").alias("ob_type"))
    return gaps.join(kinds, ["document", "obligation_id"], "left").withColumns({"ob_type": F.coalesce("ob_type", F.lit("other")), "theme": T.theme_or_other(F.col("theme"))})


def with_remediation(groups: DataFrame, remediations: DataFrame, group: Sequence[str] = DOCUMENT) -> DataFrame:
    return groups.join(remediations.select(*group, "theme", "recommendation"), [*group, "theme"], "left").na.fill("", ["recommendation"])


def with_findings(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that have at least one row in ``found``."""
    return documents.join(found.select("document").distinct(), "document", "left_semi")


def exposure(risks: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """(document, regulation, line) for every audited pair, scored or not: as many rows as documents times regulations, which is the report."""
    pairs = risks.select("document").distinct().crossJoin(jurisdictions.select("regulation").distinct())
    return pairs.join(risks.select("document", "regulation", "risk"), ["document", "regulation"], "left").select("document", "regulation", T.exposure_line(F.col("regulation"), F.col("risk")).alias("line"))


def scoped_conflicts(conflicts: DataFrame, audited: Sequence[str] | None) -> DataFrame:
    given = F.array(*map(F.lit, audited)) if audited else F.array().cast("array<string>")
    return conflicts.where(T.in_scope(F.concat_ws(" ", "src", "dst"), given))


def document_conflicts(conflicts: DataFrame, obligations: DataFrame, regulations: Sequence[str] = tuple(vocab.REGULATION_WEIGHTS)) -> DataFrame:
    """(document, src, rel, dst, description): the conflicts whose ends name a regulation that the document has obligations under; one that names none is no document's own."""
    named = conflicts.withColumn("regulation", F.explode(T.classes_in(F.concat_ws(" ", "src", "dst"), {r: (r.lower(),) for r in regulations})))
    return named.join(obligations.select("document", "regulation").distinct(), "regulation").select("document", "src", "rel", "dst", "description").distinct()


def report_rows(risks: DataFrame, documents: DataFrame, jurisdictions: Sequence[str]) -> DataFrame:
    """The framework table of each document's report: N/A and NO DATA where a regulation has no score."""
    wanted = documents.select("document").withColumn("regulation", F.explode(F.array(*map(F.lit, jurisdictions))))
    out = wanted.join(risks.select("document", "regulation", "compliance"), ["document", "regulation"], "left")
    shown = F.when(F.col("compliance").isNull(), "N/A").otherwise(F.concat(F.format_string("%d", F.bround("compliance", 0).cast("int")), F.lit("/100")))
    return out.select("document", "regulation", shown.alias("compliance"), T.rating(F.col("compliance")).alias("rating"))


def reports(risks: DataFrame, documents: DataFrame, groups: DataFrame, jurisdictions: Sequence[str], shown: int = 3) -> DataFrame:
    """(document, report): one text per document with its framework table and its first theme groups; the others are counted. Groups with a recommendation make a checklist, worst first."""
    order = F.array_position(F.array(*map(F.lit, jurisdictions)), F.col("regulation"))
    table = report_rows(risks, documents, jurisdictions).groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.format_string("| %s | %s | %s |", "regulation", "compliance", "rating").alias("t")))), lambda s: s["t"]), "\n").alias("table"))
    line = F.format_string("- **%s** _(%s · %s)_ %d", "label", F.array_join("regulations", ", "), F.upper("severity"), "n_gaps")
    top = groups.where(F.col("position") <= shown).groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("t")))), lambda s: s["t"]), "\n").alias("findings"))
    more = groups.groupBy("document").agg(F.count_if(F.col("position") > shown).alias("more"))
    out = documents.select("document", "compliance", "rating").join(table, "document", "left").join(top, "document", "left").join(more, "document", "left")
    tail = F.when(F.coalesce("more", F.lit(0)) > 0, F.format_string("Show %d more finding(s)", "more"))
    checklist = F.lit(None).cast("string")
    if "recommendation" in groups.columns:
        todo = F.struct("position", F.format_string("- [ ] **%s**: %s", "label", "recommendation").alias("t"))
        lists = groups.where(T.strip(F.col("recommendation")) != "").groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(todo)), lambda s: s["t"]), "\n").alias("checklist"))
        out, checklist = out.join(lists, "document", "left"), F.col("checklist")
    return out.select("document", F.concat_ws("\n", F.format_string("### %s — %s/100 %s", "document", F.col("compliance").cast("string"), "rating"), "table", F.coalesce("findings", F.lit("No compliance gaps identified for the queried scope.")), tail, checklist).alias("report"))


def coverage_report(matrix: DataFrame, groups: DataFrame, shown: int = 2) -> DataFrame:
    """(document, line): the note of each document with its first missing themes."""
    top = groups.where(F.col("position") <= shown).groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat(F.col("label"), F.lit(" ("), F.array_join("regulations", ", "), F.lit(")")).alias("t")))), lambda s: s["t"]), "; ").alias("missing"))
    return matrix.join(top, "document", "left").select("document", "has_content", F.concat_ws(" ", F.concat(F.lit("**"), F.col("document"), F.lit("** —")), "note", F.when(F.col("missing").isNotNull(), F.concat(F.lit("Missing: "), F.col("missing")))).alias("line"))


def run_metrics(runs: DataFrame, id_col: str, metrics: Sequence[str]) -> DataFrame:
    """(id, metric, value): the long form of a run's metrics."""
    return runs.unpivot([id_col], list(metrics), "metric", "value").where("value is not null")


def history(runs: DataFrame, most: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("start_time"), "run_id").limit(most)


def trends(runs: DataFrame, most: int = 50, policy: str | None = None, filter_first: bool = True) -> DataFrame:
    """Oldest first; the policy filter is applied before the limit unless asked otherwise."""
    keep = F.col("policy_name") == policy if policy is not None else F.lit(True)
    rows = history(runs.where(keep), most) if filter_first else history(runs, most).where(keep)
    return rows.orderBy("start_time", "run_id")


def frameworks(runs: DataFrame) -> DataFrame:
    """(run_id, frameworks) from arrays jurisdictions and gap_regulations and a comma-separated text."""
    third = F.filter(F.transform(F.split(F.coalesce("jurisdiction_text", F.lit("")), ","), T.strip), lambda x: x != "")
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    names = F.array_distinct(F.concat(some("jurisdictions"), some("gap_regulations"), third))
    return runs.select("run_id", F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("?").alias("frameworks"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Gaps by tracker weight, as lines of fixed width."""
    weight = T.lookup(F.col("severity"), vocab.TRACKER_WEIGHTS, 0.0)
    line = F.concat(F.rpad(F.upper(F.coalesce("severity", F.lit("?"))), 9, " "), F.rpad(F.coalesce("regulation", F.lit("")), 7, " "), F.col("obligation_id").cast("string"))
    return gaps.withColumns({"weight": weight, "line": line}).orderBy(F.desc("weight"), "obligation_id")


def loggable(results: DataFrame) -> DataFrame:
    return results.where((F.size("jurisdictions") > 0) & F.col("clarification").isNull())


def of_targets(obligations: DataFrame, targets: DataFrame) -> DataFrame:
    """Obligations of all target documents of each audit: the columns of ``obligations`` and audit_id. ``targets`` is (audit_id, document)."""
    return obligations.join(targets.select("audit_id", "document").distinct(), "document")


def results(groups: DataFrame, counts: DataFrame, risks: DataFrame, gaps: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """One row per document: theme groups, obligation counts and scores as nested values, and its gaps and conflicts where they are given.

    ``gaps`` has document, severity, regulation, theme and obligation_id, ``conflicts`` document, src, rel, dst and description.
    """
    nested = lambda df, name, *cols: df.groupBy("document").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    g = nested(groups, "gap_groups", "position", "theme", "severity", "n_gaps")
    n = counts.groupBy("document").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("regulation", "n_obligations")))).alias("obligation_counts"))
    s = risks.groupBy("document").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("regulation", "compliance")))).alias("compliance"))
    out = n.join(g, "document", "left").join(s, "document", "left")
    if gaps is not None:
        ranked = gaps.withColumn("__rank", F.coalesce(F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.col("severity")), F.lit(0)))
        worst = nested(ranked.withColumn("__rank", F.when(F.col("__rank") == 0, 6).otherwise(F.col("__rank"))), "gaps", F.col("__rank").alias("rank"), "obligation_id", "severity", "regulation", "theme")
        out = out.join(worst, "document", "left")
    return out if conflicts is None else out.join(nested(conflicts, "conflicts", "src", "rel", "dst", "description"), "document", "left")


def top_groups(groups: DataFrame, n: int = 3) -> DataFrame:
    return top_per_group(groups.drop("rank") if "rank" in groups.columns else groups, ["document"], ["position"], n)


def run_reports(runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """(run_id, summary): what each run audited and found, by severity; runs without gaps say so.

    ``runs`` has run_id, document and frameworks, ``gaps`` run_id and severity.
    """
    counts = severity_counts(gaps, ["run_id"])
    out = runs.join(counts, "run_id", "left").na.fill(0, ["n_gaps", "n_critical", "n_high", "n_medium", "n_low"])
    part = lambda s: F.when(F.col(f"n_{s}") > 0, F.concat_ws(" ", F.col(f"n_{s}").cast("string"), F.lit(s)))
    found = F.concat(F.lit("Found "), F.col("n_gaps").cast("string"), F.when(F.col("n_gaps") == 1, " gap - ").otherwise(" gaps - "), F.concat_ws(", ", *map(part, ("critical", "high", "medium", "low"))), F.lit("."))
    said = F.when(F.col("n_gaps") == 0, "No compliance gaps were identified for this query.").otherwise(found)
    return out.select("run_id", F.concat(F.lit("Audited "), T.pseudonym(F.col("document")), F.lit(" against "), F.col("frameworks"), F.lit(". "), said).alias("summary"))


def source_chunks(chunks: DataFrame, chars: int = 500) -> DataFrame:
    """Chunks as an answer lists them: unknown document and page 0 where missing, and the first characters."""
    return chunks.select(F.coalesce("paper_id", F.lit("unknown")).alias("paper_id"), F.coalesce(F.col("page").try_cast("int"), F.lit(0)).alias("page"), T.preview(F.coalesce("text", F.lit("")), chars).alias("text"))
