"""Scalar functions over text and names: Column in, Column out, all built from Spark SQL functions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

Words = Iterable[str]


def quoted(text: str) -> str:
    """A literal as a Java regular expression."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", text)


def any_of(text: Column, words: Words, word_boundary: bool = False) -> Column:
    """Whether any of the words occurs in the lower-cased text; as a substring unless ``word_boundary``."""
    words = list(words)
    if not words:
        return F.lit(False)
    body = "|".join(map(quoted, words))
    return F.coalesce(F.lower(text).rlike(rf"\b(?:{body})\b" if word_boundary else body), F.lit(False))


def first_class(text: Column, classes: Mapping[str, Words], default: str | None) -> Column:
    """The first class one of whose words occurs in the text."""
    out = F.lit(default)
    for name, words in reversed(list(classes.items())):
        out = F.when(any_of(text, words), F.lit(name)).otherwise(out)
    return out


def classes_in(text: Column, classes: Mapping[str, Words], word_boundary: bool = False) -> Column:
    """All classes one of whose words occurs in the text, in order."""
    return F.filter(F.array(*(F.when(any_of(text, words, word_boundary), F.lit(name)) for name, words in classes.items())), lambda x: x.isNotNull())


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]+$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


# --- names, ids, routing


def detect_regulation(file_name: Column, patterns: Mapping[str, Words] = vocab.REGULATION_PATTERNS) -> Column:
    return first_class(file_name, patterns, "UNKNOWN")


def chunk_id(file_name: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", stem(file_name), index.cast("int"))


def doc_type(path: Column, explicit: str | None = None) -> Column:
    """An explicit class wins; else a path with policies or policy_docs is a policy."""
    by_path = F.when(F.lower(path).rlike("policies|policy_docs"), "policy").otherwise("regulation")
    return F.coalesce(F.lit(explicit).cast("string"), by_path)


def filled(value: Column, default: Column | str) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def scope(paper_id: str | None = None, doc_class: str | None = "policy", regulation: str | None = None) -> Column:
    """A predicate on class, document and regulation; values are literals, so nothing needs quoting."""
    out = F.lit(True)
    for column, value in (("doc_type", doc_class), ("paper_id", paper_id), ("regulation", regulation)):
        if value is not None:
            out = out & (F.col(column) == F.lit(value))
    return out


# --- jurisdictions, questions


def detect_jurisdictions(question: Column, evidence: Column | None = None, known: Column | None = None, keywords: Mapping[str, Words] = vocab.JURISDICTION_KEYWORDS, word_boundary: bool = False) -> Column:
    """Jurisdictions named in the question or the evidence text, then those already known; UNKNOWN if none. A space parts question and evidence."""
    text = question if evidence is None else F.concat_ws(" ", question, evidence)
    found = classes_in(text, keywords, word_boundary)
    if known is not None:
        found = F.array_union(found, F.filter(F.coalesce(known, F.array()), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("UNKNOWN")))


def normalize_jurisdictions(given: Column, fallback: Column, allowed: Words = tuple(vocab.JURISDICTION_KEYWORDS)) -> Column:
    """Upper case, allowed values only, first occurrences; ALL stands for every value; the fallback if nothing is left."""
    every = F.array(*map(F.lit, allowed))
    upper = F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.upper(strip(x)))
    kept = F.array_distinct(F.filter(upper, lambda x: F.array_contains(every, x)))
    return F.when(F.array_contains(upper, "ALL"), every).when(F.size(kept) > 0, kept).otherwise(fallback)


def is_cross_document(question: Column, signals: Words = vocab.CROSS_DOCUMENT_SIGNALS) -> Column:
    return any_of(question, signals)


def intent(question: Column, coverage: Words = vocab.COVERAGE_SIGNALS, audit: Words = vocab.AUDIT_WORDS) -> Column:
    return F.when(any_of(question, coverage) & ~any_of(question, audit), "coverage").otherwise("audit")


def needs_fresh(question: Column, signals: Words = vocab.FRESH_SIGNALS) -> Column:
    return F.when(any_of(question, signals), "fresh").otherwise("internal")


def name_tokens(file_name: Column, stopwords: Words = vocab.FILENAME_STOPWORDS) -> Column:
    """The significant parts of a file name."""
    low = F.regexp_replace(F.lower(file_name), r"\.[a-z0-9]+$", "")
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def names_document(question: Column, file_name: Column, stopwords: Words = vocab.FILENAME_STOPWORDS) -> Column:
    """Whether a question has the whole stem of a file name, or one of its significant parts."""
    q, low = F.lower(question), F.regexp_replace(F.lower(file_name), r"\.[a-z0-9]+$", "")
    return ((F.length(low) > 0) & F.contains(q, low)) | F.exists(name_tokens(file_name, stopwords), lambda t: F.contains(q, t))


# --- obligations


def obligation_type(text: Column, keywords: Mapping[str, Words] = vocab.OBLIGATION_KEYWORDS) -> Column:
    return first_class(F.translate(text, "_", " "), keywords, "other")


def article_reference(text: Column) -> Column:
    """"Article n[a][(m)]" of the first reference in the text, else empty."""
    number = F.regexp_extract(text, r"(?i)\b(?:article|art\.?)\s*(\d+[a-z]?(?:\(\d+\))?)", 1)
    return F.when(number != "", F.concat(F.lit("Article "), number)).otherwise("")


def in_scope(sides: Column, audited: Column, regulations: Words = tuple(vocab.REGULATION_WEIGHTS)) -> Column:
    """A conflict is in scope if every regulation that its ends name is audited; also if none is named or nothing is given."""
    named = classes_in(sides, {r: (r.lower(),) for r in regulations})
    given = F.coalesce(audited, F.array().cast("array<string>"))
    return (F.size(given) == 0) | (F.size(F.array_except(named, given)) == 0)


# --- model output


def unfenced(raw: Column) -> Column:
    """Without the code fences that models put around JSON."""
    return strip(F.regexp_replace(strip(raw), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def parsed_list(raw: Column, element: str) -> Column:
    """The array in a model's output, empty unless the output is a JSON list. ``element`` is the DDL type of one element."""
    text = unfenced(raw)
    return F.coalesce(F.when(F.startswith(text, F.lit("[")), F.from_json(text, f"array<{element}>")), F.array().cast(f"array<{element}>"))


def quoted_strings(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit('"([^"]{3,80})"'), F.lit(1))


def clean_entities(entities: Column, most: int = 15) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(entities, strip), lambda x: x != "")), 1, most)


def entities_from(raw: Column, most: int = 15) -> Column:
    """Entities of a model's output: its JSON list, or failing that its quoted strings."""
    listed = parsed_list(raw, "string")
    return clean_entities(F.when(F.size(listed) > 0, listed).otherwise(quoted_strings(raw)), most)


def answer_fields(raw: Column) -> Column:
    """answer, gaps and recommendations of a model's output; the raw text is the answer unless all three are there."""
    kind = "struct<answer:string,gaps:array<string>,recommendations:array<string>>"
    got = F.from_json(unfenced(raw), kind)
    whole = got["answer"].isNotNull() & got["gaps"].isNotNull() & got["recommendations"].isNotNull()
    return F.when(whole, got).otherwise(F.struct(raw.alias("answer"), F.array().cast("array<string>").alias("gaps"), F.array().cast("array<string>").alias("recommendations")))


def theme_or_other(theme: Column, themes: Words = tuple(vocab.GAP_THEMES)) -> Column:
    return F.when(theme.isin(*themes), theme).otherwise("other")


# --- scores


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """A closed vocabulary as an expression: no join, no shuffle."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def risk_to_compliance(risk: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - risk * 10.0)), 1)


def rating(score: Column) -> Column:
    out = F.lit(vocab.RATINGS[-1][1])
    for least, label in reversed(vocab.RATINGS[:-1]):
        out = F.when(score >= least, label).otherwise(out)
    return F.when(score.isNull(), "NO DATA").otherwise(out)


def severity_rank(severity: Column) -> Column:
    return lookup(F.coalesce(severity, F.lit("low")), vocab.SEVERITY_ORDER, 5)


def severity_score(severity: Column) -> Column:
    return lookup(F.coalesce(severity, F.lit("medium")), vocab.SEVERITY_SCORES, vocab.DEFAULT_SEVERITY_SCORE)


def exposure_line(regulation: Column, risk: Column) -> Column:
    cap = lookup(regulation, vocab.PENALTY_CAPS, "N/A")
    return F.when(risk.isNull(), F.concat(regulation, F.lit(": no data"))).otherwise(F.concat(regulation, F.lit(": "), F.format_number(risk, 1), F.lit("/10 — "), cap))


def retrieval_grade(best_distance: Column, least: float = 0.3) -> Column:
    grade = F.coalesce(1 / (1 + best_distance), F.lit(0.0))
    return F.struct(grade.alias("grade"), (grade >= least).alias("sufficient"))


def answer_grade(raw: Column, least: int = 3) -> Column:
    grade = F.coalesce(strip(raw).try_cast("int"), F.lit(0))
    return F.struct(grade.alias("grade"), (grade >= least).alias("sufficient"))


# --- rendering


def conflict_note(source: Column, target: Column, value_a: Column, value_b: Column, description: Column) -> Column:
    both = (F.coalesce(value_a, F.lit("")) != "") & (F.coalesce(value_b, F.lit("")) != "")
    head = F.when(both, F.concat(F.lit("- **"), source, F.lit("** requires "), value_a, F.lit(", while **"), target, F.lit("** requires "), value_b, F.lit("."))).otherwise(F.concat(F.lit("- **"), source, F.lit("** vs **"), target, F.lit("**")))
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(head, F.lit(" "), description)).otherwise(head)


def triple_text(source: Column, relation: Column, target: Column, regulation: Column) -> Column:
    return F.format_string("(%s) --[%s]--> (%s)  [%s]", source, relation, target, regulation)


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def clean_table(text: Column) -> Column:
    """Table text of converted documents: bars are spaces, break tags are line breaks, runs of blank lines are one."""
    return strip(F.regexp_replace(F.regexp_replace(F.translate(text, "|", " "), "<br>", "\n"), r"\n{3,}", "\n\n"))


def header_id(header: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(header, r"^##\s*", ""), r"(?U)\s+", " "))


def first_of(*alternatives: Column) -> Column:
    """The first value that is neither null nor NaN."""
    return F.coalesce(*(F.when(F.isnan(c.cast("double")), None).otherwise(c) for c in alternatives))


def relation_label(relation: Column, value_a: Column, value_b: Column) -> Column:
    values = F.when((F.coalesce(value_a, F.lit("")) != "") & (F.coalesce(value_b, F.lit("")) != ""), F.concat(F.lit(" ("), value_a, F.lit(" vs "), value_b, F.lit(")")))
    return F.concat_ws("", F.lower(F.translate(F.coalesce(relation, F.lit("CONFLICTS_WITH")), "_", " ")), values)


def coverage_note(n_gaps: Column, critical: Column, high: Column) -> Column:
    s = lambda n: F.when(n > 1, "s").otherwise("")
    return (
        F.when(n_gaps == 0, "Fully addresses this requirement — no gaps identified.")
        .when(critical > 0, F.concat(F.lit("Has relevant language but with **"), critical, F.lit(" critical** gap"), s(critical), F.when(high > 0, F.concat(F.lit(" and "), high, F.lit(" high"))).otherwise(""), F.lit(" — coverage is incomplete.")))
        .when(high > 0, F.concat(F.lit("Partially addresses this requirement — **"), high, F.lit(" high-severity** gap"), s(high), F.lit(" identified.")))
        .otherwise(F.concat(F.lit("Covers this topic with "), n_gaps, F.lit(" minor gap"), F.when(n_gaps == 1, "").otherwise("s"), F.lit(".")))
    )


# --- graph display and pseudonyms


def clean_label(raw: Column) -> Column:
    label = strip(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[_-]+", " "), r"(?U)\s+", " "))
    low, hexes = F.lower(label), F.regexp_replace(label, "(?i)[^a-f0-9]", "")
    out = F.when(F.length(label) > 46, F.concat(F.substring(label, 1, 43), F.lit("..."))).otherwise(label)
    # What a label with a keyword is called.
    for words, name in reversed(((("gdpr",), "GDPR Requirement"), (("hipaa",), "HIPAA Requirement"), (("ccpa",), "CCPA Requirement"), (("nist",), "NIST Control"), (("gap", "missing"), "Compliance Gap"), (("recommend",), "Recommended Fix"))):
        out = F.when(any_of(low, words), name).otherwise(out)
    return F.when(label == "", "Compliance Evidence").when(F.length(hexes) >= 12, "Policy Evidence").otherwise(out)


def node_category(label: Column) -> Column:
    # Keywords by category, first match wins; a trailing .pdf marks a policy.
    words = {"risk": ("gap", "risk", "missing", "conflict"), "recommendation": ("recommend", "remediation"), "policy": ("policy",), "regulation": ("gdpr", "hipaa", "ccpa", "nist", "regulation"), "requirement": ("requirement", "obligation", "control", "article")}
    out = F.lit("evidence")
    for name, w in reversed(list(words.items())):
        hit = any_of(label, w) | (F.endswith(F.lower(label), F.lit(".pdf")) if name == "policy" else F.lit(False))
        out = F.when(hit, name).otherwise(out)
    return out


def hash_alias(name: Column) -> Column:
    """A number from a 31-based hash of the characters, wrapped to 32 bits."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: wrap(acc * 31 + F.ascii(c)))
    return F.concat(F.lit("privacy_policy_"), (F.abs(h % 900) + 100).cast("string"), F.lit(".pdf"))


def pseudonym(file_name: Column, aliases: Mapping[str, str] = vocab.POLICY_ALIASES) -> Column:
    clean = F.when(base_name(file_name) != "", base_name(file_name)).otherwise(file_name)
    known = F.element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), F.lower(clean))
    hashed = F.contains(F.lower(clean), F.lit("privacy")) | F.endswith(F.lower(clean), F.lit(".pdf"))
    return F.when(F.coalesce(file_name, F.lit("")) == "", "privacy_policy.pdf").otherwise(F.coalesce(known, F.when(hashed, hash_alias(clean)).otherwise(clean)))


def pseudonymize(text: Column, aliases: Mapping[str, str] = vocab.POLICY_ALIASES, names: Mapping[str, str] = vocab.COMPANY_NAMES) -> Column:
    out = F.coalesce(text, F.lit(""))
    for real, alias in aliases.items():
        loose = re.sub("[_-]", "[ _-]", re.sub(r"\.pdf$", "", real))
        out = F.regexp_replace(out, f"(?i){quoted(real)}", alias)
        out = F.regexp_replace(out, f"(?i){loose}", re.sub(r"\.pdf$", "", alias))
    for name, alias in names.items():
        out = F.regexp_replace(out, f"(?i){quoted(name)}", alias)
    return out


def display_label(document: Column) -> Column:
    return F.substring(F.translate(stem(document), "_", " "), 1, 30)
