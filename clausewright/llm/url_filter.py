"""URL filters: rules by host and path, and a character language-model ratio. DataFrame functions only.

Variable-order Markov models with Witten-Bell smoothing (contexts of ``ORDER`` characters
down to none, then a uniform alphabet) are counted over all URLs: one of rejected URLs,
those whose host holds a seed word, and ``FOLDS`` of accepted ones. Hosts are dealt into
folds by a hash, and a URL is scored against the accepted model that saw no host of its
fold, so that no host vouches for itself: a host of a kind that no other accepted host has
is blocked although no seed names it, and a seed word in an else ordinary path blocks nothing.

A URL's score is the mean over its characters of the log-likelihood difference of the two
models. The threshold is calibrated on the accepted URLs, all of them held out: at most
``FALSE_BLOCKS`` of them score below it, and it is never above zero, where the rejected model
no longer explains a URL better. URLs below it are blocked unless a rule says otherwise.

Counting makes one row per character of each distinct URL, combined before the shuffle;
the folds are columns of one table, and the lower orders are summed from the table of
distinct n-grams. Scores come from a join on the n-gram, summed per URL; n-grams that make
up a thousandth of all characters or more, at most a thousand, are joined as a broadcast.

Rules name a host, which covers its subdomains, and a path prefix; the longest wins.

Defined results: null urls and urls without ``://`` have an empty host and path, match no
rule and are allowed; with no URL of one of the classes the method allows all; a score equal
to the threshold is allowed; repeated rows are judged alike; long URLs are read in segments;
an empty table gives an empty table; columns other than the id and the url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spark_io import cut, lower_ascii

ORDER = 4
ALPHABET = 256
SEGMENT = 256
FOLDS = 4
FALSE_BLOCKS = 0.02
#: N-grams that are one of so many characters or more are joined as a broadcast.
HOT = 1000
PAD = "\x02"
#: Words that mark hosts of rejected sites.
SEEDS = ("adult", "bets", "casino", "pills", "spam")
#: Fixed values: (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host_col: Column, path_col: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        site, slash, prefix = rule.partition("/")
        fits = ((host_col == site) | F.endswith(host_col, F.lit("." + site))) & F.startswith(path_col, F.lit(slash + prefix))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def ngrams(urls: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """All columns of ``urls`` and one row for each character with the ``order`` before it, padded at the start."""
    padded = F.concat(F.lit(PAD * order), F.col(text))
    parts = urls.withColumn("__part", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / SEGMENT)).cast("int")), lambda k: F.substring(padded, k * SEGMENT + 1, F.lit(SEGMENT + order)))))
    at = F.when(F.length("__part") > order, F.sequence(F.lit(1), F.length("__part") - order))
    return parts.withColumn("gram", F.explode(F.transform(at, lambda i: F.substring(F.col("__part"), i, F.lit(order + 1))))).drop("__part", text)


def model(grams: DataFrame, order: int = ORDER, alphabet: int = ALPHABET) -> DataFrame:
    """(gram, one column per column of counts of ``grams``): the logarithm of the probability of the gram's last character after those before it."""
    counts = [c for c in grams.columns if c != "gram"]
    below = None
    for k in range(order + 1):
        level = grams.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(*(F.sum(x).alias(x) for x in counts))
        context = level.groupBy(F.substring("gram", 1, k).alias("context")).agg(*(f.alias(n) for x in counts for f, n in ((F.sum(x), f"n_{x}"), (F.count_if(F.col(x) > 0), f"t_{x}"))))
        level = level.join(context, F.substring(level["gram"], 1, k) == context["context"])
        if below is not None:
            low = below.withColumnsRenamed({"gram": "low"} | {x: f"l_{x}" for x in counts})
            level = level.join(low, F.substring(level["gram"], 2, k) == low["low"])
        else:
            level = level.withColumns({f"l_{x}": F.lit(1.0 / alphabet) for x in counts})
        smooth = lambda x: F.when(F.col(f"n_{x}") > 0, (F.col(x) + F.col(f"t_{x}") * F.col(f"l_{x}")) / (F.col(f"n_{x}") + F.col(f"t_{x}"))).otherwise(F.col(f"l_{x}"))
        below = level.select("gram", *(smooth(x).alias(x) for x in counts))
    return below.select("gram", *(F.log(x).alias(x) for x in counts))


def fold_of(host_col: Column, folds: int = FOLDS) -> Column:
    """The fold of a host, from the first seven hexadecimal digits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(host_col.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(folds)).cast("int")


def score(urls: DataFrame, text: str = "url", seeds: tuple[str, ...] = SEEDS, folds: int = FOLDS) -> DataFrame:
    """(key, rejected, score) of each distinct URL; key is a hash of it."""
    address = F.regexp_extract(F.col(text), r"(?s)^.*?://(.*)$", 1)
    rejected = F.lit(False)
    for s in seeds:
        rejected = rejected | F.contains(host(F.col(text)), F.lit(s))
    one = urls.where(F.contains(F.col(text), F.lit("://"))).select(F.xxhash64(F.col(text)).alias("key"), lower_ascii(address).alias("address"), rejected.alias("rejected"), fold_of(host(F.col(text)), folds).alias("fold")).dropDuplicates(["key"])
    one = cut(one)
    positions = ngrams(one, "address")
    own = cut(positions.groupBy("gram").agg(F.count("*").alias("all"), F.count_if("rejected").alias("r"), *(F.count_if(~F.col("rejected") & (F.col("fold") == f)).alias(f"a{f}") for f in range(folds))))
    accepted = F.col("all") - F.col("r")
    # a fold's model counts the accepted URLs of the other folds
    logs = model(own.select("gram", "r", *((accepted - F.col(f"a{f}")).alias(f"a{f}") for f in range(folds))))
    every = own.agg(F.sum("all").alias("every"))
    ratios = cut(logs.select("gram", F.array(*(F.col(f"a{f}") - F.col("r") for f in range(folds))).alias("ratio")).join(own.select("gram", "all"), "gram").join(F.broadcast(every)).select("gram", "ratio", (F.col("all") * HOT >= F.col("every")).alias("hot")))
    met = positions.select("key", "fold", "gram").join(F.broadcast(ratios.where("hot").select("gram", F.col("ratio").alias("known"))), "gram", "left")
    part = lambda rows, c: rows.groupBy("key").agg(F.sum(F.get(c, F.col("fold"))).alias("s"), F.count("*").alias("c"))
    hot = part(met.where("known is not null"), "known")
    cold = part(met.where("known is null").select("key", "fold", "gram").join(ratios.where("not hot"), "gram"), "ratio")
    sums = hot.unionAll(cold).groupBy("key").agg((F.sum("s") / F.sum("c")).alias("score"))
    return cut(one.select("key", "rejected").join(sums, "key", "left").select("key", "rejected", F.coalesce("score", F.lit(0.0)).alias("score")))


def threshold(scores: DataFrame, false_blocks: float = FALSE_BLOCKS) -> float | None:
    """The largest thousandth, zero at most, that no more than a ``false_blocks`` of the accepted URLs score below; one number comes to the driver."""
    bucket = F.floor(F.col("score") * 1000).cast("long")
    counts = scores.groupBy(bucket.alias("bucket")).agg(F.count_if(~F.col("rejected")).alias("a"), F.count_if("rejected").alias("r"))
    # the window runs over thousandths of a score, whose number is bounded, not over URLs
    upto = counts.withColumns({"upto": F.sum("a").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)), "n_a": F.sum("a").over(W.partitionBy()), "n_r": F.sum("r").over(W.partitionBy())})
    found = upto.where((F.col("n_a") > 0) & (F.col("n_r") > 0)).agg(F.min(F.when(F.col("upto") > F.col("n_a") * false_blocks, F.col("bucket"))).alias("b")).head()["b"]
    return None if found is None else min(0.0, found / 1000)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, false_blocks: float = FALSE_BLOCKS) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    scores = score(rows, "url", seeds)
    limit = threshold(scores, false_blocks)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "key": F.when(F.contains("url", F.lit("://")), F.xxhash64("url"))}).drop("url").join(scores.drop("rejected"), "key", "left")
    method = F.when(F.col("score") < limit, "block").otherwise("allow") if limit is not None else F.lit("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
