"""URL filter: rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

The trees learn from the urls that a rule judges: block is 1, allow is 0. Features are lengths, path depth, digit ratio, character
entropy, parameter counts, and statistics of the host's suffixes (its last label, and its last two): how many
urls of the table end so, and which share of the labelled ones is blocked. Everything is DataFrame expressions and Spark ML.

At most about ``SAMPLE`` labelled urls train the trees, drawn by a hash of the url; the suffix statistics cover all rows.

Defined cases: a null url, and one without ``://``, has an empty host and path, fits no rule, and is judged by the method like any other.
If the labelled urls hold one verdict only, or there are none, the method allows everything. Rules are few enough to be
written into the plan, as they are a parameter. Of rules of equal length that fit, the first by code point wins. Repeated rows are judged alike. Extra columns
are ignored. Very long urls are handled like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import small_side, write_stage

# (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Labelled urls that the trees learn from.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A suffix's share of blocked urls counts as if it had so many more urls of the overall share.
PRIOR = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "dash_ratio",
    "entropy", "parameters", "has_fragment", "has_port", "tld_urls", "tld_block", "site_urls", "site_block",
)


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; '' for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if there is none. A rule fits its host and all subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    rule = F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered)])
    verdict = F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered)])
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits. Equal characters are runs of the sorted characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    runs = F.split(F.regexp_replace(F.array_join(F.array_sort(chars), ""), r"(?s)(.)(?!\1)", "$1\u0001"), "\u0001")
    sizes = F.transform(runs, lambda r: F.length(r) / n)
    return F.when(n > 0, F.aggregate(sizes, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, h, host, path, rule, ruled, tld, site) and the features of the url itself."""
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    u, size = F.col("url"), F.greatest(F.length("url"), F.lit(1))
    query = F.regexp_extract("url", r"(?s)\?([^#]*)", 1)
    double = lambda c: c.cast("double")
    return rows.select(
        "page_id",
        F.xxhash64("url").alias("h"),
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("ruled"),
        F.substring_index("host", ".", -1).alias("tld"),
        F.substring_index("host", ".", -2).alias("site"),
        double(F.length(u)).alias("url_length"),
        double(F.length("host")).alias("host_length"),
        double(F.length("path")).alias("path_length"),
        double(F.length(query)).alias("query_length"),
        _count(F.col("path"), "/").alias("depth"),
        (_count(F.col("host"), r"\.") + 1).alias("host_labels"),
        (_count(u, "[0-9]") / size).alias("digit_ratio"),
        (_count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1))).alias("host_digit_ratio"),
        (_count(u, "[-_]") / size).alias("dash_ratio"),
        _entropy(u).alias("entropy"),
        (_count(query, "&") + (F.length(query) > 0).cast("double")).alias("parameters"),
        double(u.contains("#").cast("int")).alias("has_fragment"),
        double(F.col("host").contains(":").cast("int")).alias("has_port"),
    )


def with_suffixes(rows: DataFrame) -> DataFrame:
    """Add tld_urls, tld_block, site_urls, site_block."""
    blocked, labelled = F.sum((F.col("ruled") == "block").cast("double")), F.count("ruled")
    overall = rows.agg(F.coalesce(blocked / labelled, F.lit(0.5))).first()[0] if rows.take(1) else 0.5
    for name in ("tld", "site"):
        share = (F.coalesce(blocked, F.lit(0.0)) + PRIOR * overall) / (labelled + PRIOR)
        stats = rows.groupBy(name).agg(F.log1p(F.count(F.lit(1))).alias(f"{name}_urls"), share.alias(f"{name}_block"))
        rows = rows.join(small_side(stats, f"url-{name}"), name)
    return rows


def fit(rows: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> GBTClassificationModel | None:
    """Trees learned from the rows that a rule judges; None if these hold fewer than two verdicts."""
    labelled = rows.where(F.col("ruled").isNotNull())
    seen = {r["ruled"]: r["count"] for r in labelled.groupBy("ruled").count().collect()}
    if len(seen) < 2:
        return None
    share = min(1.0, sample / sum(seen.values()))
    drawn = labelled.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.select((F.col("ruled") == "block").cast("double").alias("label"), *FEATURES)
    drawn, kept = write_stage(drawn.repartition(4, *FEATURES), "url-sample", blocked=F.sum("label"))
    if kept["rows"] == 0 or kept["blocked"] in (0, kept["rows"]):
        return None
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(drawn).select("label", "features")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=64).fit(ready)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; ``score`` is the trees' chance of block, null without trees."""
    rows, _ = write_stage(lexical(pages, key, url, rules), "url-features")
    rows = with_suffixes(rows)
    model = fit(rows, sample)
    if model is None:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
