"""Queries on stratified draws, splits and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog.base import query, table
from threadloom.operators import sampling as sm
from threadloom.operators.bounded import hash_histogram, number_rows

SEED = 42
LANG_TARGETS = {"en": 300, "fr": 100, "de": 400, "es": 0, "pt": 5}


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def hashed(seed: int, alias: str = "doc_id") -> str:
    return f"md5('{seed}|' || CAST({alias} AS VARCHAR))"


SIZES = "sizes AS (SELECT lang, source, count(*) AS size FROM documents GROUP BY lang, source)"
ALLOCATED = f"""{SIZES},
base AS (SELECT *, greatest(1, least(size, CAST(round_even(150 * (size / (SELECT sum(size) FROM sizes)), 0) AS BIGINT))) AS b FROM sizes),
turns AS (SELECT *, 150 - sum(b) OVER () AS diff, count(*) OVER () AS k, row_number() OVER (ORDER BY size DESC, lang, source) - 1 AS place FROM base),
visited AS (SELECT *, CASE WHEN abs(diff) > place THEN (abs(diff) - 1 - place) // k + 1 ELSE 0 END AS v FROM turns),
quota AS (SELECT lang, source, size, CAST(CASE WHEN (SELECT sum(size) FROM sizes) <= 150 THEN size
  WHEN diff > 0 THEN least(size, b + v) ELSE greatest(1, b - v) END AS BIGINT) AS n FROM visited)"""


@query("allocation", f"WITH {ALLOCATED} SELECT lang, source, size, n FROM quota")
def allocation(spark, sf_dir):
    hist = hash_histogram(docs(spark, sf_dir), ["lang", "source"], "doc_id", SEED)
    return sm.allocate(sm.stratum_sizes(hist, ["lang", "source"]), ["lang", "source"], 150)


@query(
    "stratified_sample",
    f"""WITH {ALLOCATED}, ranked AS (SELECT doc_id, lang, source,
  row_number() OVER (PARTITION BY lang, source ORDER BY {hashed(42)}, doc_id) AS r FROM documents)
SELECT doc_id, lang, source FROM ranked JOIN quota USING (lang, source) WHERE r <= n""",
)
def stratified_sample(spark, sf_dir):
    return sm.stratified_sample(docs(spark, sf_dir), ["lang", "source"], 150, "doc_id", SEED).select("doc_id", "lang", "source")


def exact_sql(n: int) -> str:
    return f"""WITH {SIZES},
quota AS (SELECT *, least(size, greatest(1, CAST(round_even({n} * (size / (SELECT sum(size) FROM sizes)), 0) AS BIGINT))) AS n FROM sizes),
ranked AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {hashed(42)}, doc_id) AS r FROM documents),
drawn AS (SELECT doc_id FROM ranked JOIN quota USING (lang, source) WHERE r <= n),
trimmed AS (SELECT doc_id, row_number() OVER (ORDER BY {hashed(43)}, doc_id) AS r FROM drawn),
rest AS (SELECT doc_id, row_number() OVER (ORDER BY {hashed(44)}, doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM drawn))
SELECT doc_id FROM trimmed WHERE r <= {n} UNION ALL SELECT doc_id FROM rest WHERE r <= {n} - (SELECT count(*) FROM drawn)"""


@query("composite_sample_trimmed", exact_sql(90))
def composite_sample_trimmed(spark, sf_dir):
    return sm.exact_sample(docs(spark, sf_dir), ["lang", "source"], 90, "doc_id", SEED).select("doc_id")


@query("composite_sample_topped_up", exact_sql(333))
def composite_sample_topped_up(spark, sf_dir):
    return sm.exact_sample(docs(spark, sf_dir), ["lang", "source"], 333, "doc_id", SEED).select("doc_id")


HOLDOUT = f"""
sizes AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
base AS (SELECT *, greatest(1, CAST(round_even(100 * (size / (SELECT sum(size) FROM sizes)), 0) AS BIGINT)) AS b,
  row_number() OVER (ORDER BY size DESC, lang) AS place FROM sizes),
quota AS (SELECT lang, size, b + CASE WHEN place = 1 THEN 100 - (SELECT sum(b) FROM base) ELSE 0 END AS n FROM base),
ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hashed(42)}, doc_id) AS r FROM documents),
split AS (SELECT doc_id, lang, r <= n AS held FROM ranked JOIN quota USING (lang))"""


@query("holdout", f"WITH {HOLDOUT} SELECT doc_id, CASE WHEN held THEN 'holdout' ELSE 'indexable' END AS split FROM split")
def holdout(spark, sf_dir):
    held, rest = sm.holdout_split(docs(spark, sf_dir), ["lang"], 100, "doc_id", SEED)
    return held.select("doc_id", F.lit("holdout").alias("split")).unionByName(
        rest.select("doc_id", F.lit("indexable").alias("split"))
    )


@query(
    "split_report",
    f"""WITH {HOLDOUT}, l AS (SELECT lang, held FROM split UNION ALL SELECT 'TOTAL', held FROM split)
SELECT lang, count(*) AS total, count(*) FILTER (WHERE held) AS holdout, count(*) FILTER (WHERE NOT held) AS indexable,
  round_even(count(*) FILTER (WHERE held) * 100.0 / (SELECT count(*) FROM split WHERE held), 1) AS holdout_pct FROM l GROUP BY lang""",
)
def split_report(spark, sf_dir):
    from threadloom.operators.reports import split_report as report

    held, rest = sm.holdout_split(docs(spark, sf_dir), ["lang"], 100, "doc_id", SEED)
    return report(held, rest, "lang")


TARGETS_SQL = "targets AS (SELECT * FROM (VALUES ('en', 300), ('fr', 100), ('de', 400), ('es', 0), ('pt', 5)) t(lang, target))"
OPEN = f"""{TARGETS_SQL}, done AS (SELECT doc_id, lang FROM labels JOIN documents USING (doc_id)),
pool AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done)),
need AS (SELECT lang, CAST(target AS BIGINT) AS target, (SELECT count(*) FROM done d WHERE d.lang = t.lang) AS have,
  (SELECT count(*) FROM pool p WHERE p.lang = t.lang) AS available FROM targets t),
quota AS (SELECT *, greatest(0, target - have) AS needed, least(greatest(0, target - have), available) AS n FROM need)"""


def done_docs(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("quota_needs", f"WITH {OPEN} SELECT lang, target, have, available, needed, n, needed - n AS short FROM quota")
def quota_needs(spark, sf_dir):
    return sm.needed_per_label(docs(spark, sf_dir), done_docs(spark, sf_dir), LANG_TARGETS, "doc_id", "lang")


@query(
    "quota_topup",
    f"""WITH {OPEN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {hashed(42)}, doc_id) AS r FROM pool)
SELECT doc_id, lang FROM ranked JOIN quota USING (lang) WHERE r <= n""",
)
def quota_topup(spark, sf_dir):
    return sm.quota_topup(docs(spark, sf_dir), done_docs(spark, sf_dir), LANG_TARGETS, "doc_id", "lang", SEED).select("doc_id", "lang")


@query(
    "sample_targets",
    f"""WITH {TARGETS_SQL}, ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hashed(7)}, doc_id) AS r FROM documents)
SELECT doc_id, lang FROM ranked JOIN targets USING (lang) WHERE r <= target""",
)
def sample_targets(spark, sf_dir):
    return sm.sample_targets(docs(spark, sf_dir), LANG_TARGETS, "doc_id", "lang", 7).select("doc_id", "lang")


@query(
    "sample_per_group",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source,
  row_number() OVER (PARTITION BY source ORDER BY {hashed(42)}, doc_id) AS r FROM documents) WHERE r <= 5""",
)
def sample_per_group(spark, sf_dir):
    return sm.sample_per_group(docs(spark, sf_dir), "source", 5, "doc_id", SEED).select("doc_id", "source")


@query(
    "shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY {hashed(42)}, doc_id) - 1 AS place FROM documents",
)
def shuffle(spark, sf_dir):
    from threadloom.functions.values import hash_order

    rows = docs(spark, sf_dir).select("doc_id", hash_order(F.col("doc_id"), SEED).alias("h"), F.lit(1).alias("all"))
    return number_rows(rows, ["all"], [F.col("h"), F.col("doc_id")], out="place", max_group=500).select("doc_id", "place")


@query(
    "quality_report",
    """SELECT 'text_present' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(length(text) > 0, false)) AS failures FROM documents
UNION ALL SELECT 'known_language', count(*), count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) FROM documents
UNION ALL SELECT 'size_range', count(*), count(*) FILTER (WHERE n_chars NOT BETWEEN 20 AND 5000) FROM documents""",
)
def quality_report(spark, sf_dir):
    return sm.quality_report(
        table(spark, sf_dir, "documents"),
        {
            "text_present": F.length("text") > 0,
            "known_language": F.col("lang").isin("en", "fr"),
            "size_range": F.col("n_chars").between(20, 5000),
        },
    )
