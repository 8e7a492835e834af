"""Line dedup by the number of distinct sites a line appears on.

Every line is known by a 128-bit hash. A HyperLogLog sketch of the sites is built per line in the map tasks and merged by the
aggregation, so a line that is on half of all pages costs one sketch a task. Lines whose estimate is clearly
above or below the threshold are decided by it; those near it get an exact distinct count. The
sketches are exact for few sites and have a standard error of 1.6 % beyond, and the band is 20 %,
so the result is that of exact counts.

Lines on at least ``min_sites`` sites are boilerplate. Their first occurrence, by document id and then by content,
stays, so that no text is lost with all of its copies; all others go.

Defined cases: a line is compared without leading and trailing spaces, tabs and carriage returns; blank lines are never
counted or removed, unless repeats around them leave the text without any line. A null site proves no spread, but its documents are cleaned
like all others. A null text stays null, an empty one empty. A document is its id and text: repeated rows are cleaned alike. Within a document
a boilerplate line stays once at most. A very long line is hashed like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import small_side, write_stage

MIN_SITES = 5
# Estimates within this share of the threshold are counted exactly.
BAND = 0.2
LG_SKETCH = 12
EDGE = " \t\r"


def line_key(line: Column) -> Column:
    """128-bit hash of a line, as a struct of two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def document_key(key: Column, text: Column) -> Column:
    return F.struct(F.xxhash64(key, text).alias("a"), F.xxhash64(F.lit(7), key, text).alias("b"))


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGE))


def line_rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(doc, id, pos, line, site) of every line that is not blank."""
    lines = docs.select(
        document_key(F.col(key), F.col(text)).alias("doc"),
        F.col(key).alias("id"),
        F.xxhash64(site).alias("site") if site else F.lit(None).cast("bigint").alias("site"),
        F.col(site).isNotNull().alias("known"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "content"),
    )
    return lines.where(bare(F.col("content")) != "").select(
        "doc", "id", "pos", line_key(bare(F.col("content"))).alias("line"), F.when(F.col("known"), F.col("site")).alias("site")
    )


def wide_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line): lines on at least ``min_sites`` distinct sites."""
    spread, _ = write_stage(
        lines.where(F.col("site").isNotNull())
        .groupBy("line")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_SKETCH)).alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - BAND)),
        "line-spread",
    )
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("line")
    exact = (
        lines.where(F.col("site").isNotNull())
        .join(near, "line", "left_semi")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line")
    )
    return sure.unionByName(exact)


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source", keep_first: bool = True
) -> DataFrame:
    """``docs`` with cleaned texts and the columns ``n_lines`` and ``n_removed`` (lines that are not blank).

    Columns of ``docs`` with these two names are replaced; all others stay.
    """
    lines, _ = write_stage(line_rows(docs, key, text, site), "line-rows")
    # One row per boilerplate line. As long as they fit, they travel to the lines: a line on half of all pages is then in no one task.
    wide = small_side(wide_lines(lines, min_sites), "line-wide")
    hits, _ = write_stage(lines.join(wide, "line", "left_semi").select("doc", "id", "pos", "line"), "line-hits")
    # The first occurrence: smallest id (null last), then smallest document hash, then first position.
    # Two aggregates of plain numbers, as a minimum over structs would sort all rows.
    owner = small_side(hits.groupBy("line").agg(F.min("id").alias("first")), "line-first-ids")
    at = hits.join(owner, "line").where(F.col("id").eqNullSafe(F.col("first")))
    owner = small_side(at.groupBy("line").agg(F.min("doc.a").alias("doc_a")), "line-owners")
    marked = hits.join(owner, "line").select(
        "doc", "pos", (F.lit(keep_first) & (F.col("doc.a") == F.col("doc_a"))).alias("own"), "line"
    )
    first_pos = marked.where("own").groupBy("doc", "line").agg(F.min("pos").alias("keep"))
    marked = marked.join(first_pos, ["doc", "line"], "left")
    gone = marked.where(~F.coalesce(F.col("own") & (F.col("pos") == F.col("keep")), F.lit(False))).groupBy("doc").agg(F.collect_set("pos").alias("gone"))

    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    packed = packed.withColumn("doc", document_key(F.col(f"row.{key}"), F.col(f"row.{text}")))
    joined = packed.join(gone, "doc", "left")
    parts = F.split(F.col(f"row.{text}"), "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains("gone", i))
    joined = joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col(f"row.{text}"))
        .when(F.forall(kept, lambda line: bare(line) == ""), F.lit(""))
        .otherwise(F.array_join(kept, "\n"))
        .alias("clean"),
        F.coalesce(F.size(F.filter(parts, lambda line: bare(line) != "")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
    columns = [(F.col("clean") if c == text else F.col(f"row.{c}")).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, "n_lines", "n_removed")
