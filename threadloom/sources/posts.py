"""Raw posts: CSV scan, schema check, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.values import parse_post_time, percent, to_id
from threadloom.session import small_side, write_stage

# Column names of the raw export, in file order.
RAW_COLUMNS = (
    "tweet_id",
    "author_id",
    "inbound",
    "created_at",
    "text",
    "response_tweet_id",
    "in_response_to_tweet_id",
)


# Bytes of the lines of one record, above which a quote that was never closed is suspected.
RECORD_BYTES = 64 << 20


class SchemaError(ValueError):
    """The table lacks required columns or has no rows."""


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line."""
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path).columns


# Characters of a line that decide where records end: any other, a quote, a comma. States: at the start of a field, in an unquoted
# field, within quotes, after a quote within quotes. A quote opens only at the start of a field; a quote within quotes that neither
# ends the field nor is doubled makes the field an unquoted one.
_STEPS = ((1, 2, 0), (1, 1, 0), (2, 3, 2), (1, 2, 0))


def _quote_ends(line: Column) -> Column:
    """Whether a line ends within quotes, as two bits: bit 0 if it starts a record, bit 1 if it starts within quotes."""
    pairs = [[_STEPS[a][c] * 4 + _STEPS[b][c] for c in range(3)] for a in range(4) for b in range(4)]
    table = F.array(*[F.lit(x) for row in pairs for x in row])
    kept = F.regexp_replace(F.regexp_replace(line, "\r$", ""), '[^",]+', "x")
    kind = lambda c: F.when(c == '"', 1).when(c == ",", 2).otherwise(0)
    # The empty string is no character; both start states are followed at once.
    end = F.aggregate(F.filter(F.split(kept, ""), lambda c: c != ""), F.lit(2), lambda s, c: F.element_at(table, s * 3 + kind(c) + 1))
    within = (F.floor(end / 4) == 2).cast("int") + (end % 4 == 2).cast("int") * 2
    return F.when(F.contains(line, F.lit('"')), within).otherwise(2)


def _states_before(df: DataFrame, within: Sequence[str], order: str, ends: str) -> DataFrame:
    """Add ``before0`` and ``before1``: whether a row starts within quotes, if the first row of its group does not, or does.

    A row maps the state it starts in to the one it ends in. The maps of the rows before compose to the value of the last constant
    one, turned over as often as a map after it turns the state over.
    """
    rows = Window.partitionBy(*within).orderBy(order)
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col(ends) == 1).cast("int")
    constant = F.when(F.col(ends).isin(0, 3), F.struct((F.col(ends) == 3).cast("int").alias("value"), F.col("_turned")))
    counted = df.withColumn("_turned", F.sum(turns).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    last = counted.withColumn("_last", F.last(constant, ignorenulls=True).over(earlier)).withColumn("_turned", F.col("_turned") - turns)
    since = F.coalesce(F.col("_last.value") + F.col("_turned") - F.col("_last._turned"), F.col("_turned"))
    free = F.col("_last").isNull().cast("int")
    return last.withColumns({"before0": since % 2, "before1": (since + free) % 2}).drop("_turned", "_last")


def csv_records(spark: SparkSession, path: str, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """One row (record) per CSV record, headers left out, whatever line breaks its quoted fields hold.

    Files are read in blocks by many tasks. Every line, and so every block, maps the state it may start in (a new record, or within
    quotes) to the state it ends in; composing the blocks' maps tells the state each block really starts in. Only lines of records with
    line breaks are shuffled, to meet the rest of their record. A quote inside an unquoted field is text. A quote that is
    never closed takes the rest of its file into its record, which is refused above ``record_bytes``.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines, _ = write_stage(
        read.select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            _quote_ends(F.col("value")).alias("ends"),
        ),
        "csv-lines",
    )
    ended = lambda start: F.when(start == 0, F.col("ends") % 2).otherwise((F.col("ends") >= 2).cast("int"))
    counted = _states_before(lines, ["file", "block"], "at", "ends")
    # Per block and for either state that it may start in: how many records start, and whether it ends within quotes.
    starts = [F.count_if(F.col(f"before{s}") == 0).alias(f"starts{s}") for s in (0, 1)]
    last = [F.max_by(ended(F.col(f"before{s}")), "at") for s in (0, 1)]
    crlf = F.min_by(F.endswith("line", F.lit("\r")), "at").alias("crlf")
    blocks = counted.groupBy("file", "block").agg((last[0] + last[1] * 2).alias("ends"), crlf, *starts)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _states_before(blocks, ["file"], "block", "ends").withColumnRenamed("before0", "state")
    begun = F.when(F.col("state") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    # A file whose first line ends in CRLF has its line breaks within quotes read as LF.
    crlf = F.first("crlf").over(Window.partitionBy("file").orderBy("block"))
    base = F.coalesce(F.sum(begun).over(earlier), F.lit(0))
    blocks = small_side(blocks.select("file", "block", "state", base.alias("base"), crlf.alias("crlf")), "csv-blocks")
    upto = Window.partitionBy("file", "block").orderBy("at")
    before = F.when(F.col("state") == 0, F.col("before0")).otherwise(F.col("before1"))
    placed = counted.join(blocks, ["file", "block"]).withColumn("opens", before == 0)
    placed = placed.withColumn("record", F.col("base") + F.sum(F.col("opens").cast("int")).over(upto))
    alone = F.col("opens") & F.col("ends").isin(0, 2)
    parts, _ = write_stage(placed.where(~alone).select("file", "record", "block", "at", F.when(F.col("crlf"), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line")).alias("line")), "csv-parts")
    grouped = parts.groupBy("file", "record")
    too_long = grouped.agg(F.sum(F.octet_length("line")).alias("bytes")).where(F.col("bytes") > record_bytes).first()
    if too_long is not None:
        raise SchemaError(f"record {too_long['record']} of {too_long['file']} has {too_long['bytes']} bytes: a quote may not be closed")
    several = grouped.agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts")).select(
        "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text")
    )
    single = placed.where(alone).select("record", F.col("line").alias("text"))
    # Every file starts with its header; a record may end in the carriage return of a CRLF file.
    whole = single.unionByName(several).where(F.col("record") > 1).select(F.regexp_replace("text", "\r$", "").alias("record"))
    return whole.where(F.col("record") != "")


def read_posts_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The raw export, every column as text, selected by its name in the header; quoted line breaks are kept.

    Rows are those of Spark's reader of whole files. Odd quotes at the very end of a record, and line breaks at the end of a file
    in a field that is never closed, may be missing from the field's text. A file that lacks a required column is refused. All files must have the header of the first. Large files are split
    among tasks. ``multi_line=False`` spares the search for record ends where no text holds a line break.
    """
    names = csv_columns(spark, path)
    require_columns(names)
    if not multi_line:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
        return reader.csv(path).select(*RAW_COLUMNS)
    headers = spark.read.option("lineSep", "\n").text(path).where(F.col("_metadata.file_block_start") == 0)
    first = Window.partitionBy("file").orderBy("at")
    headers = headers.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    different = headers.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.regexp_replace("value", "\r$", "")).distinct().limit(2)
    if different.count() > 1:
        raise SchemaError("the files have different headers")
    parsed = F.from_csv("record", ", ".join(f"`{name}` string" for name in names), {"escape": '"'})
    return csv_records(spark, path).select(parsed.alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in RAW_COLUMNS])


def to_posts(raw: DataFrame) -> DataFrame:
    """Raw columns to the typed post table that the operators use."""
    return raw.select(
        to_id(F.col("tweet_id")).alias("post_id"),
        "author_id",
        (F.lower(F.trim("inbound")) == "true").alias("inbound"),
        parse_post_time(F.col("created_at")).alias("created_at"),
        "text",
        F.col("response_tweet_id").alias("response_ids"),
        to_id(F.col("in_response_to_tweet_id")).alias("in_response_to_id"),
    )


def rejected_posts(raw: DataFrame) -> DataFrame:
    """Raw rows that ``to_posts`` gives no id; no operator can use them."""
    return raw.where(to_id(F.col("tweet_id")).isNull())


def require_columns(found: Sequence[str], required: Sequence[str] = RAW_COLUMNS) -> None:
    missing = [name for name in required if name not in found]
    if missing:
        raise SchemaError(f"missing required column(s) {missing}; found {list(found)}")


def validate_schema(df: DataFrame, required: Sequence[str] = RAW_COLUMNS) -> None:
    """Raise unless every required column is there and at least one row is."""
    require_columns(df.columns, required)
    if df.isEmpty():
        raise SchemaError("the table has no rows")


def profile_posts(raw: DataFrame) -> DataFrame:
    """One row: counts and shares, date range, NULLs per column, malformed dates and ids.

    A single aggregate over one scan; nothing but counters and the date range is shuffled.
    """
    at = parse_post_time(F.col("created_at"))
    inbound = F.coalesce(F.lower(F.trim(F.col("inbound").cast("string"))) == "true", F.lit(False))
    counted = raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(inbound).alias("inbound_count"),
        F.count_if(~inbound).alias("outbound_count"),
        F.unix_seconds(F.min(at)).alias("min_time"),
        F.unix_seconds(F.max(at)).alias("max_time"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in RAW_COLUMNS],
        F.count_if(at.isNull()).alias("malformed_dates"),
        F.count_if(to_id(F.col("tweet_id")).isNull()).alias("malformed_ids"),
    )
    total = F.col("total_rows")
    return counted.withColumns(
        {
            "inbound_pct": percent(F.col("inbound_count"), total),
            "outbound_pct": percent(F.col("outbound_count"), total),
        }
    )
