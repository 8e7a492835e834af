"""Queries that write a table in one of the supported formats and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import views
from threadloom.catalog.base import query, table
from threadloom.catalog.messages import raw_posts
from threadloom.catalog.views import WITH_POSTS
from threadloom.operators.messages import first_per_group
from threadloom.session import stage_path, write_stage
from threadloom.sources import posts as src
from threadloom.sources import tables, taxonomy


# A quote inside an unquoted field, which is text, and one closed before the field ends.
STRAY, CLOSED, QUOTES = 'my 5" screen ', '"so called" screen ', '"' * 3


@query(
    "csv_posts",
    f"""{WITH_POSTS}, k AS (SELECT *, (post_id // 100) % 17 AS kind,
  translate(text, ',"' || chr(10) || chr(13), ';   ') AS bare FROM posts)
SELECT CASE WHEN kind <> 3 THEN post_id END AS post_id, author_id, inbound, CASE WHEN kind > 1 THEN created_s END AS created_at,
  md5(CASE WHEN kind = 4 THEN NULL WHEN kind = 5 AND response_ids IS NULL THEN '{STRAY}' || bare
    WHEN kind = 6 AND response_ids IS NULL THEN '{CLOSED}' || bare || '.' WHEN kind = 7 THEN text || chr(10) || '{QUOTES}' ELSE text END) AS text,
  response_ids, in_response_to_id FROM k""",
)
def csv_posts(spark, sf_dir):
    """Posts as a CSV export with quoted line breaks, stray and doubled quotes, its columns in another order and one more, read, checked and typed."""
    path = stage_path(spark, "csv-posts")
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    bare = F.translate("text", ',"\n\r', ";   ")
    kind = F.floor(F.regexp_extract("tweet_id", r"(\d+)$", 1).cast("bigint") / 100) % 17
    # A list of ids holds commas and needs its quotes.
    unquoted = F.col("response_tweet_id").isNull() & F.coalesce(kind.isin(5, 6), F.lit(False))
    odd = (
        F.when(unquoted & (kind == 5), F.concat(F.lit(STRAY), bare))
        .when(unquoted, F.concat(F.lit(CLOSED), bare, F.lit(".")))
        .when(kind == 7, F.concat("text", F.lit("\n" + QUOTES)))
        .otherwise(F.col("text"))
    )
    raw = raw_posts(spark, sf_dir).withColumns({"text": odd, "unquoted": unquoted})
    columns = [*reversed(src.RAW_COLUMNS), F.lit("x").alias("extra")]
    written = {True: {"escape": '"'}, False: {"quote": "\0", "escape": "\0"}}
    for quoted, how in written.items():
        rows = raw.where(F.col("unquoted") != quoted).select(*columns)
        rows.write.mode("append").options(**keep, **how).option("header", True).csv(path)
    back = src.read_posts_csv(spark, path)
    src.validate_schema(back)
    return src.to_posts(back).withColumns({"created_at": F.unix_seconds("created_at"), "text": F.md5("text")})


@query(
    "json_documents",
    "SELECT doc_id, lang, md5(text) AS text, CAST(n_chars AS BIGINT) AS n_chars FROM documents",
)
def json_documents(spark, sf_dir):
    """Records with a nested field, half of them one per line, half as one JSON list per file."""
    schema = "doc_id bigint, lang string, body struct<text:string,n_chars:bigint>"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.struct("text", "n_chars").alias("body"))
    lines, lists = stage_path(spark, "json-lines"), stage_path(spark, "json-lists")
    # By a hash, so that rows without an id and negative ids have their place too.
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    tables.write_results_json(docs.where(side == 0), lines)
    # A document holds the records of a slice of rows: about a thousand, whatever ids they have.
    odd, seen = write_stage(docs.where(side == 1), "json-odd")
    odd = odd.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(1 + seen["rows"] // 1000)).alias("part"))
    listed = odd.agg(F.collect_list(F.struct("doc_id", "lang", "body")).alias("records"))
    # Over several lines, as a pretty-printed document is.
    written = listed.select("part", F.regexp_replace(F.to_json("records"), "^\\[", "[\n").alias("value"))
    written.write.partitionBy("part").text(lists)
    both = tables.read_results_json(spark, lines, schema).unionByName(
        tables.read_json_document(spark, lists, schema).select("doc_id", "lang", "body")
    )
    return both.select("doc_id", "lang", F.md5("body.text").alias("text"), "body.n_chars")


@query(
    "event_log",
    "SELECT event_type, 2 * count(*) AS entries, min(event_id) AS first_event FROM events GROUP BY event_type",
)
def event_log(spark, sf_dir):
    """Events appended twice to a JSON-lines log."""
    path = stage_path(spark, "event-log")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for _ in range(2):
        tables.append_event_log(events, path)
    log = spark.read.schema(events.schema).json(path)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"), F.min("event_id").alias("first_event"))


@query(
    "stats_log",
    f"""{WITH_POSTS}, s AS (SELECT 'documents' AS step, count(*) AS rows, sum(n_chars) AS size FROM documents
  UNION ALL SELECT 'posts', count(*), sum(length(text)) FROM posts)
SELECT step, 'rows' AS metric, CAST(rows AS VARCHAR) AS value FROM s UNION ALL SELECT step, 'size', CAST(size AS VARCHAR) FROM s""",
)
def stats_log(spark, sf_dir):
    """Statistics of two steps, the first one recorded twice; the latest recording counts."""
    path = stage_path(spark, "stats-log")
    docs, posts = table(spark, sf_dir, "documents"), views.posts(spark, sf_dir)
    size = lambda df, length: df.agg(F.count(F.lit(1)).alias("rows"), F.sum(length).alias("size"))
    tables.record_stats(size(posts, F.length("text")), path, "documents")
    tables.record_stats(size(docs, F.col("n_chars")), path, "documents")
    tables.record_stats(size(posts, F.length("text")), path, "posts")
    return tables.latest_stats(spark.read.parquet(path)).select("step", "metric", "value")


@query(
    "partitioned_table",
    "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang",
)
def partitioned_table(spark, sf_dir):
    """A Parquet table by language, read with two columns and two partitions."""
    path = stage_path(spark, "by-language")
    tables.write_table(table(spark, sf_dir, "documents"), path, ["lang"])
    back = tables.read_table(spark, path, ["lang", "n_chars"]).where(F.col("lang").isin("en", "fr"))
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query(
    "csv_report",
    "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang",
)
def csv_report(spark, sf_dir):
    """A report as one CSV file with a header, read back."""
    path = stage_path(spark, "report")
    docs = table(spark, sf_dir, "documents")
    tables.write_report_csv(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")), path)
    return spark.read.option("header", True).schema("lang string, docs bigint, chars bigint").csv(path)


@query(
    "taxonomy_table",
    """SELECT lang AS intent, 'texts in ' || lang AS description, lang = 'de' AS escalate,
  string_agg(CAST(doc_id AS VARCHAR) || ':' || md5(text), ',' ORDER BY doc_id) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY lang""",
)
def taxonomy_table(spark, sf_dir):
    """A taxonomy of languages with their first texts, saved as YAML in the shared folder and loaded again."""
    path = stage_path(spark, "taxonomy") + "/taxonomy.yaml"
    first = first_per_group(table(spark, sf_dir, "documents"), ["lang"], ["doc_id"], 3)
    example = F.struct(F.col("doc_id").cast("string").alias("post_id"), "text")
    intents = first.groupBy(F.col("lang").alias("intent")).agg(F.array_sort(F.collect_list(F.struct("rank", example.alias("e")))).alias("found"))
    named = intents.select(
        "intent", F.concat(F.lit("texts in "), "intent").alias("description"), (F.col("intent") == "de").alias("escalate"),
        F.transform("found", lambda x: x["e"]).alias("examples"),
    )
    taxonomy.save_taxonomy(named, path, source="languages")
    shown = F.transform("examples", lambda e: F.concat(e["post_id"], F.lit(":"), F.md5(e["text"])))
    return taxonomy.load_taxonomy(spark, path).select("intent", "description", "escalate", F.array_join(shown, ",").alias("examples"))


@query(
    "rejected_posts",
    f"""{WITH_POSTS}, k AS (SELECT *, (post_id // 100) % 17 AS kind FROM posts)
SELECT 'id' || CAST(post_id AS VARCHAR) AS tweet_id, author_id, md5(CASE WHEN kind <> 4 THEN text END) AS text,
  (SELECT count(*) FROM k) AS rows_in, (SELECT count(*) FROM k WHERE kind <> 3) AS rows_kept FROM k WHERE kind = 3""",
)
def rejected_posts(spark, sf_dir):
    """Posts without a readable id, and the counts that must add up."""
    raw = raw_posts(spark, sf_dir)
    rejected, kept = src.rejected_posts(raw), src.to_posts(raw).where(F.col("post_id").isNotNull())
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return rejected.select(
        "tweet_id", "author_id", F.md5("text").alias("text"), count(raw).alias("rows_in"), count(kept).alias("rows_kept")
    )
