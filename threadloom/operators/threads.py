"""Threads as tables: one row per thread, its brands, ordered posts, first messages, replies.

Input is the flat post table with ``thread_key`` from ``graph.assign_threads``. Thread-level values
are min/max/count aggregates that combine on the map side; a thread is never collected whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.functions.values import half_even, order_key
from threadloom.operators.bounded import number_rows
from threadloom.session import BROADCAST_BYTES, small_side, write_stage

DEFAULT_REPLY = presets.DEFAULT_REPLY
# A row of a long thread holds about this many bytes at most.
PART_BYTES = 64 << 20


class ConservationError(RuntimeError):
    """Posts were lost or duplicated on the way to threads."""


def _key() -> Column:
    return order_key(F.col("created_at"), F.col("post_id"))


def _thread_id(first: Column) -> Column:
    return F.concat(F.lit("T_"), first.cast("string"))


def thread_facts(posts: DataFrame) -> DataFrame:
    """One row per thread: id, length, branching, first and last time, customer and brand posts."""
    key = _key()
    return (
        posts.groupBy("thread_key")
        .agg(
            F.min(key).alias("first"),
            F.max(key).alias("last"),
            F.count(F.lit(1)).alias("thread_length"),
            F.bool_or("branching").alias("has_branching"),
            F.count_if("inbound").alias("customer_posts"),
            F.count_if(~F.col("inbound")).alias("brand_posts"),
            F.count_if(~F.col("inbound") & F.col("author_id").isNotNull()).alias("named_brand_posts"),
        )
        .select(
            "thread_key",
            _thread_id(F.col("first.id")).alias("thread_id"),
            "thread_length",
            "has_branching",
            F.when(~F.col("first.untimed"), F.col("first.at")).alias("start_time"),
            F.when(~F.col("last.untimed"), F.col("last.at")).alias("end_time"),
            "customer_posts",
            "brand_posts",
            "named_brand_posts",
        )
    )


def thread_brands(posts: DataFrame) -> DataFrame:
    """One row per thread and outbound author, with the posts that author wrote in the thread.

    Handles that differ only in letter case are one brand.
    """
    outbound = F.when(~F.col("inbound"), F.col("author_id"))
    return (
        posts.where(F.col("author_id").isNotNull())
        .groupBy("thread_key", F.lower("author_id").alias("brand_key"))
        .agg(F.min(outbound).alias("brand"), F.count(F.lit(1)).alias("brand_posts"))
        .where(F.col("brand").isNotNull())
    )


def build_threads(posts: DataFrame, chunk: int = 10_000, max_bytes: int = PART_BYTES) -> DataFrame:
    """Threads with their ordered posts as array columns.

    A thread of up to ``chunk`` posts and ``max_bytes`` is one row (``part`` 0). A longer one continues in further
    rows of the same ``thread_id``, in order, so every post is kept and no row grows without bound: a row holds up to ``chunk`` posts and
    ``max_bytes``, or up to half of that more than its last post if that one is larger than half.
    Everything about the thread as a whole (``thread_key``, ``brands``, ``thread_length``, ``has_branching``, the times)
    is the same in all its rows; ``part_length`` counts the posts of one row and adds up over the table.
    """
    sized = posts.withColumn("_bytes", post_bytes())
    long = _long_keys(sized, chunk, max_bytes)
    if long is None:
        return _short_threads(posts)
    return _short_threads(posts.join(long, "thread_key", "left_anti")).unionByName(
        _long_threads(sized.join(long, "thread_key", "left_semi"), chunk, max_bytes)
    )


def post_bytes() -> Column:
    """About how many bytes a post takes in a row of its thread."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("text", "author_id")), F.lit(128)).cast("bigint")


def _long_keys(sized: DataFrame, chunk: int, max_bytes: int) -> DataFrame | None:
    """Keys of the threads that take more than one row, if there are any."""
    sizes = sized.groupBy("thread_key").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("bytes"))
    long, seen = write_stage(sizes.where((F.col("n") > chunk) | (F.col("bytes") > max_bytes)).select("thread_key"), "long-threads")
    if seen["rows"] == 0:
        return None
    return F.broadcast(long) if 16 * seen["rows"] <= BROADCAST_BYTES else long


def _in_parts(sized: DataFrame, chunk: int, max_bytes: int) -> DataFrame:
    """Posts of long threads with their ``position`` and ``part``.

    A part starts where the count of earlier posts passes a multiple of ``chunk``, or their bytes one of half of ``max_bytes``. Both sums come
    from ranged slices; the parts themselves are few and are numbered apart from the posts.
    """
    numbered = number_rows(sized, ["thread_key"], [_key()], weight="_bytes", before="_before", max_weight=4 * max_bytes)
    cell = [F.floor(F.col("position") / F.lit(chunk)).alias("_rows"), F.floor(F.col("_before") / F.lit(max(1, max_bytes // 2))).alias("_half")]
    # Written, as posts of the same time and id could change places from one plan to the next.
    held, _ = write_stage(numbered.select("*", *cell).drop("_bytes", "_before"), "thread-parts")
    cells = held.select("thread_key", "_rows", "_half").distinct()
    parts = small_side(number_rows(cells, ["thread_key"], [F.col("_rows"), F.col("_half")], out="part"), "part-numbers")
    return held.join(parts, ["thread_key", "_rows", "_half"]).drop("_rows", "_half")


def _item() -> Column:
    fields = ["post_id", "author_id", "inbound", "created_at", "text", "in_response_to_id", "branching"]
    return F.struct(_key().alias("key"), *fields)


def _short_threads(posts: DataFrame) -> DataFrame:
    rows = posts.groupBy("thread_key").agg(F.array_sort(F.collect_list(_item())).alias("posts"))
    first, last = F.col("posts")[0], F.element_at("posts", -1)
    outbound = F.filter("posts", lambda p: ~p["inbound"] & p["author_id"].isNotNull())
    return rows.select(
        "thread_key",
        F.lit(0).cast("bigint").alias("part"),
        "posts",
        F.array_sort(F.array_distinct(F.transform(outbound, lambda p: p["author_id"]))).alias("brands"),
        _thread_id(first["post_id"]).alias("thread_id"),
        F.size("posts").cast("bigint").alias("thread_length"),
        F.exists("posts", lambda p: p["branching"]).alias("has_branching"),
        first["created_at"].alias("start_time"),
        last["created_at"].alias("end_time"),
    ).select(*_thread_columns())


def _long_threads(posts: DataFrame, chunk: int, max_bytes: int) -> DataFrame:
    rows = _in_parts(posts, chunk, max_bytes).groupBy("thread_key", "part").agg(F.array_sort(F.collect_list(_item())).alias("posts"))
    facts = thread_facts(posts).select("thread_key", "thread_id", "thread_length", "has_branching", "start_time", "end_time")
    # Distinct handles of the whole thread, combined on the map side.
    outbound = F.when(~F.col("inbound"), F.col("author_id"))
    brands = posts.groupBy("thread_key").agg(F.array_sort(F.collect_set(outbound)).alias("brands"))
    return rows.join(facts.join(brands, "thread_key"), "thread_key").select(*_thread_columns())


def _thread_columns() -> list[Column]:
    pick = lambda field: F.transform("posts", lambda p: p[field])
    return [
        F.col("thread_key"),
        F.col("thread_id"),
        F.col("part"),
        F.size("posts").cast("bigint").alias("part_length"),
        pick("post_id").alias("post_ids"),
        pick("author_id").alias("author_ids"),
        F.col("brands"),
        F.col("thread_length"),
        F.col("start_time"),
        F.col("end_time"),
        F.col("has_branching"),
        pick("inbound").alias("inbounds"),
        pick("text").alias("texts"),
        pick("created_at").alias("created_ats"),
        pick("in_response_to_id").alias("in_response_to_ids"),
        pick("branching").alias("branchings"),
    ]


def explode_threads(threads: DataFrame) -> DataFrame:
    """Back from array rows to the flat posts that they were built from."""
    zipped = F.arrays_zip("post_ids", "author_ids", "inbounds", "created_ats", "texts", "in_response_to_ids", "branchings")
    return threads.select("thread_key", F.explode(zipped).alias("p")).select(
        "thread_key",
        F.col("p.post_ids").alias("post_id"),
        F.col("p.author_ids").alias("author_id"),
        F.col("p.inbounds").alias("inbound"),
        F.col("p.created_ats").alias("created_at"),
        F.col("p.texts").alias("text"),
        F.col("p.in_response_to_ids").alias("in_response_to_id"),
        F.col("p.branchings").alias("branching"),
    )


def conservation(posts: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: posts in, posts in threads, and whether they agree."""
    before = posts.agg(F.count(F.lit(1)).alias("posts_in"))
    after = facts.agg(F.coalesce(F.sum("thread_length"), F.lit(0)).alias("posts_in_threads"))
    return before.select(
        "posts_in", F.lit(after.scalar()).cast("bigint").alias("posts_in_threads")
    ).withColumn("conserved", F.col("posts_in") == F.col("posts_in_threads"))


def assert_conserved(posts: DataFrame, facts: DataFrame, rejected: int = 0) -> None:
    """Raise unless every row of ``posts`` is in a thread or among the ``rejected`` ones."""
    row = conservation(posts, facts).first()
    if row["posts_in"] != row["posts_in_threads"] + rejected:
        raise ConservationError(f"{row['posts_in']} posts came in, threads hold {row['posts_in_threads']}, {rejected} were rejected")


def thread_stats(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.sum("thread_length").alias("total_posts"),
        F.count_if(F.col("thread_length") == 1).alias("single_message_threads"),
        F.count_if(F.col("thread_length") > 1).alias("multi_message_threads"),
        F.count_if("has_branching").alias("branching_threads"),
        F.count_if(F.col("named_brand_posts") > 0).alias("threads_with_brand"),
        F.min("thread_length").alias("min_thread_length"),
        F.max("thread_length").alias("max_thread_length"),
        half_even(F.avg("thread_length"), 2).alias("avg_thread_length"),
    )


def first_messages(posts: DataFrame, brand: str) -> DataFrame:
    """First customer post of each thread, with its 0-based index, raw and cleaned text.

    A thread whose first customer post is blank is left out; it does not advance to the second.
    The index is the number of (brand) posts before it, and only threads that a brand opened need
    to count those. The first posts are written before that count joins them, so that a thread
    with a third of all posts can be split.
    """
    key = _key()
    firsts = posts.groupBy("thread_key").agg(
        F.min(key).alias("opening"),
        F.min(F.when(F.col("inbound"), key)).alias("asked"),
        F.min_by(F.struct("post_id", "text"), F.when(F.col("inbound"), key)).alias("message"),
        F.count(F.lit(1)).alias("thread_length"),
    ).where(F.col("asked").isNotNull())
    firsts, _ = write_stage(firsts, "first-messages")
    late = firsts.where(F.col("asked.id") != F.col("opening.id")).select("thread_key", "asked")
    earlier = (
        posts.where(~F.col("inbound"))
        .select("thread_key", key.alias("at"))
        .join(late, "thread_key")
        .where(F.col("at") < F.col("asked"))
        .groupBy("thread_key")
        .agg(F.count(F.lit(1)).alias("before"))
    )
    raw = tx.strip(F.coalesce("message.text", F.lit("")))
    return (
        firsts.join(earlier, "thread_key", "left")
        .select(
            "thread_key",
            _thread_id(F.col("opening.id")).alias("thread_id"),
            F.col("message.post_id").alias("post_id"),
            F.coalesce("before", F.lit(0)).cast("int").alias("customer_msg_idx"),
            raw.alias("text"),
            tx.clean_text(raw, brand).alias("cleaned_text"),
            "thread_length",
            F.when(~F.col("opening.untimed"), F.col("opening.at")).alias("start_time"),
        )
        .where(F.length("text") > 0)
    )


def _by_brand(brand: str | None) -> Column:
    outbound = ~F.col("inbound")
    return outbound if brand is None else outbound | (F.col("author_id") == F.lit(brand))


def brand_replies(posts: DataFrame, brand: str | None = None, default: str = DEFAULT_REPLY) -> DataFrame:
    """First two non-empty brand replies of each thread joined by " | ", or the default sentence.

    Only each map task's two earliest replies per thread are shuffled (window group limit).
    """
    order = Window.partitionBy("thread_key").orderBy(_key())
    replies = (
        posts.where(_by_brand(brand))
        .select("thread_key", "created_at", "post_id", tx.strip_mentions(F.col("text")).alias("reply"))
        .where(F.length("reply") > 0)
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= 2)
    )
    joined = replies.groupBy("thread_key").agg(
        F.concat_ws(
            " | ",
            F.max(F.when(F.col("n") == 1, F.col("reply"))),
            F.max(F.when(F.col("n") == 2, F.col("reply"))),
        ).alias("reply")
    )
    threads = posts.groupBy("thread_key").agg(_thread_id(F.min(_key())["id"]).alias("thread_id"))
    return threads.join(joined, "thread_key", "left").select(
        "thread_key", "thread_id", F.coalesce("reply", F.lit(default)).alias("brand_reply_text")
    )


def last_brand_reply(posts: DataFrame) -> DataFrame:
    """Text of the last outbound post of each thread."""
    return posts.where(~F.col("inbound")).groupBy("thread_key").agg(
        F.max_by(tx.strip(F.col("text")), _key()).alias("historical_brand_reply")
    )


def _line() -> Column:
    speaker = F.when(F.col("inbound"), F.lit("Customer")).otherwise(
        F.concat(F.lit("Brand ("), F.col("author_id"), F.lit(")"))
    )
    return F.concat(F.lit("["), speaker, F.lit("]: "), tx.strip(F.coalesce("text", F.lit(""))))


def transcript_lines(posts: DataFrame) -> DataFrame:
    """One row per post: position in the thread and "[Speaker]: text"."""
    return number_rows(posts, ["thread_key"], [_key()]).select("thread_key", "position", _line().alias("line"))


def transcripts(posts: DataFrame, chunk: int = 10_000, max_bytes: int = PART_BYTES) -> DataFrame:
    """Full transcript per thread, one line per post, in rows of bounded size as in ``build_threads``."""
    sized = posts.select("thread_key", "post_id", "created_at", _line().alias("line")).withColumn("_bytes", F.coalesce(F.octet_length("line"), F.lit(0)).cast("bigint") + 1)
    joined = F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript")
    at_once = F.array_sort(F.collect_list(F.struct(_key().alias("key"), "line"))).alias("l")

    def short(lines: DataFrame) -> DataFrame:
        return lines.groupBy("thread_key").agg(at_once).select("thread_key", F.lit(0).cast("bigint").alias("part"), joined)

    long = _long_keys(sized, chunk, max_bytes)
    if long is None:
        return short(sized)
    parts = _in_parts(sized.join(long, "thread_key", "left_semi"), chunk, max_bytes)
    rows = parts.groupBy("thread_key", "part").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    return short(sized.join(long, "thread_key", "left_anti")).unionByName(rows.select("thread_key", "part", joined))


def parse_transcript(
    df: DataFrame, text: str = "transcript", keep: Sequence[str] = ("thread_key",), part: str | None = "part"
) -> DataFrame:
    """Transcript text back to turns: speaker by prefix, other lines become notes, blanks are skipped.

    ``line_no`` runs through all parts of a transcript; only line counts are shuffled to know where a part starts.
    A table without the column ``part`` (or ``part=None``) holds whole transcripts.
    """
    lines = F.split(F.col(text), "\n")
    if part is None or part not in df.columns:
        numbered = df.select(*keep, F.lit(0).alias("_start"), lines.alias("_lines"))
    else:
        before = Window.partitionBy(*keep).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        starts = df.select(*keep, part, F.size(lines).alias("_n")).select(
            *keep, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int").alias("_start")
        )
        numbered = df.select(*keep, part, lines.alias("_lines")).join(starts, [*keep, part]).drop(part)
    turns = numbered.select(*keep, "_start", F.posexplode("_lines").alias("_at", "raw")).withColumn("line", tx.strip(F.col("raw")))
    turns = turns.withColumn("line_no", F.col("_start") + F.col("_at"))
    customer = F.col("line").startswith("[Customer]:")
    brand = F.col("line").rlike(r"^\[Brand \([^\n]*\)\]:")
    said = F.when(customer, F.substring("line", 12, 2_000_000_000)).when(
        brand, F.regexp_replace("line", r"^\[Brand \([^\n]*?\)\]:", "")
    ).otherwise(F.col("line"))
    return turns.where(F.length("line") > 0).select(
        *keep,
        "line_no",
        F.when(customer, "Customer").when(brand, "Brand").otherwise("Note").alias("speaker"),
        customer.alias("is_customer"),
        tx.strip(said).alias("text"),
    )
