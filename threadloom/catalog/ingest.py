"""Queries on posts, threads, resolution and brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import views
from threadloom.catalog.base import query
from threadloom.catalog.views import WITH_POSTS, WITH_THREADED
from threadloom.operators import graph, resolve, threads
from threadloom.session import stage_path


def epoch(col: str):
    return F.unix_seconds(col).alias(col)


@query("reply_edges", f"WITH {views.POSTS}, {views.EDGES} SELECT src, dst, via FROM edges")
def reply_edges(spark, sf_dir):
    return graph.reply_edges(views.posts(spark, sf_dir))


@query(
    "components",
    f"WITH RECURSIVE {views.POSTS}, {views.EDGES}, {views.COMPONENTS} "
    "SELECT post_id, thread_key AS component FROM component",
)
def components(spark, sf_dir):
    posts = views.posts(spark, sf_dir)
    found = graph.connected_components(graph.reply_edges(posts)).withColumnRenamed("node", "post_id")
    return posts.select("post_id").join(found, "post_id", "left").select(
        "post_id", F.coalesce("component", "post_id").alias("component")
    )


@query(
    "components_incremental",
    f"WITH RECURSIVE {views.POSTS}, {views.EDGES}, {views.COMPONENTS} "
    "SELECT post_id, thread_key AS component FROM component",
)
def components_incremental(spark, sf_dir):
    """The same components from three loads, which split threads; every state but the last is stored and read again."""
    posts = views.posts(spark, sf_dir)
    load, state = F.pmod(F.xxhash64("post_id"), F.lit(3)), graph.ThreadState.empty(spark)
    for number in range(3):
        state = graph.add_posts(state, posts.where(load == number))
        if number < 2:
            path = stage_path(spark, "thread-state")
            state.write(path)
            state = graph.ThreadState.read(spark, path)
    return state.threads.select("post_id", F.col("thread_key").alias("component"))


@query(
    "branching",
    f"WITH {views.POSTS}, {views.FORKS} SELECT post_id, in_response_to_id, "
    "fork IS NOT NULL AS branching FROM posts LEFT JOIN forks ON fork = in_response_to_id",
)
def branching(spark, sf_dir):
    return graph.flag_branching(views.posts(spark, sf_dir)).select("post_id", "in_response_to_id", "branching")


@query(
    "threads",
    f"""{WITH_THREADED}
SELECT 'T_' || CAST(arg_min(post_id, position) AS VARCHAR) AS thread_id, CAST(0 AS BIGINT) AS part,
  string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY position) AS post_ids,
  string_agg(author_id, ',' ORDER BY position) AS author_ids,
  coalesce(string_agg(DISTINCT author_id, ',' ORDER BY author_id) FILTER (WHERE NOT inbound), '') AS brands,
  count(*) AS thread_length, arg_min(created_s, position) AS start_time, arg_max(created_s, position) AS end_time,
  bool_or(branching) AS has_branching,
  string_agg(CAST(inbound AS VARCHAR), ',' ORDER BY position) AS inbounds,
  md5(string_agg(text, '|' ORDER BY position)) AS texts,
  string_agg(coalesce(CAST(in_response_to_id AS VARCHAR), '-'), ',' ORDER BY position) AS in_response_to_ids
FROM threaded GROUP BY thread_key""",
)
def threads_query(spark, sf_dir):
    rows = threads.build_threads(views.threaded(spark, sf_dir))
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",", "-").alias(c)
    return rows.select(
        "thread_id", "part", ids("post_ids"), ids("author_ids"), ids("brands"), "thread_length",
        epoch("start_time"), epoch("end_time"), "has_branching", ids("inbounds"),
        F.md5(F.array_join("texts", "|")).alias("texts"), ids("in_response_to_ids"),
    )


@query(
    "thread_brands",
    f"{WITH_THREADED} SELECT thread_key, lower(author_id) AS brand_key, min(author_id) FILTER (WHERE NOT inbound) AS brand, "
    "count(*) AS brand_posts FROM threaded GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT inbound) > 0",
)
def thread_brands(spark, sf_dir):
    return threads.thread_brands(views.threaded(spark, sf_dir))


@query(
    "conservation",
    f"""{WITH_THREADED}, sized AS (SELECT thread_key, count(*) AS n FROM threaded GROUP BY 1)
SELECT (SELECT count(*) FROM posts) AS posts_in, CAST((SELECT sum(n) FROM sized) AS BIGINT) AS posts_in_threads,
  (SELECT count(*) FROM posts) = (SELECT sum(n) FROM sized) AS conserved""",
)
def conservation(spark, sf_dir):
    facts = threads.thread_facts(views.threaded(spark, sf_dir))
    return threads.conservation(views.posts(spark, sf_dir), facts)


@query(
    "thread_stats",
    f"""{WITH_THREADED}, t AS (
  SELECT thread_key, count(*) AS n, bool_or(branching) AS b, bool_or(NOT inbound) AS o FROM threaded GROUP BY 1)
SELECT count(*) AS total_threads, CAST(sum(n) AS BIGINT) AS total_posts,
  count(*) FILTER (WHERE n = 1) AS single_message_threads, count(*) FILTER (WHERE n > 1) AS multi_message_threads,
  count(*) FILTER (WHERE b) AS branching_threads, count(*) FILTER (WHERE o) AS threads_with_brand,
  min(n) AS min_thread_length, max(n) AS max_thread_length, round_even(avg(n), 2) AS avg_thread_length FROM t""",
)
def thread_stats(spark, sf_dir):
    return threads.thread_stats(threads.thread_facts(views.threaded(spark, sf_dir)))


CLOSURE_SQL = r"regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(der|that|la|it is)([^\p{L}\p{N}_]|$)')"


@query(
    "closure_hits",
    f"{WITH_POSTS} SELECT post_id, {CLOSURE_SQL} AS closure FROM posts",
)
def closure_hits(spark, sf_dir):
    return views.posts(spark, sf_dir).select(
        "post_id", resolve.has_closure(F.col("text"), views.RULES).alias("closure")
    )


# Tagged threads as common table expressions, continuing WITH_THREADED.
TAGGED = f"""
facts AS (
  SELECT thread_key, 'T_' || CAST(arg_min(post_id, position) AS VARCHAR) AS thread_id, count(*) AS thread_length,
    arg_max(created_s, position) AS end_s, arg_max(inbound, position) AS customer_last,
    bool_or(inbound) AS has_customer, bool_or(NOT inbound) AS has_brand,
    coalesce(arg_max({CLOSURE_SQL}, position) FILTER (WHERE inbound), false) AS grateful
  FROM threaded GROUP BY thread_key),
reasoned AS (
  SELECT *, CASE
    WHEN has_customer AND NOT has_brand THEN 'unanswered_by_brand'
    WHEN NOT has_customer THEN 'single_sided_outbound_announcement'
    WHEN customer_last AND grateful THEN 'customer_gratitude_closure'
    WHEN customer_last THEN 'pending_brand_reply'
    WHEN grateful THEN 'customer_gratitude_confirmed_by_brand'
    WHEN ((SELECT max(end_s) FROM facts) - end_s) / 3600.0 < 24
      THEN 'brand_final_reply_recent_insufficient_observation_window'
    ELSE 'brand_final_reply_dormant_24h' END AS resolution_reason FROM facts),
tagged AS (
  SELECT *, CASE WHEN resolution_reason IN ('unanswered_by_brand', 'pending_brand_reply') THEN 'false'
    WHEN resolution_reason IN ('single_sided_outbound_announcement',
      'brand_final_reply_recent_insufficient_observation_window') THEN 'unknown'
    ELSE 'true' END AS resolved FROM reasoned)"""


def tagged(spark, sf_dir):
    return resolve.tag_resolution(resolve.closing_facts(views.threaded(spark, sf_dir), views.RULES), views.RULES)


@query(
    "resolution",
    f"{WITH_THREADED}, {TAGGED} SELECT thread_id, thread_length, end_s AS end_time, resolved, resolution_reason FROM tagged",
)
def resolution(spark, sf_dir):
    return tagged(spark, sf_dir).select(
        "thread_id", "thread_length", epoch("end_time"), "resolved", "resolution_reason"
    )


@query(
    "dataset_max_time",
    f"{WITH_THREADED}, {TAGGED} SELECT max(end_s) AS max_time FROM facts",
)
def dataset_max_time(spark, sf_dir):
    facts = resolve.closing_facts(views.threaded(spark, sf_dir), views.RULES)
    return resolve.dataset_max_time(facts).select(epoch("max_time"))


@query(
    "resolution_summary",
    f"""{WITH_THREADED}, {TAGGED} SELECT resolved, resolution_reason, count(*) AS threads,
  CAST(sum(thread_length) AS BIGINT) AS posts, round_even(sum(thread_length) / count(*), 2) AS avg_thread_length,
  round_even(count(*) * 100.0 / (SELECT count(*) FROM tagged), 2) AS pct_of_threads FROM tagged GROUP BY 1, 2""",
)
def resolution_summary(spark, sf_dir):
    return resolve.resolution_summary(tagged(spark, sf_dir))


TOTALS = """count(*) AS total_threads, CAST(coalesce(sum(thread_length), 0) AS BIGINT) AS total_posts,
  count(*) FILTER (WHERE resolved = 'true') AS resolved_threads,
  count(*) FILTER (WHERE resolved = 'false') AS unresolved_threads,
  count(*) FILTER (WHERE resolved = 'unknown') AS unknown_threads,
  round_even(avg(thread_length), 2) AS avg_thread_length,
  round_even(count(*) FILTER (WHERE resolved = 'true') * 100.0 / count(*), 2) AS pct_resolved"""


@query(
    "brand_summary",
    f"""{WITH_THREADED}, {TAGGED} SELECT {TOTALS} FROM tagged
WHERE thread_key IN (SELECT thread_key FROM threaded WHERE NOT inbound AND lower(author_id) = 'brand3')""",
)
def brand_summary(spark, sf_dir):
    """Threads of one brand (in another letter case), dormancy measured against the whole data set."""
    everything = resolve.closing_facts(views.threaded(spark, sf_dir), views.RULES)
    mine = resolve.closing_facts(resolve.brand_threads(views.threaded(spark, sf_dir), "Brand3"), views.RULES, "Brand3")
    rows = resolve.tag_resolution(mine, views.RULES, resolve.dataset_max_time(everything))
    return resolve.outcome_totals(rows)


@query(
    "filter_brand",
    f"""{WITH_THREADED} SELECT 'T_' || CAST(arg_min(post_id, position) AS VARCHAR) AS thread_id, count(*) AS thread_length, count(*) AS kept
FROM threaded GROUP BY thread_key HAVING bool_or(NOT inbound AND lower(author_id) = 'brand5')""",
)
def filter_brand(spark, sf_dir):
    """Threads of a brand, of which longer ones come in parts of two posts: all parts stay."""
    rows = resolve.filter_brand(threads.build_threads(views.threaded(spark, sf_dir), chunk=2), " BRAND5 ")
    return rows.groupBy("thread_id", "thread_length").agg(F.sum("part_length").alias("kept"))


@query(
    "thread_parts",
    f"""{WITH_THREADED}, sized AS (
  SELECT *, strlen(coalesce(text, '')) + strlen(coalesce(author_id, '')) + 128 AS b FROM threaded),
run AS (
  SELECT *, sum(b) OVER (PARTITION BY thread_key ORDER BY position) - b AS before, count(*) OVER (PARTITION BY thread_key) AS n,
    sum(b) OVER (PARTITION BY thread_key) AS total FROM sized),
cells AS (
  SELECT *, CASE WHEN n > 5 OR total > 4000 THEN dense_rank() OVER (PARTITION BY thread_key ORDER BY position // 5, before // 2000) - 1 ELSE 0 END AS part
  FROM run)
SELECT thread_key, part, count(*) AS part_length, CAST(sum(b) AS BIGINT) AS bytes, string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY position) AS post_ids,
  md5(string_agg(text, chr(10) ORDER BY position)) AS texts FROM cells GROUP BY thread_key, part""",
)
def thread_parts(spark, sf_dir):
    """Threads in rows of at most five posts and 4,000 bytes, or 2,000 bytes more than a larger last post."""
    rows = threads.build_threads(views.threaded(spark, sf_dir), chunk=5, max_bytes=4000)
    posts = threads.explode_threads(rows).withColumn("b", threads.post_bytes())
    sizes = rows.select("thread_key", "part", F.explode("post_ids").alias("post_id")).join(posts.select("post_id", "b"), "post_id")
    whole = rows.select(
        "thread_key", "part", "part_length", F.array_join(F.transform("post_ids", lambda p: p.cast("string")), ",").alias("post_ids"),
        F.md5(F.array_join("texts", "\n")).alias("texts"),
    )
    return whole.join(sizes.groupBy("thread_key", "part").agg(F.sum("b").alias("bytes")), ["thread_key", "part"])


@query(
    "posts_of_threads",
    f"{WITH_THREADED} SELECT thread_key, post_id, author_id, inbound, created_s AS created_at, md5(text) AS text, in_response_to_id, branching FROM threaded",
)
def posts_of_threads(spark, sf_dir):
    """Threads in array form, in parts of three posts, taken apart again."""
    posts = threads.explode_threads(threads.build_threads(views.threaded(spark, sf_dir), chunk=3))
    return posts.select(
        "thread_key", "post_id", "author_id", "inbound", epoch("created_at"), F.md5("text").alias("text"), "in_response_to_id", "branching"
    )


@query(
    "brand_candidates",
    f"""{WITH_THREADED}, {TAGGED}, per_thread AS (
  SELECT thread_key, author_id AS brand, count(*) AS brand_posts FROM threaded
  GROUP BY 1, 2 HAVING bool_or(NOT inbound))
SELECT brand, CAST(sum(brand_posts) AS BIGINT) AS total_brand_posts,
  CAST(sum(thread_length) AS BIGINT) AS total_thread_posts, count(*) AS total_threads,
  round_even(avg(thread_length), 2) AS avg_thread_length,
  count(*) FILTER (WHERE resolved = 'true') AS resolved_threads,
  count(*) FILTER (WHERE resolved = 'false') AS unresolved_threads,
  count(*) FILTER (WHERE resolved = 'unknown') AS unknown_threads,
  round_even(count(*) FILTER (WHERE resolved = 'true') * 100.0 / count(*), 2) AS pct_resolved
FROM per_thread JOIN tagged USING (thread_key) GROUP BY brand ORDER BY total_threads DESC, brand LIMIT 20""",
)
def brand_candidates(spark, sf_dir):
    posts = views.threaded(spark, sf_dir)
    return resolve.brand_candidates(posts, tagged(spark, sf_dir), top_n=20)


MESSAGES = r"""
asked AS (
  SELECT thread_key, min(position) AS at FROM threaded WHERE inbound GROUP BY 1),
messages AS (
  SELECT t.thread_key, 'T_' || CAST(o.post_id AS VARCHAR) AS thread_id, t.post_id, CAST(t.position AS INTEGER) AS customer_msg_idx,
    trim(t.text, e' \n\t\r') AS text, trim(regexp_replace(t.text, '\s+', ' ', 'g')) AS cleaned_text,
    (SELECT count(*) FROM threaded x WHERE x.thread_key = t.thread_key) AS thread_length, o.created_s AS start_s
  FROM threaded t JOIN asked a ON a.thread_key = t.thread_key AND a.at = t.position
  JOIN threaded o ON o.thread_key = t.thread_key AND o.position = 0
  WHERE length(trim(t.text, e' \n\t\r')) > 0)"""


def messages(spark, sf_dir):
    return threads.first_messages(views.threaded(spark, sf_dir), brand="brand3")


@query(
    "first_messages",
    f"{WITH_THREADED}, {MESSAGES} SELECT thread_id, post_id, customer_msg_idx, text, cleaned_text, thread_length, "
    "start_s AS start_time FROM messages",
)
def first_messages(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "thread_id", "post_id", "customer_msg_idx", "text", "cleaned_text", "thread_length", epoch("start_time")
    )


@query(
    "brand_replies",
    f"""{WITH_THREADED}, replies AS (
  SELECT thread_key, trim(text, e' \\n\\t\\r') AS reply, row_number() OVER (PARTITION BY thread_key ORDER BY position) AS n
  FROM threaded WHERE NOT inbound AND length(trim(text, e' \\n\\t\\r')) > 0)
SELECT 'T_' || CAST(arg_min(post_id, position) AS VARCHAR) AS thread_id,
  coalesce((SELECT string_agg(reply, ' | ' ORDER BY n) FROM replies r WHERE r.thread_key = t.thread_key AND n <= 2),
    '{threads.DEFAULT_REPLY}') AS brand_reply_text
FROM threaded t GROUP BY t.thread_key""",
)
def brand_replies(spark, sf_dir):
    return threads.brand_replies(views.threaded(spark, sf_dir)).select("thread_id", "brand_reply_text")


LINES = """
lines AS (
  SELECT thread_key, position, '[' || CASE WHEN inbound THEN 'Customer' ELSE 'Brand (' || author_id || ')' END || ']: '
    || trim(text, e' \\n\\t\\r') AS line FROM threaded)"""


@query(
    "transcripts",
    f"""{WITH_THREADED}, {LINES}, last_reply AS (
  SELECT thread_key, arg_max(trim(text, e' \\n\\t\\r'), position) AS r FROM threaded WHERE NOT inbound GROUP BY 1)
SELECT thread_key, CAST(0 AS BIGINT) AS part, string_agg(line, e'\\n' ORDER BY position) AS transcript,
  coalesce(any_value(r), '') AS historical_brand_reply
FROM lines LEFT JOIN last_reply USING (thread_key) GROUP BY thread_key""",
)
def transcripts(spark, sf_dir):
    posts = views.threaded(spark, sf_dir)
    return threads.transcripts(posts).join(threads.last_brand_reply(posts), "thread_key", "left").select(
        "thread_key", "part", "transcript", F.coalesce("historical_brand_reply", F.lit("")).alias("historical_brand_reply")
    )


@query(
    "parse_transcript",
    f"""{WITH_THREADED}, {LINES}, whole AS (
  SELECT thread_key, string_agg(line, e'\\n' ORDER BY position) AS t FROM lines GROUP BY 1),
split AS (
  SELECT thread_key, unnest(string_split(t, e'\\n')) AS raw, generate_subscripts(string_split(t, e'\\n'), 1) - 1 AS line_no
  FROM whole),
turns AS (SELECT thread_key, line_no, trim(raw, e' \\t\\r') AS line FROM split WHERE length(trim(raw, e' \\t\\r')) > 0)
SELECT thread_key, CAST(line_no AS INTEGER) AS line_no,
  CASE WHEN line LIKE '[Customer]:%' THEN 'Customer' WHEN line LIKE '[Brand (%)]:%' THEN 'Brand' ELSE 'Note' END AS speaker,
  line LIKE '[Customer]:%' AS is_customer,
  CASE WHEN line LIKE '[Customer]:%' OR line LIKE '[Brand (%)]:%'
    THEN trim(substr(line, strpos(line, ']:') + 2), e' \\t\\r') ELSE line END AS text
FROM turns""",
)
def parse_transcript(spark, sf_dir):
    """Transcripts in parts of two lines; line numbers run on."""
    return threads.parse_transcript(threads.transcripts(views.threaded(spark, sf_dir), chunk=2))
