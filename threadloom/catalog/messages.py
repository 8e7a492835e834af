"""Queries on profiles, text rules and message tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import views
from threadloom.catalog.base import query, table, texts
from threadloom.catalog.ingest import MESSAGES, messages
from threadloom.catalog.views import WITH_POSTS, WITH_THREADED
from threadloom.functions import text as tx
from threadloom.functions.values import parse_post_time, to_id
from threadloom.operators import joins
from threadloom.operators import messages as ms
from threadloom.session import literal_table
from threadloom.sources import posts as src
from threadloom.sources import tables


def raw_posts(spark, sf_dir):
    """The posts as the raw export has them: text columns, some dates and ids malformed."""
    at = F.col("created_at")
    kind = F.floor(F.col("post_id") / 100) % 17
    written = (
        F.when(kind == 0, "not a date")
        .when(kind == 1, F.lit(None))
        .when(kind == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(at, "EEE MMM dd HH:mm:ss '+0000' yyyy"))
    )
    ids = F.when(kind == 3, F.concat(F.lit("id"), F.col("post_id"))).otherwise(F.col("post_id").cast("string"))
    return views.posts(spark, sf_dir).select(
        ids.alias("tweet_id"),
        "author_id",
        F.col("inbound").cast("string").alias("inbound"),
        written.alias("created_at"),
        F.when(kind == 4, F.lit(None)).otherwise(F.col("text")).alias("text"),
        F.col("response_ids").alias("response_tweet_id"),
        F.col("in_response_to_id").cast("double").cast("string").alias("in_response_to_tweet_id"),
    )


@query(
    "profile_posts",
    f"""{WITH_POSTS}, k AS (SELECT *, (post_id // 100) % 17 AS kind FROM posts)
SELECT count(*) AS total_rows, count(*) FILTER (WHERE inbound) AS inbound_count,
  count(*) FILTER (WHERE NOT inbound) AS outbound_count,
  min(created_s) FILTER (WHERE kind > 1) AS min_time, max(created_s) FILTER (WHERE kind > 1) AS max_time,
  count(*) FILTER (WHERE false) AS null_tweet_id, count(*) FILTER (WHERE author_id IS NULL) AS null_author_id,
  count(*) FILTER (WHERE inbound IS NULL) AS null_inbound, count(*) FILTER (WHERE kind = 1) AS null_created_at,
  count(*) FILTER (WHERE kind = 4 OR text IS NULL) AS null_text,
  count(*) FILTER (WHERE response_ids IS NULL) AS null_response_tweet_id,
  count(*) FILTER (WHERE in_response_to_id IS NULL) AS null_in_response_to_tweet_id,
  count(*) FILTER (WHERE kind <= 1) AS malformed_dates, count(*) FILTER (WHERE kind = 3) AS malformed_ids,
  round_even(count(*) FILTER (WHERE inbound) * 100.0 / count(*), 2) AS inbound_pct,
  round_even(count(*) FILTER (WHERE NOT inbound) * 100.0 / count(*), 2) AS outbound_pct FROM k""",
)
def profile_posts(spark, sf_dir):
    return src.profile_posts(raw_posts(spark, sf_dir))


@query(
    "typed_posts",
    f"""{WITH_POSTS}, k AS (SELECT *, (post_id // 100) % 17 AS kind FROM posts)
SELECT CASE WHEN kind <> 3 THEN post_id END AS post_id, author_id, inbound,
  CASE WHEN kind > 1 THEN created_s END AS created_at, response_ids, in_response_to_id FROM k""",
)
def typed_posts(spark, sf_dir):
    typed = src.to_posts(raw_posts(spark, sf_dir))
    return typed.select(
        "post_id", "author_id", "inbound", F.unix_seconds("created_at").alias("created_at"), "response_ids", "in_response_to_id"
    )


@query(
    "post_times",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) // 1000000 END AS at FROM events""",
)
def post_times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    written = (
        F.when(F.col("event_type") == "error", F.lit("no time"))
        .when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy"))
    )
    events = table(spark, sf_dir, "events").select("event_id", written.alias("written"))
    return events.select("event_id", F.unix_seconds(parse_post_time(F.col("written"))).alias("at"))


# Documents with handles in front and inside, of a brand in several letter cases and of others.
def mentioned(spark, sf_dir):
    docs = texts(spark, sf_dir)
    handles = (
        F.when(F.col("lang") == "en", F.concat(F.lit("@HelpDesk @user"), F.col("doc_id"), F.lit("  ")))
        .when(F.col("lang") == "fr", F.lit("@étoile_9 "))
        .otherwise(F.lit(""))
    )
    tail = F.when(F.col("source") == "src3", F.lit(" @helpdesk, @HelpDesks")).otherwise(F.lit(""))
    only = (F.col("source") == "src7") & (F.col("lang") == "en")
    whole = F.concat(handles, F.col("text"), tail)
    return docs.select("doc_id", "lang", "source", F.when(only, F.lit(" @HelpDesk @you ")).otherwise(whole).alias("text"))


MENTIONED = """
mentioned AS (SELECT doc_id, lang, source, CASE WHEN source = 'src7' AND lang = 'en' THEN ' @HelpDesk @you ' ELSE
  CASE lang WHEN 'en' THEN concat('@HelpDesk @user', doc_id, '  ') WHEN 'fr' THEN '@étoile_9 ' ELSE '' END
  || text || CASE WHEN source = 'src3' THEN ' @helpdesk, @HelpDesks' ELSE '' END END AS text FROM documents)"""
SP = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
WD = r"[\p{L}\p{N}_]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


@query(
    "clean_text",
    f"""WITH {MENTIONED}, a AS (SELECT *, regexp_replace(text, '^(?:@{WD}+{SP}*)+', '') AS x FROM mentioned),
b AS (SELECT *, {sql_strip(f"regexp_replace(regexp_replace(x, '(?i)@helpdesk([^a-z0-9_]|$)', chr(92) || '1', 'g'), '{SP}+', ' ', 'g')")} AS y FROM a)
SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN length(y) > 0 THEN y ELSE {sql_strip('text')} END AS cleaned FROM b""",
)
def clean_text(spark, sf_dir):
    return mentioned(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text"), "HelpDesk").alias("cleaned"))


@query(
    "strip_mentions",
    f"WITH {MENTIONED}, s AS (SELECT doc_id, {sql_strip(f'''regexp_replace(text, '@{WD}+', '', 'g')''')} AS reply FROM mentioned) "
    "SELECT * FROM s WHERE length(reply) > 0",
)
def strip_mentions(spark, sf_dir):
    stripped = mentioned(spark, sf_dir).select("doc_id", tx.strip_mentions(F.col("text")).alias("reply"))
    return stripped.where(F.length("reply") > 0)


@query(
    "documents_composed",
    "SELECT doc_id, 'Customer: ' || text || ' | Action: ' || source AS embedded, 'Customer: ' || text AS asked, "
    "text || chr(10) || 'Action: ' || source AS shown, substr(text, 1, 300) AS payload FROM documents",
)
def documents_composed(spark, sf_dir):
    text, action = F.col("text"), F.col("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.precedent_document(text, action).alias("embedded"),
        tx.query_document(text).alias("asked"),
        tx.display_document(text, action).alias("shown"),
        tx.left(text, 300).alias("payload"),
    )


STRATA_SQL = """
binned AS (SELECT *, CASE WHEN thread_length <= 2 THEN 'short_2' WHEN thread_length <= 4 THEN 'medium_3_4' ELSE 'long_5plus' END
    AS thread_length_bin,
  CASE WHEN start_s IS NULL THEN 'unknown_time' WHEN strftime(make_timestamp(start_s * 1000000), '%Y_%m') < '2024_02'
    THEN 'pre_2024_02' ELSE strftime(make_timestamp(start_s * 1000000), '%Y_%m') END AS time_period FROM messages)"""


@query(
    "strata",
    f"""{WITH_THREADED}, {MESSAGES}, {STRATA_SQL}
SELECT thread_id, thread_length_bin, time_period, time_period || '__' || thread_length_bin AS stratum,
  time_period || '__cluster_' || CAST(post_id % 8 AS VARCHAR) AS composite_stratum FROM binned""",
)
def strata(spark, sf_dir):
    binned = ms.assign_strata(messages(spark, sf_dir), cutoff="2024-02")
    clustered = ms.composite_stratum(binned.withColumn("cluster", F.col("post_id") % 8))
    return clustered.select("thread_id", "thread_length_bin", "time_period", "stratum", "composite_stratum")


# Keyword rules on words that occur in the texts; order matters.
RULES = (
    ("verbs", r"\b(is|was|be)\b"),
    ("german", r"\b(der|und|von)\b"),
    ("french", r"\b(la|des|que)\b"),
    ("places", r"\b(from|on|in|en)\b"),
    ("long_words", r"\b\w{14,}\b"),
)
POLICY = (("verbs", "", False, []), ("german", "", True, []), ("french", "", True, []), ("places", "", False, []))
TAXONOMY = "intent string, description string, escalate boolean, examples array<struct<post_id:string,text:string>>"
TEMPLATES = {"verbs": "We can help with that.", "german": "Bitte melden Sie sich.", "places": "Where is that?"}


def taxonomy(spark):
    return literal_table(spark, [tuple(p) for p in POLICY], TAXONOMY)


def scored_documents(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return ms.classify_keywords(docs, RULES, "other")


def sql_word(words: str, col: str = "text") -> str:
    return f"regexp_matches(lower({col}), '(^|[^\\p{{L}}\\p{{N}}_])({words})([^\\p{{L}}\\p{{N}}_]|$)')"


INTENT_SQL = f"""CASE WHEN {sql_word('is|was|be')} THEN 'verbs' WHEN {sql_word('der|und|von')} THEN 'german'
  WHEN {sql_word('la|des|que')} THEN 'french' WHEN {sql_word('from|on|in|en')} THEN 'places'
  WHEN {sql_word('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{14,}')} THEN 'long_words' ELSE 'other' END"""
SCORED_DOCS = f"""
scored AS (SELECT *, CASE WHEN i = 'miss' THEN 'other' ELSE i END AS predicted_intent,
  CASE WHEN i = 'miss' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS intent_confidence
  FROM (SELECT *, {INTENT_SQL.replace("ELSE 'other'", "ELSE 'miss'")} AS i FROM documents))"""


@query("keyword_intent", f"WITH {SCORED_DOCS} SELECT doc_id, predicted_intent, intent_confidence FROM scored")
def keyword_intent(spark, sf_dir):
    return scored_documents(spark, sf_dir).select("doc_id", "predicted_intent", "intent_confidence")


@query(
    "policy_and_template",
    f"""WITH {SCORED_DOCS} SELECT doc_id, predicted_intent, predicted_intent IN ('german', 'french') AS escalation_default,
  CASE predicted_intent WHEN 'verbs' THEN 'We can help with that.' WHEN 'german' THEN 'Bitte melden Sie sich.'
    WHEN 'places' THEN 'Where is that?' ELSE 'Write to us.' END AS drafted_reply FROM scored""",
)
def policy_and_template(spark, sf_dir):
    flagged = ms.attach_policy(scored_documents(spark, sf_dir), taxonomy(spark))
    return ms.attach_template(flagged, TEMPLATES, "Write to us.").select(
        "doc_id", "predicted_intent", "escalation_default", "drafted_reply"
    )


@query(
    "split_valid",
    f"""WITH t AS (SELECT doc_id, CASE WHEN source = 'src1' THEN '   ' WHEN source = 'src2' THEN NULL ELSE text END AS text FROM documents),
c AS (SELECT *, CASE WHEN text IS NULL OR length({sql_strip('text')}) = 0 THEN 'empty'
  WHEN length({sql_strip('text')}) > 1000 THEN 'too_long' END AS rejected FROM t)
SELECT doc_id, rejected, CASE WHEN rejected IS NULL THEN {sql_strip('text')} END AS text FROM c""",
)
def split_valid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    blanked = docs.select(
        "doc_id",
        F.when(F.col("source") == "src1", "   ").when(F.col("source") == "src2", F.lit(None)).otherwise(F.col("text")).alias("text"),
    )
    accepted, rejected = ms.split_valid(blanked)
    return accepted.select("doc_id", F.lit(None).cast("string").alias("rejected"), "text").unionByName(
        rejected.select("doc_id", "rejected", F.lit(None).cast("string").alias("text"))
    )


@query(
    "pick_examples",
    rf"""WITH {SCORED_DOCS}, f AS (SELECT *, length(text) BETWEEN 40 AND 240 AS fits FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY fits DESC, doc_id) AS rank,
  bool_or(fits) OVER (PARTITION BY source, lang) AS any_fit FROM f),
s AS (SELECT doc_id, source || '/' || lang AS grp, rank, {sql_strip(r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')")} AS a, {sql_strip('text')} AS t
  FROM r WHERE rank <= 2 AND (fits OR NOT any_fit))
SELECT doc_id, grp, CAST(rank AS INTEGER) AS rank, CASE WHEN length(a) > 0 THEN a ELSE t END AS text,
  CAST(length(CASE WHEN length(a) > 0 THEN a ELSE t END) AS INTEGER) AS length FROM s""",
)
def pick_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("grp", F.concat_ws("/", "source", "lang"))
    return ms.pick_examples(docs, "doc_id", intent="grp")


@query(
    "latest_stats",
    "SELECT event_type AS step, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value "
    "FROM events GROUP BY event_type",
)
def latest_stats(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumnRenamed("event_type", "step")
    return tables.latest_per_key(log, ["step"], [F.desc("ts"), F.desc("event_id")]).select("step", "event_id", "value")


# -- joins and set operations -------------------------------------------------------------------


@query(
    "semi_anti",
    """SELECT 'labelled' AS part, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'open', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
)
def semi_anti(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = [F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")]
    inside = joins.only_in(docs, labels, "doc_id").agg(*counted).select(F.lit("labelled").alias("part"), "docs", "chars")
    outside = joins.not_in(docs, labels, "doc_id").agg(*counted).select(F.lit("open").alias("part"), "docs", "chars")
    return inside.unionByName(outside)


@query(
    "enrich",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(CAST(l.toxic AS VARCHAR), d.lang) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def enrich(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").withColumns(
        {"quality": F.col("quality").cast("int"), "toxic": F.col("toxic").cast("string")}
    )
    return joins.enrich(docs, labels, "doc_id", {"quality": F.lit(-1), "toxic": F.col("lang")}).drop("lang")


@query(
    "with_replies",
    f"""{WITH_THREADED}, {MESSAGES}, r AS (
  SELECT thread_key, arg_max(trim(text, e' \\n\\t\\r'), position) AS historical_brand_reply FROM threaded WHERE NOT inbound GROUP BY 1)
SELECT thread_id, post_id, historical_brand_reply FROM messages JOIN r USING (thread_key)""",
)
def with_replies(spark, sf_dir):
    from threadloom.operators import threads

    replies = threads.last_brand_reply(views.threaded(spark, sf_dir))
    return joins.with_replies(messages(spark, sf_dir), replies, "thread_key").select(
        "thread_id", "post_id", "historical_brand_reply"
    )


@query(
    "overlap",
    """WITH a AS (SELECT doc_id FROM documents WHERE lang <> 'en'), b AS (SELECT doc_id FROM labels WHERE toxic = 0),
s AS (SELECT DISTINCT doc_id FROM a WHERE doc_id IN (SELECT doc_id FROM b))
SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, (SELECT count(*) FROM s) AS shared,
  round_even((SELECT count(*) FROM s) * 100.0 / (SELECT count(*) FROM a), 2) AS pct_of_a,
  round_even((SELECT count(*) FROM s) * 100.0 / (SELECT count(*) FROM b), 2) AS pct_of_b,
  (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM s ORDER BY doc_id LIMIT 5)) AS examples""",
)
def overlap(spark, sf_dir):
    a = table(spark, sf_dir, "documents").where("lang <> 'en'")
    b = table(spark, sf_dir, "labels").where("toxic = 0")
    return joins.overlap(a, b, "doc_id").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(
    "coverage",
    """WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM documents WHERE lang <> 'fr')
SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS in_a, CAST((SELECT count(*) FROM b) AS BIGINT) AS in_b,
  (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) AS in_both,
  (SELECT count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)) AS in_either,
  (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) = 0
    AND (SELECT count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)) = (SELECT count(*) FROM documents) AS complete""",
)
def coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return joins.coverage(docs.where("lang = 'en'"), docs.where("lang <> 'fr'"), docs, "doc_id")


@query(
    "keep_first",
    """WITH u AS (SELECT doc_id, 0 AS p, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 1, lang FROM documents)
SELECT doc_id, arg_min(origin, p) AS origin FROM u GROUP BY doc_id""",
)
def keep_first(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("origin"))
    return ms.keep_first([labels, docs], ["doc_id"], "origin")


@query(
    "first_per_group",
    """SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3""",
)
def first_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ms.first_per_group(docs, ["source"], [F.desc("n_chars"), "doc_id"], 3).select("doc_id", "source", "rank")


@query("first_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def first_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ms.first_rows(docs, 25, F.desc("n_chars"), "doc_id")


@query(
    "top_brands",
    f"{WITH_POSTS} SELECT author_id, count(*) AS posts FROM posts WHERE NOT inbound GROUP BY 1 ORDER BY posts DESC, author_id LIMIT 5",
)
def top_brands(spark, sf_dir):
    outbound = views.posts(spark, sf_dir).where(~F.col("inbound"))
    counted = outbound.groupBy("author_id").agg(F.count(F.lit(1)).alias("posts"))
    return counted.orderBy(F.desc("posts"), "author_id").limit(5)
