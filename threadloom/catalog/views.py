"""The conversation tables the queries run on, derived from the given tables.

Each view exists twice: as a DataFrame and as SQL text for a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalog.base import table
from threadloom.operators import graph, resolve
from threadloom.session import write_stage

# Posts with a reply graph: chains of conversations, missing parents, links known only from the
# list of replies, branching, and conversations whose ids do not follow time. The same text runs in Spark and in the oracle.
POSTS_SELECT = """
SELECT conv_id*100+turn AS post_id,
  CASE WHEN role='user' THEN concat('cust',CAST(conv_id AS STRING))
       ELSE concat('brand',CAST(conv_id%7 AS STRING)) END AS author_id,
  role='user' AS inbound, text,
  1704067200+conv_id*3600+CASE WHEN conv_id%19=6 THEN (40-turn)*60 ELSE turn*420 END AS created_s,
  CASE WHEN turn=0 AND conv_id%13 BETWEEN 1 AND 5 THEN (conv_id-1)*100
       WHEN turn=0 AND conv_id%11=3 THEN 999000000+conv_id
       WHEN turn=0 THEN NULL
       WHEN turn=1 AND conv_id%9=4 THEN NULL
       WHEN turn>=2 AND conv_id%5=0 THEN conv_id*100
       ELSE conv_id*100+turn-1 END AS in_response_to_id,
  CASE WHEN turn=0 AND conv_id%9=4
       THEN concat(CAST(conv_id*100+1 AS STRING),', ',CAST(888000000+conv_id AS STRING)) END AS response_ids
FROM {conversations}
"""

POSTS = f"posts AS ({POSTS_SELECT.format(conversations='conversations')})"

EDGES = """
edges AS (
  SELECT src, dst, via FROM (
    SELECT post_id AS src, in_response_to_id AS dst, 'parent' AS via FROM posts
    UNION ALL
    SELECT post_id, TRY_CAST(trim(t) AS BIGINT), 'children'
    FROM (SELECT post_id, unnest(string_split(response_ids, ',')) AS t FROM posts WHERE response_ids IS NOT NULL)
  ) WHERE dst IN (SELECT post_id FROM posts)
)"""

COMPONENTS = """
both_ways AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
reach(node, seen) AS (
  SELECT post_id, post_id FROM posts
  UNION
  SELECT b.v, r.seen FROM reach r JOIN both_ways b ON b.u = r.node
),
component AS (SELECT node AS post_id, min(seen) AS thread_key FROM reach GROUP BY node)"""

FORKS = """
forks AS (
  SELECT in_response_to_id AS fork FROM posts WHERE in_response_to_id IS NOT NULL
  GROUP BY 1 HAVING count(*) > 1
)"""

THREADED = """
threaded AS (
  SELECT p.*, c.thread_key, (f.fork IS NOT NULL) AS branching,
         row_number() OVER (PARTITION BY c.thread_key ORDER BY p.created_s, p.post_id) - 1 AS position,
         row_number() OVER (PARTITION BY c.thread_key ORDER BY p.created_s DESC, p.post_id DESC) AS from_end
  FROM posts p JOIN component c USING (post_id) LEFT JOIN forks f ON f.fork = p.in_response_to_id
)"""

# Everything up to threaded posts; queries continue the list after a comma.
WITH_THREADED = "WITH RECURSIVE " + ",".join([POSTS, EDGES, COMPONENTS, FORKS, THREADED])
WITH_POSTS = f"WITH {POSTS}"

_threaded: dict[tuple[str, str], DataFrame] = {}


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = spark.sql(POSTS_SELECT, conversations=conversations)
    return rows.withColumn("created_at", F.timestamp_seconds("created_s")).drop("created_s")


def threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their thread, written once per application like any stage of the ingest job."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir)
    if key not in _threaded:
        _threaded[key] = write_stage(graph.assign_threads(posts(spark, sf_dir)), "threaded-posts")[0]
    return _threaded[key]


# Closing words that occur in the given texts.
RULES = resolve.ResolutionRules(inactivity_hours=24.0, closure_words=("der", "that", "la", "it is"))
