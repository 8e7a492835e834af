"""Reply graph: edges, connected components, branching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.values import to_id
from threadloom.session import small_side, write_stage


def reply_edges(posts: DataFrame) -> DataFrame:
    """One row (src, dst, via) per link whose two posts both exist.

    Links come from the parent id and from the comma-separated list of replies; blank or
    malformed list entries are skipped. Only id columns are read.
    """
    parents = posts.where(F.col("in_response_to_id").isNotNull()).select(
        F.col("post_id").alias("src"), F.col("in_response_to_id").alias("dst"), F.lit("parent").alias("via")
    )
    listed = posts.where(F.col("response_ids").isNotNull()).select(
        F.col("post_id").alias("src"), F.explode(F.split("response_ids", ",")).alias("entry")
    )
    children = listed.select("src", to_id(F.col("entry")).alias("dst"), F.lit("children").alias("via"))
    links = parents.unionByName(children.where(F.col("dst").isNotNull()))
    known = posts.select(F.col("post_id").alias("dst"))
    return links.join(known, "dst", "left_semi").select("src", "dst", "via")


def _links(posts: DataFrame) -> DataFrame:
    """(src, dst) of every link a post names, whether or not the other post exists."""
    parents = posts.where(F.col("in_response_to_id").isNotNull()).select(F.col("post_id").alias("src"), F.col("in_response_to_id").alias("dst"))
    listed = posts.where(F.col("response_ids").isNotNull()).select(
        F.col("post_id").alias("src"), F.explode(F.split("response_ids", ",")).alias("entry")
    )
    children = listed.select("src", to_id(F.col("entry")).alias("dst"))
    return parents.unionByName(children.where(F.col("dst").isNotNull()))


@dataclass(frozen=True)
class ThreadState:
    """What loads of posts need to know of the earlier ones: each post's thread, and the links whose other post has not come yet."""

    threads: DataFrame
    pending: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> ThreadState:
        return cls(spark.createDataFrame([], "post_id bigint, thread_key bigint"), spark.createDataFrame([], "src bigint, dst bigint"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ThreadState:
        return cls(spark.read.parquet(f"{path}/threads"), spark.read.parquet(f"{path}/pending"))

    def write(self, path: str) -> None:
        self.pending.write.parquet(f"{path}/pending")
        self.threads.write.parquet(f"{path}/threads")


def add_posts(state: ThreadState, posts: DataFrame) -> ThreadState:
    """The state after a load of posts, equal to that of all posts at once.

    Links of the new posts, and earlier ones that waited for one of them, join whole threads, so components are sought among the
    threads these links touch only. The stored table is read once to look up the links' ends, and once to relabel
    the threads that were joined: one table of changed keys, broadcast if its size allows. A post that comes again changes nothing but
    adds the links it names.
    """
    new, _ = write_stage(posts.select("post_id").distinct(), "load-posts")
    fresh = new.join(state.threads.select("post_id"), "post_id", "left_anti").select("post_id", F.col("post_id").alias("thread_key"))
    fresh, _ = write_stage(fresh, "load-fresh")
    links, _ = write_stage(_links(posts).unionByName(state.pending).distinct(), "load-links")
    # Threads of all ends of links, from one pass over the stored table.
    wanted = small_side(links.select(F.explode(F.array("src", "dst")).alias("post_id")).distinct(), "load-ends")
    ends, _ = write_stage(state.threads.join(wanted, "post_id").unionByName(fresh.join(wanted, "post_id")), "load-threads")
    known = lambda end: ends.select(F.col("post_id").alias(end), F.col("thread_key").alias(f"{end}_key"))
    placed, _ = write_stage(links.join(known("src"), "src").join(known("dst"), "dst", "left"), "load-placed")
    moved = connected_components(placed.where(F.col("dst_key").isNotNull()), "src_key", "dst_key")
    moved = small_side(moved.select(F.col("node").alias("thread_key"), F.col("component").alias("joined")), "load-moved")
    threads = state.threads.unionByName(fresh).join(moved, "thread_key", "left").select("post_id", F.coalesce("joined", "thread_key").alias("thread_key"))
    return ThreadState(write_stage(threads, "load-state")[0], placed.where(F.col("dst_key").isNull()).select("src", "dst"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", hops: int = 3) -> DataFrame:
    """(node, component) for every node that is not its component's smallest id.

    Hook and contract: every node points to its smallest smaller neighbour, pointers are followed
    until they end at a root, and edges between different roots start the next phase. A reply
    forest needs one phase, any graph at most a logarithmic number: a node that neither moves nor
    takes in a neighbour has a smaller neighbour in the next phase.

    No neighbourhood is ever gathered. The minimum is combined on the map side, and pointer
    lookups join two written tables, whose skewed partitions adaptive execution can split, so a
    post with a third of all replies is no single task's work. Each step ends in a written table.
    """
    pairs = edges.select(
        F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")
    ).where(F.col("hi") != F.col("lo"))
    pairs, _ = write_stage(pairs, "component-edges")
    found: DataFrame | None = None
    while True:
        hooks, seen = write_stage(
            pairs.groupBy("hi").agg(F.min("lo").alias("root"), F.max("lo").alias("last"))
            .select(F.col("hi").alias("node"), "root", (F.col("last") > F.col("root")).alias("forked")),
            "component-hooks",
            forked=F.count_if("forked"),
        )
        if seen["rows"] == 0:
            break
        roots = _follow(hooks.select("node", "root"), hops)
        found = roots if found is None else write_stage(_compose(found, roots), "components")[0]
        if not seen["forked"]:
            break
        pairs, left = write_stage(_contract(pairs, roots), "component-edges")
        if left["rows"] == 0:
            break
    if found is None:
        found = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return found.select("node", F.col("root").alias("component"))


def _lookup(table: DataFrame, key: str, suffix: str) -> DataFrame:
    return table.select(F.col("node").alias(key), F.col("root").alias(suffix))


def _follow(pointers: DataFrame, hops: int) -> DataFrame:
    """Replace every pointer by the root at its end; each round multiplies its reach.

    A row whose last lookup finds nothing has arrived and is only looked up from then on.
    """
    arrived: DataFrame | None = None
    moving = pointers
    while True:
        known = moving if arrived is None else moving.unionByName(arrived)
        step = moving.select("node", F.col("root").alias("p0"))
        for i in range(hops):
            step = (
                step.join(_lookup(known, f"p{i}", "next"), f"p{i}", "left")
                .select("node", F.coalesce("next", f"p{i}").alias(f"p{i + 1}"), F.col("next").isNotNull().alias("moved"))
            )
        reached, seen = write_stage(
            step.select("node", F.col(f"p{hops}").alias("root"), "moved"),
            "component-pointers",
            moved=F.count_if("moved"),
        )
        final = reached.where(~F.col("moved")).select("node", "root")
        arrived = final if arrived is None else arrived.unionByName(final)
        if not seen["moved"]:
            return arrived
        moving = reached.where(F.col("moved")).select("node", "root")


def _compose(found: DataFrame, roots: DataFrame) -> DataFrame:
    earlier = found.join(_lookup(roots, "root", "next"), "root", "left").select(
        "node", F.coalesce("next", "root").alias("root")
    )
    return earlier.unionByName(roots)


def _contract(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    ends = (
        pairs.join(_lookup(roots, "hi", "a"), "hi")
        .join(_lookup(roots, "lo", "b"), "lo", "left")
        .select("a", F.coalesce("b", "lo").alias("b"))
        .where(F.col("a") != F.col("b"))
    )
    return ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def branching_posts(posts: DataFrame) -> DataFrame:
    """Ids of posts that answer a parent id which more than one post answers.

    Counts cover every parent id, also those of posts that are not in the table. Posts without a
    parent take no part in the join. The parents are written before it, so that both of its sides
    are plain scans and a parent with a third of all replies can be split.
    """
    replies = posts.where(F.col("in_response_to_id").isNotNull()).select("post_id", "in_response_to_id")
    shared = small_side(
        replies.groupBy("in_response_to_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("in_response_to_id"),
        "shared-parents",
    )
    return replies.join(shared, "in_response_to_id", "left_semi").select("post_id")


def flag_branching(posts: DataFrame) -> DataFrame:
    """Add ``branching`` to every post."""
    found = branching_posts(posts).select("post_id", F.lit(True).alias("branching"))
    return posts.join(found, "post_id", "left").select(
        *posts.columns, F.coalesce("branching", F.lit(False)).alias("branching")
    )


def assign_threads(posts: DataFrame) -> DataFrame:
    """Add ``thread_key`` (smallest post id of the component) and ``branching`` to every post.

    Both are worked out on ids alone; the texts are shuffled once, to meet them.
    """
    components = connected_components(reply_edges(posts))
    tags = components.select(
        F.col("node").alias("post_id"), F.col("component").alias("thread_key"), F.lit(False).alias("branching")
    ).unionByName(
        branching_posts(posts).select("post_id", F.lit(None).cast("bigint").alias("thread_key"), F.lit(True).alias("branching"))
    )
    per_post = tags.groupBy("post_id").agg(
        F.max("thread_key").alias("thread_key"), F.bool_or("branching").alias("branching")
    )
    return posts.join(per_post, "post_id", "left").select(
        *posts.columns,
        F.coalesce("thread_key", "post_id").alias("thread_key"),
        F.coalesce("branching", F.lit(False)).alias("branching"),
    )
