"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

The mix has a wanted size. Every source's share follows its weight, but a source stops at ``epochs`` times its
own size; what it cannot use is shared again among the others by weight, until no share is above its limit.
A share of r times the source's size takes every document floor(r) times, and the rest from documents in
the order of a seeded hash, up to the cut that comes nearest.

The cut is found on sums of sizes per (source, hash prefix): one scan for the first prefix, one within the cell
that the cut falls into, and only the few rows of one cell of 16.8 million are ordered. No source is sorted.

Defined cases: a null or empty text has size 0; a null source is a source, ranked last; documents that
share their id and text share their place in the order, and so all enter or none; those that share only an id, or have none, do not. An empty table gives an empty
mix. Extra columns are ignored by ``mix`` and kept by ``take``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tables import WORD
from threadloom.operators.bounded import number_rows
from threadloom.session import small_side, write_stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
# Hex digits of a hash prefix: 4096 cells each.
PREFIX = 3


def hash_place(key: Column, text: Column, seed: str) -> Column:
    """16 hex digits that order documents."""
    named = F.coalesce(key.cast("string"), F.lit("null"))
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), named, F.lit("|"), F.coalesce(text, F.lit("")))), 1, 16)


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, place) of every document."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        hash_place(F.col("doc_id"), F.col("text"), seed).alias("place"),
    )


def fill(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    ``level`` is the size per unit of weight. It rises while sources at their limit leave their excess to the others.
    Each round is one aggregate of the sources' table; a round ends the loop when it clamps no further source.
    """
    limit = F.col("source_size") * F.lit(float(epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted, level = share * total, 0.0
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        spent, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if not open_weight:
            break
        raised = (wanted - spent) / open_weight
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def _crossing(cells: DataFrame, cell: str) -> DataFrame:
    """Per source the cell in which the running sum passes ``left``, and the sum before it."""
    running = Window.partitionBy("source").orderBy(cell)
    summed = cells.withColumn("upto", F.sum("size").over(running))
    return summed.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("size") <= F.col("left"))).select(
        "source", "left", F.col(cell), (F.col("upto") - F.col("size")).alias("before")
    )


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, whole, cutoff; of ``sized`` documents.

    A document is taken ``whole`` times, and once more if its place is not above ``cutoff``.
    """
    spark = docs.sparkSession
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sums.withColumn("all", F.lit(0)), ["all"], [F.col("source").asc_nulls_last()], out="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources, _ = write_stage(ranked.select("source", "source_size", weight.alias("weight")), "mix-sources")
    targets = fill(sources, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets, _ = write_stage(
        targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets"
    )
    wanted = small_side(targets.where("left > 0").select("source", "left"), "mix-left")

    digits = lambda n: F.substring("place", 1 + n * PREFIX, PREFIX)
    open_docs = docs.where("size > 0").withColumns({"c1": digits(0), "c2": digits(1)})
    first = open_docs.groupBy("source", "c1").agg(F.sum("size").alias("size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    first = first.join(wanted, same(first, wanted)).select(first["source"], "c1", "size", "left")
    cut1 = small_side(_crossing(first, "c1"), "mix-cut-1")

    inside = open_docs.alias("d").join(cut1.alias("c"), F.expr("d.source <=> c.source and d.c1 = c.c1"))
    inside, _ = write_stage(inside.select("d.source", "d.c1", "d.c2", "d.size", "d.place", F.col("c.left") - F.col("c.before")), "mix-cell")
    inside = inside.toDF("source", "c1", "c2", "size", "place", "left")
    second = inside.groupBy("source", "c1", "c2").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    cut2 = small_side(_crossing(second, "c2"), "mix-cut-2")

    last = inside.alias("d").join(cut2.alias("c"), F.expr("d.source <=> c.source and d.c2 = c.c2"))
    last = last.groupBy("d.source", "d.place").agg(F.sum("d.size").alias("size"), F.first(F.col("c.left") - F.col("c.before")).alias("left"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("place"))
    taken = last.withColumn("middle", upto - F.col("size") / 2).where("middle <= left").groupBy("source").agg(F.max("place").alias("last"))

    prefix = (
        cut1.select("source", "c1").alias("a")
        .join(cut2.select("source", "c2").alias("b"), F.expr("a.source <=> b.source"), "left")
        .join(taken.alias("t"), F.expr("a.source <=> t.source"), "left")
        # Without a row before the cut, everything of the cells before it is taken.
        .select(F.col("a.source").alias("source"), F.coalesce("t.last", F.concat("a.c1", F.coalesce("b.c2", F.lit("")))).alias("cutoff"))
    )
    table = targets.alias("s").join(prefix.alias("p"), F.expr("s.source <=> p.source"), "left").select(
        "s.source", "s.source_size", "s.target", "s.whole", F.coalesce("p.cutoff", F.lit("")).alias("cutoff")
    )
    return small_side(table, "mix-plan")


def _copies(plan_alias: str, doc_alias: str) -> Column:
    more = F.col(f"{doc_alias}.place") <= F.col(f"{plan_alias}.cutoff")
    return F.col(f"{plan_alias}.whole") + F.when(more & (F.col(f"{doc_alias}.size") > 0), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for every document."""
    rows, _ = write_stage(sized(docs, seed), "mix-sizes")
    table = plan(rows, weights, share, epochs)
    joined = rows.alias("d").join(table.alias("p"), F.expr("d.source <=> p.source"))
    return joined.select("d.doc_id", "d.size", "d.source", "p.source_size", "p.target", _copies("p", "d").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


def take(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    rows, _ = write_stage(sized(docs, seed), "mix-sizes")
    table = plan(rows, weights, share, epochs)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    packed = packed.withColumns(
        {
            "source": F.col("row.source"),
            "place": hash_place(F.col("row.doc_id"), F.col("row.text"), seed),
            "size": F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)),
        }
    )
    joined = packed.alias("d").join(table.alias("p"), F.expr("d.source <=> p.source"))
    taken = joined.select("d.row", _copies("p", "d").alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
