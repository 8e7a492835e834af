"""Group-wise work that stays bounded when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.values import hash_order
from threadloom.session import small_side, write_stage

# Groups up to this many rows are ordered inside one task.
GROUP_ROWS = 200_000
# ... if a given weight, such as their bytes, adds up to no more than this.
GROUP_BYTES = 256 << 20
# Hex digits of the hash that form the histogram cells of a hash-ordered draw.
HASH_DIGITS = 4


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str = "position",
    max_group: int = GROUP_ROWS,
    weight: str | None = None,
    before: str = "before",
    max_weight: int = GROUP_BYTES,
) -> DataFrame:
    """0-based position of every row within its group; with a column ``weight``, also the sum of it ``before`` the row.

    Groups up to ``max_group`` rows, and up to ``max_weight`` in sum, use a window. Larger ones are range partitioned on
    (group, order), so that no task sees more than a slice of them; each slice is numbered on its
    own and shifted by the rows of the slices before it.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    earlier = Window.unboundedPreceding, -1

    def place(frame: DataFrame, within: WindowSpec, position: str, sums: str) -> DataFrame:
        frame = frame.withColumn(position, F.row_number().over(within).cast("bigint") - 1)
        return frame if weight is None else frame.withColumn(sums, F.coalesce(F.sum(weight).over(within.rowsBetween(*earlier)), F.lit(0)))

    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *([F.sum(weight).alias("_w")] if weight else []))
    above = F.col("_n") > max_group
    sizes = sizes.where(above | (F.col("_w") > max_weight) if weight else above).select(*group)
    # At most (rows / max_group), and by weight (sum / max_weight), groups are this large.
    large = small_side(sizes, "large-groups")
    if large.isEmpty():
        return place(df, window, out, before)

    inside = place(df.join(large, list(group), "left_anti"), window, out, before)
    ranged = df.join(large, list(group), "left_semi").repartitionByRange(
        *[F.col(g) for g in group], *order
    )
    # The slice number is fixed by writing it: range bounds are sampled anew in every plan.
    sliced, _ = write_stage(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    ahead = Window.partitionBy(*group).orderBy("_slice").rowsBetween(*earlier)
    totals = {"_offset": F.count(F.lit(1))} | ({"_ahead": F.sum(weight)} if weight else {})
    offsets = sliced.groupBy(*group, "_slice").agg(*[c.alias(name) for name, c in totals.items()])
    offsets = small_side(offsets.withColumns({name: F.coalesce(F.sum(name).over(ahead), F.lit(0)) for name in totals}), "slice-offsets")
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    outside = place(sliced, within, "_rank", "_sum").join(offsets, [*group, "_slice"]).withColumn(out, F.col("_rank") + F.col("_offset"))
    if weight is not None:
        outside = outside.withColumn(before, F.col("_sum") + F.col("_ahead"))
    return inside.unionByName(outside.select(*inside.columns))


def hash_histogram(df: DataFrame, group: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Rows per group and leading hash digits, written as a stage table. Rows without a group do not count."""
    cell = F.substring(hash_order(F.col(id_col), seed), 1, HASH_DIGITS).alias("_cell")
    keys = [F.col(g) for g in group]
    hist = df.dropna(subset=list(group)).select(*keys, cell).groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    return write_stage(hist, "hash-histogram")[0]


def mark_by_hash(
    df: DataFrame,
    group: Sequence[str],
    id_col: str,
    seed: int,
    quotas: DataFrame | int,
    hist: DataFrame | None = None,
    slim: DataFrame | None = None,
) -> DataFrame:
    """Add ``drawn``: whether the row is among the first n of its group in hash order, exactly.

    ``quotas`` has one row per group with its ``n`` (or is one n for all); groups without a row
    draw nothing. A histogram over the leading hash digits finds the cell where a group's quota is
    used up; only that cell's ids are ranked, which yields the last hash to keep. No group is
    sorted, and the mark itself is a comparison on the scan. ``slim`` may hold the ids and groups of ``df`` as a table of
    its own, so that a costly ``df`` is evaluated for the mark only; else they are written here.
    """
    if not group:
        return mark_by_hash(df.withColumn("_all", F.lit(1)), ["_all"], id_col, seed, quotas, hist).drop("_all")
    group = list(group)
    if slim is None:
        slim, _ = write_stage(df.select(*dict.fromkeys([*group, id_col])), "draw-ids")
    hist = hash_histogram(slim, group, id_col, seed) if hist is None else hist
    up_to = Window.partitionBy(*group).orderBy("_cell")
    cells = hist.withColumn("_upto", F.sum("_rows").over(up_to))
    if isinstance(quotas, DataFrame):
        cells = cells.join(quotas.select(*group, "n"), group)
    else:
        cells = cells.withColumn("n", F.lit(quotas).cast("bigint"))
    # The cell that holds a group's n-th id, and how many of its ids to keep; no cell: keep all.
    reached = F.when(F.col("_upto") >= F.col("n"), F.struct("_cell", "_upto", "_rows"))
    cuts = small_side(
        cells.where(F.col("n") > 0)
        .groupBy(*group)
        .agg(F.max("n").alias("n"), F.min(reached).alias("_at"))
        .select(
            *group,
            F.col("_at._cell").alias("_cut"),
            (F.col("n") - F.col("_at._upto") + F.col("_at._rows")).alias("_keep"),
        ),
        "hash-cuts",
    )
    hashed = df.withColumn("_hash", hash_order(F.col(id_col), seed))
    rank = Window.partitionBy(*group).orderBy("_hash", "_id")
    ends = (
        slim.select(*group, hash_order(F.col(id_col), seed).alias("_hash"), F.col(id_col).alias("_id"))
        .join(cuts, group)
        .where(F.substring("_hash", 1, HASH_DIGITS) == F.col("_cut"))
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") == F.col("_keep"))
        .select(*group, F.col("_hash").alias("_end"), F.col("_id").alias("_end_id"))
    )
    limits = small_side(
        cuts.join(ends, group, "left").select(
            *group, "_cut", "_end", "_end_id", F.lit(True).alias("_some")
        ),
        "hash-limits",
    )
    keep = (
        F.col("_cut").isNull()
        | (F.col("_hash") < F.col("_end"))
        | ((F.col("_hash") == F.col("_end")) & (F.col(id_col) <= F.col("_end_id")))
    )
    marked = hashed.join(limits, group, "left")
    return marked.select(*df.columns, (F.coalesce("_some", F.lit(False)) & keep).alias("drawn"))


def take_by_hash(
    df: DataFrame,
    group: Sequence[str],
    id_col: str,
    seed: int,
    quotas: DataFrame | int,
    hist: DataFrame | None = None,
    slim: DataFrame | None = None,
) -> DataFrame:
    """The rows that ``mark_by_hash`` draws."""
    return mark_by_hash(df, group, id_col, seed, quotas, hist, slim).where("drawn").drop("drawn")


def block_apply(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    left_id: str,
    right_id: str,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    left_rows: int = 4096,
    right_rows: int = 16384,
) -> DataFrame:
    """Run ``fn`` on every pair of blocks (left block, right block) that share ``key``.

    Each side of a key is cut into blocks of bounded size by id hash, and one task handles one
    pair of blocks, so a key with a third of all rows becomes many equal tasks. ``fn`` must return
    a reduced result (top-k rows, partial sums), never the pairs themselves.
    """
    key = list(key)
    # New column identities, so that a table may be compared with itself.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        size = F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name)
        return df.groupBy(*key).agg(size)

    grid = small_side(blocks(left, left_rows, "_nl").join(blocks(right, right_rows, "_nr"), key), "block-grid")
    lefts = (
        left.join(grid, key)
        .withColumn("_lb", F.pmod(F.xxhash64(left_id), F.col("_nl")).cast("int"))
        .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)))
        .drop("_nl", "_nr")
    )
    rights = (
        right.join(grid, key)
        .withColumn("_rb", F.pmod(F.xxhash64(right_id), F.col("_nr")).cast("int"))
        .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1)))
        .drop("_nl", "_nr")
    )
    cells = [*key, "_lb", "_rb"]
    return lefts.groupBy(*cells).cogroup(rights.groupBy(*cells)).applyInPandas(fn, schema)
