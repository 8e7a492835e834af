"""Resolution of every thread, kept current while its posts arrive.

Posts are reduced to one row per thread in each Arrow batch before the shuffle, so a thread with a third of all posts sends few rows.
The state of a thread is one row of fixed size: its first and last post, its last customer post, who took part, and the number of
posts. Each micro-batch writes a record of every thread it touched, with a version. A timer fires once the watermark passes the
dormancy time after the last post, and the record is written again as dormant. A post that comes later reopens the thread: its facts
are still there, so the next record is a correction, and ends as the batch rules say of all its posts.

Defined cases: posts without a time sort last, as in batch; a thread with such a post has no end and counts as dormant at once. Posts
may come in any order within ``late``; older ones are left out, as by any watermark, unless they arrive in one Arrow batch with a younger
post of their thread. Times are compared to the millisecond. Every post must have its thread_key, post_id and direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.operators.resolve import ResolutionRules, has_closure, reasoned
from threadloom.sources.tables import latest_per_key

KEY = ["untimed", "at", "post_id"]


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per thread of a batch of posts."""
    for frame in frames:
        if frame.empty:
            continue
        frame = frame.sort_values(KEY)
        first = frame.drop_duplicates("thread_key").set_index("thread_key")
        last = frame.drop_duplicates("thread_key", keep="last").set_index("thread_key").reindex(first.index)
        # The last customer post; of a thread without one, its last post, which is never grateful.
        asked = frame.sort_values(["inbound", *KEY]).drop_duplicates("thread_key", keep="last").set_index("thread_key").reindex(first.index)
        groups = frame.groupby("thread_key")
        out = pd.DataFrame({
            "posts": groups.size(), "has_brand": groups["by_brand"].any(), "clock": groups["created_at"].max(),
        }).reindex(first.index)
        for name, side in (("first", first), ("last", last), ("asked", asked)):
            for column in (*KEY, "inbound"):
                out[f"{name}_{column}"] = side[column]
        out["grateful"] = asked["grateful"]
        yield out.reset_index()


def _merge(held: dict | None, new: dict) -> dict:
    if held is None:
        return dict(new)
    out = {"posts": held["posts"] + new["posts"], "has_brand": held["has_brand"] or new["has_brand"]}

    def take(name: str, ours: bool, extra: tuple[str, ...] = ()) -> None:
        side = held if ours else new
        out.update({f"{name}_{c}": side[f"{name}_{c}"] for c in (*KEY, "inbound")} | {c: side[c] for c in extra})

    def at(row: dict, name: str) -> tuple:
        return tuple(row[f"{name}_{c}"] for c in KEY)

    take("first", at(held, "first") <= at(new, "first"))
    take("last", at(held, "last") >= at(new, "last"))
    asked = (held["asked_inbound"], *at(held, "asked")) >= (new["asked_inbound"], *at(new, "asked"))
    take("asked", asked, ("grateful",))
    return out


def thread_states(
    posts: DataFrame, rules: ResolutionRules = ResolutionRules(), late: str = "1 hour", brand: str | None = None, keep_hours: float | None = None
) -> DataFrame:
    """A stream of records (thread_key, version, thread_id, thread_length, end_time, dormant, resolution_reason, resolved).

    ``posts`` is a stream that carries thread_key, post_id, inbound, created_at and text, and author_id if a ``brand`` is given, whose inbound
    posts then count as the brand's. A thread's state is kept for ``keep_hours`` after it went dormant, by default for ever; a post
    that comes after that starts the thread anew.
    """
    by_brand: Column = ~F.col("inbound")
    if brand is not None:
        by_brand = by_brand | F.coalesce(F.lower("author_id") == brand.lower(), F.lit(False))
    slim = posts.select(
        "thread_key", "post_id", "inbound", "created_at", by_brand.alias("by_brand"),
        F.col("created_at").isNull().alias("untimed"), F.coalesce(F.unix_micros("created_at"), F.lit(0)).alias("at"),
        (F.col("inbound") & F.coalesce(has_closure(F.col("text"), rules), F.lit(False))).alias("grateful"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    sides = [(f"{side}_{c}", kinds[c]) for side in ("first", "last", "asked") for c in (*KEY, "inbound")]
    facts = [("posts", "bigint"), ("has_brand", "boolean"), *sides, ("grateful", "boolean")]
    names = [name for name, _ in facts]
    schema = ", ".join(f"{name} {kind}" for name, kind in facts)
    reduced = slim.mapInPandas(_partial, f"thread_key {kinds['thread_key']}, clock timestamp, {schema}")

    gap = round(rules.inactivity_hours * 3_600_000)
    keep = None if keep_hours is None else round(keep_hours * 3_600_000)
    shown = ["version", "dormant", "thread_length", "first_id", "last_untimed", "last_at", "customer_last", "has_customer", "has_brand", "grateful"]

    def record(key: tuple, held: dict, version: int, dormant: bool) -> pd.DataFrame:
        values = (
            version, dormant, held["posts"], held["first_post_id"], held["last_untimed"], held["last_at"],
            held["last_inbound"], held["asked_inbound"], held["has_brand"], held["grateful"],
        )
        return pd.DataFrame([(key[0], *values)], columns=["thread_key", *shown])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version, closed = None, 0, False
        if state.exists:
            *values, version, closed = state.get
            held = dict(zip(names, values))
        if state.hasTimedOut:
            if closed:
                state.remove()
                return
            dormant = True
        else:
            for frame in frames:
                for new in frame[names].to_dict("records"):
                    held = _merge(held, new)
            due = held["last_at"] // 1000 + gap
            dormant = held["last_untimed"] or due <= state.getCurrentWatermarkMs()
        # Above the versions of an earlier, forgotten state of the thread too.
        version = max(version + 1, state.getCurrentWatermarkMs())
        state.update((*(held[n] for n in names), version, dormant))
        due = held["last_at"] // 1000 + gap
        if not dormant:
            # A timer fires once the watermark is above it.
            state.setTimeoutTimestamp(max(due - 1, state.getCurrentWatermarkMs() + 1))
        elif keep is not None:
            state.setTimeoutTimestamp(max(due + keep, state.getCurrentWatermarkMs() + 1))
        yield record(key, held, version, dormant)

    records = (
        reduced.withWatermark("clock", late)
        .groupBy("thread_key")
        .applyInPandasWithState(
            step,
            f"thread_key {kinds['thread_key']}, version bigint, dormant boolean, thread_length bigint, first_id {kinds['post_id']}, last_untimed boolean, "
            "last_at bigint, customer_last boolean, has_customer boolean, has_brand boolean, grateful boolean",
            f"{schema}, version bigint, closed boolean",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return reasoned(records, ~F.col("dormant"), rules).select(
        "thread_key", "version", F.concat(F.lit("T_"), F.col("first_id").cast("string")).alias("thread_id"), "thread_length",
        F.when(~F.col("last_untimed"), F.timestamp_micros("last_at")).alias("end_time"), "dormant", "resolution_reason", "resolved",
    )


def thread_state_stream(
    posts: DataFrame, out: str, checkpoint: str, rules: ResolutionRules = ResolutionRules(), late: str = "1 hour", brand: str | None = None,
    keep_hours: float | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Append the records of ``thread_states`` to ``out``. For many open threads, choose the state store that keeps its rows on disk."""
    records = thread_states(posts, rules, late, brand, keep_hours)
    writer = records.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """Every thread's latest record."""
    return latest_per_key(spark.read.parquet(out), ["thread_key"], [F.desc("version")])
