"""Batched scoring with a pluggable function, output checks, retry and resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.session import write_stage
from threadloom.sources import cache
from threadloom.sources.tables import fill_missing

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_batches(df: DataFrame, scorer: Scorer, schema: str | T.StructType, batch_size: int = 20) -> DataFrame:
    """Call ``scorer`` on batches of at most ``batch_size`` rows, in Arrow batches on the executors.

    The scorer gets a pandas frame and returns one; rows it leaves out are missing in the result.
    """

    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                # Only these rows are Python objects at the same time, however long the texts of an Arrow batch are.
                scored = scorer(batch.slice(start, batch_size).to_pandas())
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_pandas(scored[f.name], type=f.type, safe=False) for f in target], schema=target
                )

    return df.mapInArrow(run, out)


def validate_scores(
    scored: DataFrame, allowed: Sequence[str], label: str = "predicted_intent", confidence: str = "intent_confidence",
    default_confidence: float = 0.90,
) -> DataFrame:
    """Keep rows with an allowed label and fill in a missing confidence; the others count as unanswered."""
    kept = scored.where(F.col(label).isin(*allowed))
    return kept.withColumn(confidence, F.coalesce(F.col(confidence), F.lit(default_confidence)))


def retry_missing(
    answered: DataFrame,
    df: DataFrame,
    key: str,
    score: Callable[[DataFrame], DataFrame],
    fallback: Mapping[str, object] | None = None,
    source: str = "scorer",
) -> DataFrame:
    """Score unanswered rows once more; rows still open get the fallback, marked as such.

    Results are written before the next pass reads them, so that a scorer is never run twice for
    the same row.
    """
    first, _ = write_stage(answered, "scored")
    open_rows = df.join(first.select(key), key, "left_anti").select(*df.columns)
    second, _ = write_stage(score(open_rows), "rescored")
    both = first.unionByName(second).withColumn("source", F.lit(source))
    if fallback is None:
        return both
    rest = open_rows.join(second.select(key), key, "left_anti")
    filled = rest.select(
        key,
        *[F.lit(fallback.get(f.name)).cast(f.dataType).alias(f.name) for f in first.schema if f.name != key],
        F.lit("fallback").alias("source"),
    )
    return both.unionByName(filled)


def score_incremental(
    df: DataFrame, path: str, key: str, score: Callable[[DataFrame], DataFrame], schema: str | T.StructType
) -> DataFrame:
    """Score the rows whose results ``path`` does not hold yet, append them, return all results."""
    return fill_missing(df, path, key, score, schema)


def score_cached(
    df: DataFrame, path: str, content: Sequence[str], score: Callable[[DataFrame], DataFrame], schema: str | T.StructType, version: str
) -> DataFrame:
    """``df`` with results kept by content and scorer ``version``, safe under retries and parallel runs; ``score`` keeps content_key."""
    return cache.fill(df, path, content, score, schema, version)
