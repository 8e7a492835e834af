"""Session settings, and stage tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table is broadcast only after its bytes were summed while it was written, and stay below this.
BROADCAST_BYTES = 32 << 20

_local_dir: dict[str, str] = {}
# Per thread, as a micro-batch runs in a thread of its own.
_scopes = threading.local()


def get_session(app: str = "threadloom", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; callers may override any of them.

    ``shared`` is the folder for stage tables, if the cluster does not name one in ``spark.checkpoint.dir``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shared:
        settings["spark.checkpoint.dir"] = shared
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for stage tables: ``spark.checkpoint.dir``, seen by every executor.

    Only a local session that names none gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dir:
        _local_dir[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dir[app]


def stage_path(spark: SparkSession, label: str) -> str:
    app = spark.conf.get("spark.app.id", "local")
    path = f"{shared_folder(spark)}/threadloom/{app}/{label}-{uuid.uuid4().hex[:12]}"
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    return path


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            return F.coalesce(F.size(value), F.lit(0)).cast("bigint") * 8 + 24
        each = F.transform(F.coalesce(value, F.array()), lambda x: value_bytes(x, kind.elementType))
        return F.aggregate(each, F.lit(24).cast("bigint"), lambda a, x: a + x)
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(16).cast("bigint"))
    return F.lit(16).cast("bigint")


def write_stage(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This ends the lineage at a table that outlives lost executors. ``metrics`` are aggregates
    observed while the rows are written, so no second job counts them.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    observation = Observation(label)
    metrics = {"rows": F.count(F.lit(1)), **metrics}
    observed = df.observe(observation, *[c.alias(name) for name, c in metrics.items()])
    observed.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), observation.get


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables, once the results of its jobs are written elsewhere."""
    app = spark.conf.get("spark.app.id", "local")
    _delete(spark, f"{shared_folder(spark)}/threadloom/{app}")


@contextlib.contextmanager
def own_stages(spark: SparkSession) -> Iterator[None]:
    """Delete the stage tables that are made inside, when it ends; results must be written elsewhere by then."""
    made: list[str] = []
    outer = getattr(_scopes, "open", [])
    _scopes.open = [*outer, made]
    try:
        yield
    finally:
        _scopes.open = outer
        for path in made:
            _delete(spark, path)


def small_side(df: DataFrame, label: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Write a lookup table and mark it for broadcast if its bytes, summed during the write, allow that.

    Above ``limit`` the table is returned unmarked and joins fall back to a shuffle join,
    whose plain-scan inputs adaptive execution can split on skew.
    """
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("bigint"))
    table, seen = write_stage(df, label, bytes=F.coalesce(F.sum(row), F.lit(0)))
    return F.broadcast(table) if seen["bytes"] <= limit else table


def literal_table(spark: SparkSession, rows: list, schema: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A parameter table from driver-side rows, broadcast when its size allows."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if sum(len(repr(r)) for r in rows) <= limit else table


def spread(df: DataFrame) -> DataFrame:
    """Give an input of fewer partitions than cores one partition per core.

    For text-heavy steps on a few unsplittable files. A large table has more partitions than cores
    and comes back unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
