"""The intent taxonomy as a small YAML document and as a table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from threadloom import presets
from threadloom.session import literal_table

SCHEMA = "intent string, description string, escalate boolean, examples array<struct<post_id:string,text:string>>"


@dataclass(frozen=True)
class Intent:
    name: str
    description: str
    escalate: bool = False
    examples: tuple[tuple[str, str], ...] = field(default=())


def default_taxonomy() -> list[Intent]:
    return [Intent(name, text, escalate) for name, text, escalate, _ in presets.INTENTS]


def read_taxonomy(spark: SparkSession, path: str) -> list[Intent]:
    """Intents of a YAML file on any store that Spark reads; a missing policy flag counts as False."""
    text = spark.read.text(path, wholetext=True).first()
    document = yaml.safe_load(text[0] if text else "") or {}
    return [
        Intent(
            item["intent_name"],
            item.get("description", ""),
            bool(item.get("escalation_default", False)),
            tuple((str(e["tweet_id"]), str(e["text"])) for e in item.get("representative_examples") or ()),
        )
        for item in document.get("intents") or []
    ]


def write_taxonomy(spark: SparkSession, intents: Iterable[Intent], path: str, **metadata: str) -> None:
    """One YAML file, written intent by intent, on any store that Spark writes."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)

    def put(value: object) -> None:
        out.write(bytearray(yaml.safe_dump(value, sort_keys=False, allow_unicode=True).encode("utf-8")))

    try:
        total = 0
        out.write(bytearray(b"intents:\n"))
        for i in intents:
            total += 1
            examples = [{"tweet_id": p, "text": t} for p, t in i.examples]
            put([{"intent_name": i.name, "description": i.description, "escalation_default": i.escalate, "representative_examples": examples}])
        put({"metadata": {**metadata, "total_intents": total}})
    finally:
        out.close()


def taxonomy_table(spark: SparkSession, intents: list[Intent]) -> DataFrame:
    """One row per intent, for joins; broadcast, as its length is known here."""
    rows = [(i.name, i.description, i.escalate, [tuple(e) for e in i.examples]) for i in intents]
    return literal_table(spark, rows, SCHEMA)


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy_table(spark, read_taxonomy(spark, path))


def save_taxonomy(intents: DataFrame, path: str, **metadata: str) -> None:
    """Write a taxonomy table as YAML; the driver holds one partition of it at a time."""
    rows = intents.select("intent", "description", "escalate", "examples").toLocalIterator()
    kept = (
        Intent(r["intent"], r["description"], r["escalate"], tuple((e["post_id"], e["text"]) for e in r["examples"] or ()))
        for r in rows
    )
    write_taxonomy(intents.sparkSession, kept, path, **metadata)
