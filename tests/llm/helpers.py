"""Small fixtures shared by the tests of the training-data operators."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def docs(spark, texts, sources=None, langs=None, ids=None, extra=""):
    rows = [
        (
            ids[i] if ids else i,
            t,
            langs[i] if langs else "en",
            sources[i] if sources else f"src{i % 3}",
            len(t or ""),
            *(["x"] * len(extra.split(",")) if extra else []),
        )
        for i, t in enumerate(texts)
    ]
    schema = DOCS + "".join(f", {name} string" for name in extra.split(",") if name)
    return frame(spark, rows, schema)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
