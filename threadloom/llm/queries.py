"""Queries of the training-data operators over the test tables, and the SQL where it can express them."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import alignment, bpe, language, lines, mixing, nearest, quality, ranked, shards, simhash, toxicity, urls, vectors
from threadloom.llm.tables import load
from threadloom.session import spread, stage_path


def word_bpe() -> str:
    """Definition of the public word-level tokenizer."""
    import public_tokenizers

    return bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))


def byte_bpe() -> shards.RankEncoder:
    """The public byte-level tokenizer; its id 50256 is free and pads the records."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii") as file:
        return shards.RankEncoder(file.read(), public_tokenizers.PATTERN)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(spread(load(spark, sf_dir, "documents")))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "shards")
    shards.write_shards(shards.training_order(load(spark, sf_dir, "documents"), byte_bpe(), pad=50256), path)
    return shards.read_records(spark, path)


def encoded(docs: DataFrame, definition: str, block_bytes: int = bpe.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return bpe.round_trip(docs, definition, block_bytes).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(load(spark, sf_dir, "documents"), word_bpe())


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(spread(load(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(load(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spread(load(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    # A row without an id has no remainder, so nothing is learned from it.
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spread(load(spark, sf_dir, "embeddings")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    # A row without an id has no remainder, so nothing is learned from it.
    model = toxicity.fit(docs, load(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def tokenizer_pair() -> tuple[alignment.ByteBpe, alignment.PieceBpe]:
    """The public byte-level tokenizer and the public piece tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        first = alignment.ByteBpe(file.read(), public_tokenizers.PATTERN)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return first, alignment.PieceBpe(base64.b64encode(file.read()).decode())


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(load(spark, sf_dir, "documents"), *tokenizer_pair())


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


LINE_SQL = r"""
WITH parts AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS content,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), rows_ AS (
  SELECT *, trim(content, ' ' || chr(9) || chr(13)) AS line FROM parts
), wide AS (
  SELECT line FROM rows_ WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5
), ranked AS (
  SELECT r.*, w.line IS NOT NULL AS is_wide,
         row_number() OVER (PARTITION BY r.line ORDER BY doc_id, pos) AS n
  FROM rows_ r LEFT JOIN wide w ON r.line = w.line
), marked AS (
  SELECT *, (line <> '' AND is_wide AND n > 1) AS gone FROM ranked
)
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       CASE WHEN count(*) FILTER (WHERE gone) = 0 THEN any_value(text)
            WHEN count(*) FILTER (WHERE line <> '' AND NOT gone) = 0 THEN ''
            ELSE string_agg(content, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) END AS text
FROM marked GROUP BY doc_id
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')), 1, 16) AS place FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(2.0::DOUBLE * source_size) OVER w AS spent,
         (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER w, 0.0) AS open_weight
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  -- Sources that are full come first. Clamping one too few or one too many gives a lower level than the right number.
  SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - coalesce(spent, 0.0)) / open_weight) AS level FROM levels
), targets AS (
  SELECT s.source, s.source_size, least(s.cap, l.level * s.weight) AS target FROM levels s CROSS JOIN level l
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), placed AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY place) - sum(size) OVER (PARTITION BY d.source, place) / 2.0 AS middle
  FROM sized d JOIN split t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

RANK_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), docs AS (
  SELECT doc_id, d, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
), total AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM docs
), asked AS (
  SELECT q, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, row_number() OVER () AS q,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), held AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term, nd
), scored AS (
  SELECT a.q, a.item_id, c.doc_id,
         sum(a.times * t.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * c.n * total.nd) // total.nl))))::BIGINT AS score
  FROM asked a JOIN held h USING (term) JOIN weight t USING (term) JOIN docs c USING (d), total
  GROUP BY a.q, a.item_id, h.d, c.doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_line_dedup, op3_training_order, op4_bpe, op5_nearest, op6_simhash, op7_mixing, op8_language,
        op9_quality, op10_vector_dedup, op11_toxicity, op12_alignment, op13_ranked_search,
    )
}
SQL: dict[str, str] = {"op2_line_dedup": LINE_SQL, "op7_mixing": MIX_SQL, "op13_ranked_search": RANK_SQL}
