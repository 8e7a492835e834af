"""Raw posts to threads, brand report and tagged brand threads."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import graph, resolve, threads
from threadloom.session import write_stage
from threadloom.sources import posts as src
from threadloom.sources import tables


@dataclass(frozen=True)
class IngestPaths:
    """Tables written below the output folder."""

    rejected: str
    posts: str
    threads: str
    tagged: str
    brand_posts: str
    brand_tagged: str
    brand_candidates: str
    stats: str

    @classmethod
    def below(cls, root: str) -> IngestPaths:
        return cls(*[f"{root.rstrip('/')}/{f.name}" for f in fields(cls)])


def threaded_posts(posts: DataFrame) -> DataFrame:
    """Posts with their thread, written once; every later step reads this table."""
    return write_stage(graph.assign_threads(posts), "threaded-posts")[0]


def run_ingest(
    spark: SparkSession,
    csv_path: str,
    out: str,
    brand: str,
    rules: resolve.ResolutionRules = resolve.ResolutionRules(),
    top_n: int = 20,
    multi_line: bool = True,
) -> IngestPaths:
    """Read, check, profile, thread, report the top brands, tag the brand's threads.

    Writes the tables of ``IngestPaths`` below ``out``: Parquet, but for the brand report (CSV);
    ``stats`` is a log of step statistics. Posts without a readable id go to ``rejected``; they and the posts in threads
    must add up to the rows of the export.
    """
    paths = IngestPaths.below(out)
    # The export is parsed once; everything after reads columns.
    raw, read = write_stage(src.read_posts_csv(spark, csv_path, multi_line), "raw-posts")
    src.validate_schema(raw)
    tables.record_stats(src.profile_posts(raw), paths.stats, "load")
    tables.write_table(src.rejected_posts(raw), paths.rejected)
    rejected = tables.read_table(spark, paths.rejected).count()
    tables.record_stats(spark.createDataFrame([(read["rows"], rejected)], "raw_rows bigint, rejected_rows bigint"), paths.stats, "typed")
    typed = src.to_posts(raw).where(F.col("post_id").isNotNull())

    tables.write_table(graph.assign_threads(typed), paths.posts)
    posts = tables.read_table(spark, paths.posts)
    facts = threads.thread_facts(posts)
    tables.write_table(facts, paths.threads)
    facts = tables.read_table(spark, paths.threads)
    threads.assert_conserved(raw, facts, rejected)
    tables.record_stats(threads.thread_stats(facts), paths.stats, "threads")

    closing = resolve.closing_facts(posts, rules)
    tables.write_table(resolve.tag_resolution(closing, rules), paths.tagged)
    tagged = tables.read_table(spark, paths.tagged)
    tables.write_report_csv(resolve.brand_candidates(posts, tagged, top_n), paths.brand_candidates)

    tables.write_table(resolve.brand_threads(posts, brand), paths.brand_posts)
    brand_posts = tables.read_table(spark, paths.brand_posts)
    own = resolve.closing_facts(brand_posts, rules, brand)
    tables.write_table(resolve.tag_resolution(own, rules, resolve.dataset_max_time(tagged)), paths.brand_tagged)
    brand_tagged = tables.read_table(spark, paths.brand_tagged)
    tables.record_stats(resolve.outcome_totals(brand_tagged), paths.stats, "brand")
    return paths
