"""First messages to a draft taxonomy, and labels for the whole corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.operators import messages as ms
from threadloom.operators import ml, reports, sampling, threads
from threadloom.session import write_stage


@dataclass(frozen=True)
class Draft:
    sample: DataFrame
    scores: dict[int, float]
    k: int
    clusters: DataFrame
    exemplars: DataFrame


def message_corpus(posts: DataFrame, tagged: DataFrame, brand: str, cutoff: str = "2017-10") -> DataFrame:
    """First messages with outcome, strata and a written form to draw from."""
    firsts = threads.first_messages(posts, brand).join(
        tagged.select("thread_key", "resolved", "resolution_reason"), "thread_key"
    )
    return write_stage(ms.assign_strata(firsts, cutoff), "messages")[0]


def draft_taxonomy(
    corpus: DataFrame,
    size: int = 2000,
    k_min: int = 5,
    k_max: int = 15,
    k: int | None = None,
    seed: int = 42,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    rules: Sequence[tuple[str, str, str]] = presets.CLUSTER_RULES,
    per_cluster: int = 15,
) -> Draft:
    """Stratified sample, embedding, k sweep, nearest exemplars, labels."""
    sample = sampling.stratified_sample(corpus, ["stratum"], size, "post_id", seed)
    if embedder is None:
        model = ml.embedding_model(sample, "cleaned_text")
        embedder = lambda rows: ml.embed(rows, model)
    vectors, _ = write_stage(embedder(sample), "sample-vectors")
    scores, best, models = ml.kmeans_sweep(vectors, k_min, k_max, seed=seed)
    chosen = k or best
    clustered, _ = write_stage(ml.kmeans_assign(vectors, models[chosen]), "clustered")
    exemplars, _ = write_stage(
        ml.cluster_exemplars(clustered, ml.cluster_centers(clustered), "post_id", per_cluster), "exemplars"
    )
    labels = reports.label_clusters(exemplars, rules=rules, per_cluster=per_cluster)
    profile = ml.cluster_profile(clustered, exemplars).join(labels, "cluster")
    return Draft(clustered, scores, chosen, profile, exemplars)


def consolidated(draft: Draft, specs: Sequence[tuple[str, str, bool, str]] = presets.INTENTS) -> DataFrame:
    """Intents with their example texts as a taxonomy table; intents without examples are kept."""
    placed = draft.exemplars.withColumn("place", F.struct("cluster", "rank"))
    examples = ml.consolidate_taxonomy(placed, specs).groupBy("intent").agg(
        F.array_sort(F.collect_list(F.struct("example_no", "post_id", "text"))).alias("e")
    )
    listed = F.transform("e", lambda x: F.struct(x["post_id"].cast("string").alias("post_id"), x["text"].alias("text")))
    spark = draft.sample.sparkSession
    names = spark.createDataFrame([s[:3] for s in specs], "intent string, description string, escalate boolean")
    return names.join(examples, "intent", "left").select("intent", "description", "escalate", listed.alias("examples"))


def composite_sample(corpus: DataFrame, draft: Draft, size: int = 6000, seed: int = 42, resolved_only: bool = True) -> DataFrame:
    """Project the sample's clusters on the corpus and draw over period and cluster, exactly ``size`` rows.

    Only messages of resolved threads are drawn, unless ``resolved_only`` is off.
    """
    corpus = corpus.where(F.col("resolved") == "true") if resolved_only else corpus
    sample = draft.sample.select("cleaned_text", F.col("cluster").cast("string").alias("cluster"))
    projected = ml.propagate_labels(sample, corpus, "cluster", "cleaned_text", "cluster")
    strata, _ = write_stage(ms.composite_stratum(projected), "projected")
    return sampling.exact_sample(strata, ["composite_stratum"], size, "post_id", seed)
