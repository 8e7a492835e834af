import os

import pytest

from threadloom.catalog import jobs

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_job_drafts_from_all_messages(spark, monkeypatch):
    """The sample is min(2000, messages), all of it is clustered, and k lies within 5 to 15."""
    seen = {}
    draft_taxonomy = jobs.taxonomy.draft_taxonomy

    def kept(corpus, *args, **kwargs):
        seen["corpus"], seen["draft"] = corpus, draft_taxonomy(corpus, *args, **kwargs)
        return seen["draft"]

    monkeypatch.setattr(jobs.taxonomy, "draft_taxonomy", kept)
    rows = jobs.taxonomy_job(spark, SF).collect()
    assert rows and all(r["few"] and r["distinct_texts"] and r["from_corpus"] for r in rows)
    draft, messages = seen["draft"], seen["corpus"].count()
    assert draft.sample.count() == min(2000, messages)
    assert sorted(draft.scores) == list(range(5, 5 + len(draft.scores))) and draft.k in draft.scores and max(draft.scores) <= 15
    assert draft.clusters.count() == draft.k
