import hashlib
import pathlib
import subprocess
import sys

import numpy as np
import pytest
from helpers import docs, frame

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_lines import plain as plain_lines  # noqa: E402
from test_mixing import plain_targets  # noqa: E402
from test_quality import corpus  # noqa: E402
from test_shingles import roots  # noqa: E402

from threadloom.llm import lines, quality  # noqa: E402
from threadloom.llm.queries import word_bpe  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROOT = pathlib.Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with junk, a line on many sites, copies and near copies; run through all stages."""
    texts, bad = corpus(150, 8)
    rng = np.random.default_rng(8)
    texts = [t if b or i % 2 else "Subscribe to our letter.\n" + t for i, (t, b) in enumerate(zip(texts, bad))]
    texts += [texts[i] for i in range(0, 30, 3)] + [None, "", *(t + " end" for t in texts[40:44])]
    sources = [f"s{rng.integers(0, 8)}" if i % 9 else None for i in range(len(texts))]
    folder = tmp_path_factory.mktemp("sf")
    docs(spark, texts, sources).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    steps = [spark.read.parquet(str(folder / "documents.parquet"))]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], str(folder)).write.parquet(str(folder / f"step{number}"))
        steps.append(spark.read.parquet(str(folder / f"step{number}")))
    return folder, steps, bad


def rows_of(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_stage_order_and_columns(made):
    _, steps, _ = made
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing", "BPE"]
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_quality_stage(made):
    _, steps, bad = made
    scorer = quality.fit(steps[0])
    want = [r for r in rows_of(steps[0]) if scorer.score([(r[1] or "").encode()])[0] >= quality.KEEP]
    assert rows_of(steps[1]) == want
    assert sum(bad[r[0]] for r in want if r[0] < len(bad)) <= 0.1 * bad.sum()


def test_line_stage(made):
    _, steps, _ = made
    before = rows_of(steps[1])
    want = plain_lines([(r[0], r[1], r[3]) for r in before], lines.MIN_SITES)
    assert [r[1] for r in rows_of(steps[2])] == [want[i] for i in range(len(before))]
    assert [r[4] for r in rows_of(steps[2])] == [len(want[i]) for i in range(len(before))]
    assert sum("Subscribe" in r[1] for r in rows_of(steps[2])) == 1


def test_simhash_stage(made):
    _, steps, _ = made
    before = rows_of(steps[2])
    # By comparing the five-word shingles of all pairs: of texts that a chain of similarities of 0.8 or more joins, the first stays.
    first = roots([r[1] for r in before])
    assert rows_of(steps[3]) == [r for place, (r, f) in enumerate(zip(before, first)) if place == f]
    assert len(rows_of(steps[3])) < len(before)


def test_mixing_stage(made):
    _, steps, _ = made
    before, after = rows_of(steps[3]), rows_of(steps[4])
    assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 2
    size = lambda r: len(r[1].split())
    sizes = {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    for source, target in plain_targets(sizes).items():
        assert abs(sum(size(r) for r in after if r[3] == source) - target) <= max(map(size, before))


def test_bpe_stage_and_run(spark, made):
    folder, steps, _ = made
    tokenizer = tokenizers.Tokenizer.from_str(word_bpe())
    want = []
    for key, text, *_ in rows_of(steps[4]):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, steps[5].collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(folder)).collect())) == sorted(want)


def test_empty_documents(spark, tmp_path):
    frame(spark, [], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_without_these_folders(tmp_path):
    """The other queries stay when the folder and the pipeline are gone."""
    for name in ("__spark_entry__.py", "threadloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "threadloom"
    package.mkdir()
    for item in (ROOT / "threadloom").iterdir():
        if item.name not in ("llm", "__pycache__"):
            (package / item.name).symlink_to(item)
    code = (
        "import importlib.util as u, sys; sys.path.insert(0, sys.argv[1]);"
        "s = u.spec_from_file_location('entry', sys.argv[1] + '/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m);"
        "q = m.queries(); assert len(q) > 90 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    )
    subprocess.run([sys.executable, "-B", "-c", code, str(tmp_path)], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
