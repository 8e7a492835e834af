import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, threads

SCHEMA = (
    "post_id bigint, author_id string, inbound boolean, created_at string, text string, "
    "response_ids string, in_response_to_id bigint"
)


def make(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("created_at", F.try_to_timestamp("created_at"))


@pytest.fixture()
def small(spark):
    day = "2017-10-31 "
    return make(
        spark,
        [
            (101, "cust1", True, day + "10:00:00", "Help", "102,103", None),
            (102, "brandA", False, day + "10:05:00", "Which version?", "104", 101),
            (103, "brandA", False, day + "10:06:00", "Try restarting", None, 101),
            (104, "cust1", True, day + "10:10:00", "Thanks, restarting worked!", None, 102),
            (105, "cust2", True, day + "11:00:00", "A ride?", "106", 9999),
            (106, "brandB", False, day + "11:05:00", "On it", None, 105),
            (107, "cust3", True, day + "12:00:00", "Hello", None, None),
        ],
    )


def test_threads_of_branch_broken_link_and_single(small):
    posts = graph.assign_threads(small)
    built = {r["thread_id"]: r for r in threads.build_threads(posts).collect()}
    assert {k: r["post_ids"] for k, r in built.items()} == {
        "T_101": [101, 102, 103, 104], "T_105": [105, 106], "T_107": [107]
    }
    assert [built[k]["has_branching"] for k in ("T_101", "T_105", "T_107")] == [True, False, False]
    assert built["T_101"]["brands"] == ["brandA"] and built["T_107"]["brands"] == []
    facts = threads.thread_facts(posts)
    threads.assert_conserved(small, facts)
    with pytest.raises(threads.ConservationError):
        threads.assert_conserved(small, facts.where("thread_id <> 'T_107'"))


def test_edges_skip_blank_malformed_and_absent(spark, rows):
    posts = make(
        spark,
        [
            (1, "a", True, None, "", " 2 , , x, 3.0,99", None),
            (2, "b", False, None, "", None, 1),
            (3, "b", False, None, "", "", 77),
        ],
    )
    assert rows(graph.reply_edges(posts)) == [(1, 2, "children"), (1, 3, "children"), (2, 1, "parent")]


def test_orphans_of_one_missing_parent_branch_in_separate_threads(spark, rows):
    posts = make(spark, [(1, "a", True, None, "", None, 50), (2, "b", True, None, "", None, 50), (3, "c", True, None, "", "4", None), (4, "d", True, None, "", None, None)])
    got = graph.assign_threads(posts)
    assert rows(got, "post_id", "thread_key", "branching") == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 3, False)]


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shapes():
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(1, 120)]
    shuffled = list(range(1, 200))
    rng.shuffle(shuffled)
    return {
        "none": [],
        "loops": [(4, 4), (5, 5)],
        "path": path,
        "shuffled path": list(zip(shuffled, shuffled[1:])),
        "star in": [(500, i) for i in range(1, 200)],
        "star out": [(1, i) for i in range(2, 200)],
        "two hubs": [(900, i) for i in range(1, 100)] + [(800, i) for i in range(100, 200)] + [(900, 800)],
        "reversed tree": [(1000 - i, 1000 - (i - 1) // 2) for i in range(1, 127)],
        "cycle": path + [(120, 1)],
        "random": [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(220)],
        "doubled": path + path + [(b, a) for a, b in path],
    }


@pytest.mark.parametrize("shape", list(shapes()))
def test_components_agree_with_union_find(spark, shape):
    edges = shapes()[shape]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    nodes = {n for e in edges for n in e}
    found = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    want = union_find(nodes, edges)
    assert {n: found.get(n, n) for n in nodes} == want


def test_missing_times_sort_last_and_ties_go_by_id(spark):
    posts = make(
        spark,
        [
            (3, "a", True, None, "late", None, 1),
            (2, "b", False, "2020-01-01 00:00:00", "b", None, 1),
            (1, "c", True, "2020-01-01 00:00:00", "a", None, None),
        ],
    )
    row = threads.build_threads(graph.assign_threads(posts)).first()
    assert row["post_ids"] == [1, 2, 3] and row["end_time"] is None and row["thread_id"] == "T_1"


def test_long_thread_continues_in_parts(spark):
    posts = make(spark, [(i, "a", i % 2 == 1, None, f"m{i}", None, i - 1 if i > 1 else None) for i in range(1, 26)])
    parts = sorted(threads.build_threads(graph.assign_threads(posts), chunk=10).collect(), key=lambda r: r["part"])
    assert [len(p["post_ids"]) for p in parts] == [10, 10, 5]
    assert sum((p["post_ids"] for p in parts), []) == list(range(1, 26))
    assert {p["thread_length"] for p in parts} == {25}


@pytest.mark.parametrize("max_bytes", [600, 2000])
def test_parts_are_cut_at_a_byte_limit(spark, max_bytes):
    """A thread of few but long posts, one of them above the limit by itself, beside a short one."""
    sizes = [100, 100, 400, 5000, 10, 10, None, 700, 0, 30, 300, 300, 300, 100]
    rows = [(i + 1, "a", i % 2 == 0, None, None if n is None else chr(97 + i) * n, None, i if i else None) for i, n in enumerate(sizes)]
    keyed = graph.assign_threads(make(spark, [*rows, (99, "b", True, None, "short", None, None)]))
    built = sorted(threads.build_threads(keyed, max_bytes=max_bytes).collect(), key=lambda r: (r["thread_key"], r["part"]))
    assert built[-1]["post_ids"] == [99]
    mine = built[:-1]
    assert [p["part"] for p in mine] == list(range(len(mine))) and len(mine) > 1
    assert sum((p["post_ids"] for p in mine), []) == list(range(1, len(sizes) + 1))
    for p in mine:
        held = [len(t or "") + 129 for t in p["texts"]]
        assert sum(held) <= max(max_bytes, max_bytes // 2 + held[-1])
    parts = [r["transcript"] for r in threads.transcripts(keyed, max_bytes=max_bytes).where("thread_key = 1").orderBy("part").collect()]
    assert "\n".join(parts) == threads.transcripts(keyed).where("thread_key = 1").first()["transcript"] and len(parts) > 1
    assert all(len(t.split("\n")) == 1 or len(t) <= max(max_bytes, max_bytes // 2 + len(t.split("\n")[-1]) + 1) for t in parts)


def test_explode_threads_restores_posts(small, rows):
    posts = graph.assign_threads(small)
    back = threads.explode_threads(threads.build_threads(posts))
    columns = ("thread_key", "post_id", "author_id", "inbound", "text", "in_response_to_id")
    assert rows(back, *columns) == rows(posts, *columns)


def load_posts(spark, rows):
    return spark.createDataFrame(rows, "post_id bigint, in_response_to_id bigint, response_ids string").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_loads_equal_one_full_run(spark, seed):
    """Posts in any order of loads, with parents that come later or never, children's lists, and posts that come again."""
    rng = random.Random(seed)
    rows = []
    for i in range(1, 160):
        parent = rng.choice([None, None, rng.randint(1, 170), max(1, i - 1)])
        listed = rng.choice([None, None, None, f"{rng.randint(1, 170)}, x, {rng.randint(1, 170)}"])
        rows.append((i, parent, listed))
    rng.shuffle(rows)
    state = graph.ThreadState.empty(spark)
    for at in range(0, len(rows), 53):
        state = graph.add_posts(state, load_posts(spark, rows[at : at + 53] + rows[:3]))
    whole = graph.assign_threads(load_posts(spark, rows))
    want = {r["post_id"]: r["thread_key"] for r in whole.collect()}
    assert {r["post_id"]: r["thread_key"] for r in state.threads.collect()} == want
    assert state.threads.count() == len(rows)
    ids = {r[0] for r in rows}
    assert all(r["dst"] not in ids for r in state.pending.collect())


def test_empty_load_changes_nothing(spark, tmp_path):
    state = graph.add_posts(graph.ThreadState.empty(spark), load_posts(spark, [(1, None, None), (2, 1, None), (3, 9, None)]))
    state.write(str(tmp_path / "state"))
    again = graph.add_posts(graph.ThreadState.read(spark, str(tmp_path / "state")), load_posts(spark, []))
    assert sorted(map(tuple, again.threads.collect())) == [(1, 1), (2, 1), (3, 3)]
    assert [tuple(r) for r in again.pending.collect()] == [(3, 9)]
