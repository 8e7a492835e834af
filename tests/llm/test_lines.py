import random

from helpers import docs, table

from threadloom.llm import lines


def plain(rows, min_sites):
    """rows: (id, text, site). Cleaned texts by row number."""
    bare = lambda line: line.strip(" \t\r")
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if bare(line) and site is not None:
                sites.setdefault(bare(line), set()).add(site)
    wide = {line for line, s in sites.items() if len(s) >= min_sites}
    out, seen = {}, set()
    for at in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        text = rows[at][1]
        if text is None:
            out[at] = None
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            b = bare(line)
            if b in wide and b in seen:
                gone += 1
                continue
            seen.add(b)
            kept.append(line)
        out[at] = text if not gone else "\n".join(kept) if any(map(bare, kept)) else ""
    return out


def test_as_brute_force(spark):
    rng = random.Random(1)
    shared = [f"shared line {i}" for i in range(40)]
    texts, sources = [], []
    for i in range(400):
        own = [f"own {i} {j}" for j in range(rng.randint(0, 4))]
        body = own + rng.sample(shared, rng.randint(0, 3)) + ["", " \t"] * rng.randint(0, 1)
        body += ["everywhere"] * rng.randint(0, 2)
        rng.shuffle(body)
        texts.append("\n".join(rng.choice(["", " "]) + b for b in body) if body else rng.choice(["", None]))
        sources.append(rng.choice([None, *(f"site{k}" for k in range(12))]))
    frame = docs(spark, texts, sources, extra="row,doc,line,gone")
    got = lines.dedup_lines(frame)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    want = plain(list(zip(range(400), texts, sources)), lines.MIN_SITES)
    found = table(got)
    assert {i: found[i]["text"] for i in range(400)} == want
    assert sum(r["n_removed"] for r in found.values()) > 100


def test_counts_beyond_exact_sketches(spark):
    """Lines on 995 to 1005 sites, a threshold of 1000: only exact counts can tell them apart."""
    rows = [(k * 2000 + s, f"line {k}", "en", f"site {s}", 1) for k in range(995, 1006) for s in range(k)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wide = lines.wide_lines(lines.line_rows(frame, "doc_id", "text", "source"), 1000)
    assert wide.count() == 6


def test_remove_everywhere(spark):
    frame = docs(spark, ["menu\nown %d" % i for i in range(6)], sources=[f"s{i}" for i in range(6)])
    got = table(lines.dedup_lines(frame, keep_first=False))
    assert [got[i]["text"] for i in range(6)] == ["own %d" % i for i in range(6)]


def test_repeated_rows_null_ids_and_long_lines(spark):
    long = "x" * 200_000
    texts = [long + "\nown"] * 2 + [long] * 6 + [long + "\nnull id"]
    frame = docs(spark, texts, sources=[f"s{i}" for i in range(9)], ids=[1, 1, 3, 4, 5, 6, 7, 8, None])
    got = sorted((r["doc_id"] or 0, r["text"][-7:], r["n_removed"]) for r in lines.dedup_lines(frame).collect())
    assert got == [(0, "null id", 1), (1, "xxx\nown", 0), (1, "xxx\nown", 0)] + [(i, "", 1) for i in range(3, 9)]


def test_empty_table(spark):
    assert lines.dedup_lines(docs(spark, ["a"]).where("false")).collect() == []
