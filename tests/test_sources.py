import csv
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.functions.values import half_even, to_id
from threadloom.operators import score
from threadloom.sources import posts as src
from threadloom.sources import tables, taxonomy

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,c1,True,Tue Oct 31 22:10:47 +0000 2017,"two
lines, ""quoted""",2.0,
2,AcmeCare,False,Tue Oct 31 22:20:47 +0000 2017,reply,,1.0
x3,c2,True,yesterday,,,
'''


@pytest.fixture()
def raw(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(CSV, encoding="utf-8")
    return src.read_posts_csv(spark, str(path))


def test_csv_keeps_quotes_and_line_breaks(raw):
    src.validate_schema(raw)
    posts = src.to_posts(raw).orderBy(F.col("post_id").asc_nulls_last()).collect()
    assert posts[0]["text"] == 'two\nlines, "quoted"'
    assert [(p["post_id"], p["inbound"], p["in_response_to_id"]) for p in posts] == [(1, True, None), (2, False, 1), (None, True, None)]


def test_csv_columns_go_by_name(spark, tmp_path):
    """Columns in another order, one more, and one missing."""
    path = tmp_path / "other.csv"
    path.write_text("text,extra,tweet_id,author_id,created_at,inbound,in_response_to_tweet_id,response_tweet_id\nhello,x,7,c1,2017-01-01 00:00:00,True,,9\n")
    post = src.to_posts(src.read_posts_csv(spark, str(path))).first()
    assert (post["post_id"], post["text"], post["inbound"], post["response_ids"]) == (7, "hello", True, "9")
    short = tmp_path / "short.csv"
    short.write_text("tweet_id,author_id,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,c1,2017-01-01 00:00:00,hello,,\n")
    with pytest.raises(src.SchemaError, match="inbound"):
        src.read_posts_csv(spark, str(short))


@pytest.mark.parametrize("bytes_per_split", [100, 128 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_is_split_at_any_byte(spark, tmp_path, bytes_per_split, newline):
    """Texts with line breaks, quotes, commas and blank lines, in files cut into blocks of a few bytes."""
    rng = random.Random(4)
    pieces = ["a", "b c", ",", '"', "\n", "\n\n", "é", "x" * 30]
    rows, folder = [], tmp_path / "csv"
    folder.mkdir()
    for part in range(3):
        with open(folder / f"{part}.csv", "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, lineterminator=newline)
            out.writerow(src.RAW_COLUMNS)
            for i in range(40):
                text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
                rows.append((str(part * 100 + i), f"c{i}", "True", "2017-01-01 00:00:00", text, "", "1"))
                out.writerow(rows[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_per_split)
    try:
        got = src.read_posts_csv(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    strip = lambda r: tuple((v or "").strip(" ") for v in r)
    assert sorted(map(strip, got)) == sorted(map(strip, rows))


def spark_rows(spark, path):
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return sorted(map(tuple, reader.csv(path).select(*src.RAW_COLUMNS).collect()), key=repr)


def split_rows(spark, path, bytes_per_split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_per_split)
    try:
        return sorted(map(tuple, src.read_posts_csv(spark, path).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def bare(rows):
    """Rows without the odd quotes and line breaks at the end of a record."""
    return sorted((tuple(v and v.rstrip('"\r\n') or None for v in r) for r in rows), key=repr)


STRAY = [
    '1,c1,True,t,my 5" screen broke,,',
    '2,c1,True,t,"all ""good"" now",,',
    '3,c1,True,t,"two\nlines, and a comma",,',
    '4,c1,True,t,"closed" then more,,',
    '5,c1,True,t,plain,,',
    '6,c1,True,t,"closed" then, more,',
    '7,c1,True,t,"",,',
    '8,c1,True,t,"x""",,"3,4"',
    '9,c1,True,t,"a\n\nb" c,,',
    '10,c1,True,t,"""",,',
]


@pytest.mark.parametrize("bytes_per_split", [64, 128 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("unclosed", [False, True])
def test_csv_gives_the_rows_of_the_whole_file_reader(spark, tmp_path, bytes_per_split, newline, unclosed):
    """Stray, doubled and unclosed quotes, in several files and cut into blocks of a few bytes."""
    for part, rows in enumerate((STRAY, STRAY[3:] + STRAY[:4], STRAY[::-1])):
        rows = rows + (['11,c1,True,t,"never closed', "12,c1,True,t,plain,,", "13,c1,True,t,x,,"] if unclosed and part == 1 else [])
        text = newline.join([",".join(src.RAW_COLUMNS), *(r.replace("\n", newline) for r in rows), ""])
        (tmp_path / f"{part}.csv").write_bytes(text.encode())
    want = spark_rows(spark, str(tmp_path))
    assert len(want) == (32 if unclosed else 31)
    assert bare(split_rows(spark, str(tmp_path), bytes_per_split)) == bare(want)


@pytest.mark.parametrize("seed", range(4))
def test_csv_of_random_quotes(spark, tmp_path, seed):
    """Any sequence of quotes, commas, blanks and line breaks; unequal numbers of fields included."""
    rng = random.Random(seed)
    for part in range(8):
        body = "".join(rng.choice(['"', '"', ",", ",", "a", " ", "\n", '""', '"\n', ',"']) for _ in range(rng.randint(0, 120)))
        (tmp_path / f"{part}.csv").write_text(",".join(src.RAW_COLUMNS) + "\n" + body + "\n", encoding="utf-8")
    assert bare(split_rows(spark, str(tmp_path), 40)) == bare(spark_rows(spark, str(tmp_path)))


def test_csv_record_of_an_unclosed_quote_is_refused(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(",".join(src.RAW_COLUMNS) + '\n1,c1,True,t,"open,,\n' + "2,c1,True,t,plain,,\n" * 200, encoding="utf-8")
    assert src.csv_records(spark, str(path)).count() == 1
    with pytest.raises(src.SchemaError, match="record 2 of .*raw.csv has"):
        src.csv_records(spark, str(path), record_bytes=1000)


def test_ids_are_exact(spark):
    texts = ["12", " 12 ", "12.0", "12.9", "9007199254740993.0", "9007199254740993", "x3", "", None, "1.5E3", "-4", "99999999999999999999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(to_id(F.col("t"))).collect()
    assert [r[0] for r in rows] == [12, 12, 12, None, 9007199254740993, 9007199254740993, None, None, None, 1500, -4, None]


def test_rejected_posts(raw):
    assert [r["tweet_id"] for r in src.rejected_posts(raw).collect()] == ["x3"]


def test_profile(raw):
    row = src.profile_posts(raw).first()
    assert (row["total_rows"], row["inbound_count"], row["inbound_pct"]) == (3, 2, 66.67)
    assert (row["malformed_dates"], row["malformed_ids"], row["null_text"]) == (1, 1, 1)


def test_schema_errors(raw):
    with pytest.raises(src.SchemaError, match="inbound"):
        src.validate_schema(raw.drop("inbound"))
    with pytest.raises(src.SchemaError, match="no rows"):
        src.validate_schema(raw.where("false"))


def test_tables_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, intent string")
    tables.write_table(df, str(tmp_path / "t"), ["intent"])
    assert (tmp_path / "t" / "intent=a").is_dir()
    assert tables.read_table(spark, str(tmp_path / "t"), ["id"]).count() == 2
    tables.write_report_csv(df, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    for _ in range(2):
        tables.append_event_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    document = tmp_path / "doc.json"
    document.write_text('[{"id": 1,\n "nested": {"ok": true}}, {"id": 2}]')
    back = tables.read_json_document(spark, str(document), "id int, nested struct<ok:boolean>")
    assert sorted((r["id"], r["nested"] and r["nested"]["ok"]) for r in back.collect()) == [(1, True), (2, None)]
    tables.write_results_json(back, str(tmp_path / "out"))
    many = spark.range(100).select(F.col("id").cast("int"), F.struct(F.lit(True).alias("ok")).alias("nested")).coalesce(2)
    tables.write_results_json(back.unionByName(many), str(tmp_path / "out"))
    assert tables.read_results_json(spark, str(tmp_path / "out"), back.schema).count() == 102


def test_stats_keep_the_latest_recording(spark, tmp_path):
    path = str(tmp_path / "stats")
    for n in (1, 2):
        tables.record_stats(spark.createDataFrame([(n, "x")], "rows int, name string"), path, "load")
    tables.record_stats(spark.createDataFrame([(9,)], "rows int"), path, "other")
    latest = tables.latest_stats(spark.read.parquet(path)).select("step", "metric", "value").collect()
    assert sorted(map(tuple, latest)) == [("load", "name", "x"), ("load", "rows", "2"), ("other", "rows", "9")]


def test_taxonomy_round_trip(spark, tmp_path):
    path = str(tmp_path / "taxonomy.yaml")
    intents = [taxonomy.Intent("a", "first", True, (("1", "é text"),)), taxonomy.Intent("b", "second")]
    taxonomy.write_taxonomy(spark, intents, path, version="1.0")
    assert taxonomy.read_taxonomy(spark, path) == intents
    table = taxonomy.load_taxonomy(spark, path)
    again = str(tmp_path / "again.yaml")
    taxonomy.save_taxonomy(table, again)
    assert taxonomy.read_taxonomy(spark, again) == intents
    assert len(taxonomy.default_taxonomy()) == 8


def test_resume_scores_each_row_once(spark, tmp_path):
    path, seen, schema = str(tmp_path / "scores"), spark.sparkContext.accumulator(0), "id bigint, label string"

    def scorer(frame):
        seen.add(len(frame))
        return frame[["id"]].assign(label="x")

    run = lambda rows: score.score_incremental(rows, path, "id", lambda d: score.score_batches(d, scorer, schema, 7), schema)
    assert run(spark.range(30)).count() == 30
    assert run(spark.range(50)).count() == 50
    assert run(spark.range(50)).count() == 50
    assert seen.value == 50


def test_batches_have_the_asked_size(spark):
    sizes = lambda frame: frame.head(1).assign(n=len(frame))[["n"]]
    got = [r["n"] for r in score.score_batches(spark.range(25).coalesce(1), sizes, "n bigint", 10).collect()]
    assert sorted(got) == [5, 10, 10]


def test_small_side_is_checked(spark):
    def plan(limit):
        table = session.small_side(spark.range(20).toDF("id"), "lookup", limit)
        return spark.range(100).hint("merge").join(table, "id")._jdf.queryExecution().analyzed().toString()

    assert "broadcast" in plan(20 * 16).lower() and "broadcast" not in plan(20 * 16 - 1).lower()


def test_wide_rows_count_by_their_bytes(spark):
    rows = [(1, "x" * 1000, [1.0] * 100, [("a", "b" * 50)])] * 10
    wide = spark.createDataFrame(rows, "id int, t string, v array<double>, s array<struct<a:string,b:string>>")
    joined = lambda limit: spark.range(3).hint("merge").join(session.small_side(wide, "wide", limit), "id")
    plan = lambda limit: joined(limit)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in plan(15_000) and "broadcast" in plan(40_000)


def test_own_stages_are_deleted(spark):
    with session.own_stages(spark):
        _, seen = session.write_stage(spark.range(3), "short-lived")
        path = session.stage_path(spark, "kept").rsplit("/", 1)[0].removeprefix("file:")
        assert any(p.name.startswith("short-lived") for p in pathlib.Path(path).iterdir())
    assert not any(p.name.startswith("short-lived") for p in pathlib.Path(path).iterdir())


def test_stage_counts_rows_and_lives_in_the_shared_folder(spark):
    table, seen = session.write_stage(spark.range(7), "numbers", even=F.count_if(F.col("id") % 2 == 0))
    assert seen == {"rows": 7, "even": 4} and table.count() == 7
    assert session.stage_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    empty, seen = session.write_stage(spark.range(7).where("id > 9"), "nothing")
    assert seen["rows"] == 0 and empty.count() == 0


def test_ties_round_to_the_even_digit(spark):
    values = spark.createDataFrame([(5 / 32, 1 / 32, 3.125)], "a double, b double, c double")
    row = values.select(half_even("a", 4), half_even("b", 4), half_even("c", 2)).first()
    assert tuple(row) == (0.1562, 0.0312, 3.12)
