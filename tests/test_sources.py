import json

import pytest

from replyforest.functions import expressions as x
from replyforest.schemas import COMMENT_FIELDS
from replyforest.sources import jsonl, stats_store, tables
from replyforest.streaming.ingest import ingest_resumable
from pyspark.sql import functions as F

FIELDS = ["id", "score", "author", "media"]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def lines(*records):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)


GOOD = {"id": "a", "score": 3, "author": "x", "media": {"type": "video", "size": [1, 2]}, "extra": 1}
SHORT = {"id": "b"}


def test_head_keeps_order_and_fills_missing_fields(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", lines(GOOD, SHORT, {"id": "c", "archived": True}))
    rows = jsonl.jsonl_head(spark, path, FIELDS, 2).collect()
    assert [r.id for r in rows] == ["a", "b"]
    assert json.loads(rows[0].media) == GOOD["media"] and rows[0].score == "3"
    assert rows[1].score is None and rows[1].media is None


TWO, TRAILING, QUOTED = '{"id":"two"}{"id":"three"}', '{"id":"t"} xyz', "{'id':'s'}"


@pytest.mark.parametrize("bad", ['{"id": "x", ', "", TWO, TRAILING, QUOTED, '{"id":"a"},{"id":"b"}', "[1]", '["id"]', "null", "7"])
def test_head_raises_on_a_malformed_line(spark, tmp_path, bad):
    path = write(tmp_path / "d.jsonl", lines(GOOD, bad, SHORT))
    with pytest.raises(Exception):
        jsonl.jsonl_head(spark, path, FIELDS, 3).collect()
    assert jsonl.jsonl_head(spark, path, FIELDS, 1).count() == 1


def test_columns_skip_malformed_lines(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", lines(GOOD, '{"id": "x", ', "", TWO, TRAILING, QUOTED, SHORT, "nonsense", "[]", "null"))
    assert sorted(r.id for r in jsonl.jsonl_columns(spark, path, FIELDS).collect()) == ["a", "b"]


def test_all_fields_without_a_choice(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", lines(GOOD, SHORT, {"id": "c", "archived": True}, "broken"))
    assert jsonl.jsonl_columns(spark, path).columns == ["id", "archived", "score", "author", "media", "extra"]
    assert jsonl.jsonl_head(spark, path, n=2).columns == ["id", "score", "author", "media", "extra"]


@pytest.fixture
def many_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_resume_after_id_over_many_splits(spark, tmp_path, many_splits):
    records = [{"id": f"r{i:03}", "score": i} for i in range(100)]
    records[70] = {"id": "r040", "score": 70}
    text = lines(*records[:50], '{"id": "r0', *records[50:])
    path = write(tmp_path / "d.jsonl", text)
    frame = jsonl.ingest_after_id(spark, path, ["score"], "r040")
    assert frame.rdd.getNumPartitions() > 4
    expected = [i for i in range(41, 100) if i != 70]
    assert sorted(int(r.score) for r in frame.collect()) == expected
    assert jsonl.ingest_after_id(spark, path, ["score"], "never").count() == 0
    assert jsonl.ingest_after_id(spark, path, ["score"]).count() == 100
    out = str(tmp_path / "out")
    assert tables.append_csv(frame, out) == 58 and tables.append_csv(frame, out) == 58
    assert tables.csv_text(spark, out, ["score"]).count() == 116


def test_stream_reads_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for number in (1, 2):
        write(tmp_path / "in" / f"{number}.jsonl", lines({"id": str(number)}, "broken"))
        ingest_resumable(spark, source, target, checkpoint, ["id"], files_per_batch=1).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(target).collect()) == [str(i + 1) for i in range(number)]


CSV = '''id,body,score,author,parent_id
a,"two
lines, and ""quotes""",1,NA,t3_p
b,short
c,x,2,me,t3_p,too,long
d,x,many,me,t3_p
g,"x, ""y"", z",2,me,,long with an empty last column
h,"short, but, with, many, commas ""in"" quotes",3
e,,,,
f,null,-5,None,t1_a
'''


def test_tolerant_csv(spark, tmp_path):
    path = write(tmp_path / "c.csv", CSV)
    rows = {r.id: r for r in tables.csv_tolerant_scan(spark, path, COMMENT_FIELDS).collect()}
    assert sorted(rows) == ["a", "b", "e", "f", "h"]
    assert rows["a"].body == 'two\nlines, and "quotes"' and rows["a"].author == "NA"
    assert rows["b"].score is None and rows["b"].parent_id is None and rows["e"].body is None
    assert rows["f"].score == -5 and rows["f"].body == "null" and rows["f"].author == "None"
    # Fewer columns must not change which rows are kept.
    assert sorted(r.id for r in tables.csv_tolerant_scan(spark, path, COMMENT_FIELDS).select("id").collect()) == ["a", "b", "e", "f", "h"]


def test_texts_come_back_as_they_were(spark, tmp_path):
    texts = [" blanks ", "tab\t", "a\nb", "a\r\nb", "a\rb", 'q"', '"', '""', "back\\slash", 'back\\"', "comma, here", "é☃🙂", "#hash", "'single'", "NaN", "null", "\n", "x\n"]
    rows = spark.createDataFrame([(f"i{n:02}", text, "end") for n, text in enumerate(texts)], "id string, body string, author string")
    path = str(tmp_path / "c")
    tables.write_csv(rows.coalesce(1), path)
    found = {r.id: r.body for r in tables.csv_text(spark, path, ["id", "body", "author"]).collect()}
    assert found == {f"i{n:02}": text for n, text in enumerate(texts)}


def test_stray_quotes_and_line_ends(spark, tmp_path):
    """A quote inside an unquoted field eats no rows, whatever the line ends are and however the file is read."""
    for number, end in enumerate(("\n", "\r\n")):
        path = tmp_path / f"{number}.csv"
        path.write_bytes(end.join(["id,body,author", '1,he said 5" tall,u', "2,x,u", '3,"a ""q""",u', "4,,u", ""]).encode())
        for multi_line in (True, False):
            rows = {r.id: r.body for r in tables.csv_text(spark, str(path), ["id", "body", "author"], multi_line).collect()}
            assert rows == {"1": 'he said 5" tall', "2": "x", "3": 'a "q"', "4": None}, (number, multi_line)
    kept = tmp_path / "kept.csv"
    kept.write_bytes(b'id,body\r\n1,"a\r\nb"\r\n2,c\r\n')
    assert {r.id for r in tables.csv_text(spark, str(kept), ["id", "body"]).collect()} == {"1", "2"}
    old = tmp_path / "old.csv"
    old.write_bytes(b"id,body\r1,x\r2,y\r")
    assert {r.id: r.body for r in tables.csv_text(spark, str(old), ["id", "body"]).collect()} == {"1": "x", "2": "y"}


def test_written_csv_is_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 100)
    path = str(tmp_path / "c")
    tables.write_csv(spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("id")), path)
    rows = tables.csv_text(spark, path, ["id"])
    assert len(rows.inputFiles()) == 10 and rows.count() == 1000


def test_strict_csv_fails_on_a_bad_score(spark, tmp_path):
    good = write(tmp_path / "good.csv", "id,body,score,author,parent_id\na,x,7,me,t3_p\n")
    assert tables.load_comments(spark, good, COMMENT_FIELDS).first().score == 7
    bad = write(tmp_path / "bad.csv", CSV)
    with pytest.raises(Exception):
        tables.load_comments(spark, bad, COMMENT_FIELDS).collect()


def test_csv_head_over_files(spark, tmp_path):
    for number in (1, 2):
        write(tmp_path / "a folder" / f"part {number}%.csv", "id,body\n" + "".join(f"{number}{i},x\n" for i in range(3)))
    rows = tables.csv_head(spark, str(tmp_path / "a folder"), ["id", "body"], 4).collect()
    assert [r.id for r in rows] == ["10", "11", "12", "20"]


def test_head_of_any_size(spark, tmp_path, many_splits):
    path = write(tmp_path / "d.jsonl", lines(*[{"id": f"{i:04}"} for i in range(500)]))
    for n in (0, 1, 7, 499, 500, 1000):
        assert sorted(r.id for r in jsonl.jsonl_head(spark, path, ["id"], n).collect()) == [f"{i:04}" for i in range(min(n, 500))]


def test_store_replaces_only_what_is_saved(spark, tmp_path):
    path = str(tmp_path / "stats")
    assert stats_store.load(spark, path).count() == 0
    schema = "stat string, segment string, ord bigint, key string, value bigint"

    def frame(rows):
        return spark.createDataFrame(rows, schema)

    stats_store.save(frame([("s", "a", 0, "x", 1), ("s", "a", 1, "y", 2), ("s", "b", 0, "x", 3)]), path)
    stats_store.save(frame([("s", "a", 0, "z", 9)]), path)
    rows = sorted((r.segment, r.key, r.value) for r in stats_store.load(spark, path).collect())
    assert rows == [("a", "z", 9), ("b", "x", 3)]


def test_json_of_the_store_names_every_entry(spark):
    """Negative keys and long histograms too: an entry is a line, and no two lines are the same entry."""
    rows = spark.range(-5000, 5000).select(F.lit("s").alias("stat"), F.lit("a").alias("segment"), F.col("id").alias("ord"), F.col("id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("value"))
    entries = [json.loads(r.value) for r in stats_store.as_json(rows).collect()]
    assert {e["name"] for e in entries} == {"s_a"} and len({e["key"] for e in entries}) == len(entries) == 10_000
    assert sorted(entries, key=lambda e: e["ord"])[0] == {"name": "s_a", "ord": -5000, "key": "-5000", "value": 1}


def test_measures_are_replaced_by_segment(spark, tmp_path):
    path = str(tmp_path / "averages")
    frame = lambda rows: spark.createDataFrame(rows, "stat string, segment string, average double")
    stats_store.save_rows(frame([("s", "a", 1.0), ("s", "b", 2.0)]), path)
    stats_store.save_rows(frame([("s", "a", 3.0)]), path)
    assert sorted((r.segment, r.average) for r in spark.read.parquet(path).collect()) == [("a", 3.0), ("b", 2.0)]


def test_delete_keeps_null_keys(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    assert {r.k for r in tables.delete_matching(rows, keys, ["k"]).collect()} == {None, "b"}


def test_expressions(spark):
    row = spark.sql("SELECT 't3_abc' AS p, '[deleted]' AS a, CAST(NULL AS STRING) AS n, 'comments_to_comments_12' AS t, \"['x', 'y']\" AS l").select(
        x.strip_prefix(F.col("p")).alias("id"),
        x.type_prefix(F.col("p")).alias("kind"),
        x.is_withdrawn(F.col("a"), F.col("n")).alias("gone"),
        x.is_withdrawn(F.col("n")).alias("not_gone"),
        x.level_of_name(F.col("t")).alias("lvl"),
        x.level_of_name(F.lit("comments_to_posts")).alias("top"),
        x.level_of_name(F.lit("posts")).alias("none"),
        x.parse_text_list(F.col("l")).alias("items"),
        x.is_integer_text(F.lit("-12")).alias("whole"),
        x.is_integer_text(F.lit("1.5")).alias("broken"),
    ).first()
    assert row.asDict() == {
        "id": "abc", "kind": "t3_", "gone": True, "not_gone": False, "lvl": 12, "top": 0, "none": None,
        "items": ["x", "y"], "whole": True, "broken": False,
    }


def test_a_line_is_read_once(spark, tmp_path):
    """Not once for the filter and once for each field."""
    path = write(tmp_path / "d.jsonl", lines(GOOD, SHORT))
    plan = jsonl.jsonl_columns(spark, path, FIELDS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_lines_that_only_look_whole(spark, tmp_path):
    """Blanks around an object do no harm, and what is more or less than one object is skipped."""
    whole = ['  {"id": "a"}', '{ "id": "b"}\t ', '{\t"id": "c", "score": {"x": "}"}}']
    broken = ['{"id": "d"}, ', '{"id": "e"}{"id": "f"}', '{"id": "g"}, {"id": "h"}', '{"id": "i"} x}', "{'id': 'j'}", '{id: "k"}', '{"id": "l}', "{", "}", ""]
    path = write(tmp_path / "d.jsonl", lines(*whole, *broken, "{}"))
    assert [r.id for r in jsonl.jsonl_columns(spark, path, ["id"]).collect()] == ["a", "b", "c", None]


@pytest.mark.parametrize("written", ["r040", "r\\u003040", "\\u0072040"])
def test_resume_after_an_id_however_it_is_written(spark, tmp_path, written):
    path = write(tmp_path / "d.jsonl", lines({"id": "r04", "body": "r040"}, '{"id": "%s"}' % written, {"id": "a"}, {"id": "r0401"}))
    assert [r.id for r in jsonl.ingest_after_id(spark, path, ["id"], "r040").collect()] == ["a", "r0401"]


def test_lines_without_the_id_are_not_read_for_it(spark):
    found = [(text, spark.sql("SELECT '{\"id\": \"r041\", \"body\": \"{\\\\\\\\\"k\\\\\\\\\": 7}\"}' AS value").select(jsonl._may_hold(F.col("value"), text)).first()[0]) for text in ("r040", "r041", "1041", "x y")]
    assert found == [("r040", False), ("r041", True), ("1041", True), ("x y", True)]
