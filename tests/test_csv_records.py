import csv
import io
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from replyforest.schemas import text_schema
from replyforest.sources.csv_records import csv_records
from replyforest.sources.tables import BAD, CSV_OPTIONS, csv_head, csv_text, csv_tolerant_scan

FIELDS = ["id", "title", "score"]


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([FIELDS, *rows])
    return out.getvalue()


def one_task(spark, path, schema=None, **options):
    """The reader of whole files."""
    return spark.read.schema(schema or text_schema(FIELDS)).options(**CSV_OPTIONS, **options).option("multiLine", True).csv(path)


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture
def blocks(spark):
    """Sets the size of the blocks in which files are read."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {key: spark.conf.get(key, None) for key in keys}

    def set_size(size):
        for key, value in zip(keys, (size, "1", "1")):
            spark.conf.set(key, str(value))

    yield set_size
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def thread_rows(rng, rows):
    parts = ["plain", "with, comma", 'a "quoted" word', "two\nlines", "\n", '"', '""', ",", "\r\n", "é𝒳", " blank ", "#x", "\\", "x" * 150, ""]
    return [[f"i{i}", "".join(rng.choices(parts, k=rng.randint(0, 4))), str(rng.randint(-9, 99))] for i in range(rows)]


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_as_the_reader_of_whole_files(spark, blocks, tmp_path, size, end):
    rows = thread_rows(random.Random(size), 150)
    if end == "\r":
        rows = [[value.replace("\r\n", "") for value in row] for row in rows]
    path = str(tmp_path / "posts.csv")
    with open(path, "w", newline="") as out:
        out.write(written(rows, end))
    expected = sorted_rows(one_task(spark, path))
    assert len(expected) == 150
    blocks(size)
    assert sorted_rows(csv_text(spark, path, FIELDS, in_splits=True)) == expected
    head = csv_head(spark, path, FIELDS, 37, in_splits=True).collect()
    assert [r.id for r in head] == [f"i{i}" for i in range(37)]


def test_as_many_tasks_as_blocks(spark, blocks, tmp_path):
    path = str(tmp_path / "posts.csv")
    with open(path, "w", newline="") as out:
        out.write(written(thread_rows(random.Random(1), 3000)))
    blocks(8192)
    size = os.path.getsize(path)
    places = {r.split for r in csv_records(spark, path).select("split").distinct().collect()}
    assert len(places) == -(-size // 8192) > 10
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() == len(places)


def test_records_longer_than_blocks(spark, blocks, tmp_path):
    """Values across many blocks, blocks inside one value, and borders at every place of a quote."""
    for shift in (0, 1, 2, 5):
        rows = [["a" * shift, "line\n" * 60 + '"' * 7, "1"], ["b", '"\n"' * 50, "2"], ["c", "\n" * 200, "3"], ["d", "", "4"]]
        path = str(tmp_path / f"long{shift}.csv")
        with open(path, "w", newline="") as out:
            out.write(written(rows))
        expected = sorted_rows(one_task(spark, path))
        blocks(64)
        assert sorted_rows(csv_text(spark, path, FIELDS, in_splits=True)) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_any_written_rows(spark, blocks, tmp_path_factory, data):
    text = st.text(st.sampled_from('ab,"\n 1é'), max_size=12)
    rows = data.draw(st.lists(st.tuples(text.map(lambda t: "k" + t), text, text), max_size=12))
    path = str(tmp_path_factory.mktemp("csv") / "f.csv")
    with open(path, "w", newline="") as out:
        out.write(written(rows))
    blocks(data.draw(st.sampled_from([16, 33, 64])))
    expected = sorted([tuple(v or None for v in row) for row in rows], key=repr)
    assert sorted_rows(csv_text(spark, path, FIELDS, in_splits=True)) == expected


def test_several_files_keep_their_headers_and_order(spark, blocks, tmp_path):
    for name, start in (("b.csv", 100), ("a.csv", 0), ("c.csv", 200)):
        with open(tmp_path / name, "w", newline="") as out:
            out.write(written([[f"i{start + i:03}", "two\nlines " * (i % 5), i] for i in range(50)]))
    (tmp_path / "empty.csv").touch()
    blocks(128)
    assert [r.id for r in csv_head(spark, str(tmp_path), FIELDS, 130, in_splits=True).collect()] == [f"i{100 * (i // 50) + i % 50:03}" for i in range(130)]
    assert csv_text(spark, str(tmp_path), FIELDS, in_splits=True).count() == 150


def test_tolerant_scan_is_the_same(spark, blocks, tmp_path):
    """Short rows are padded, long ones and wrong types dropped, empty lines skipped, as the reader of whole files does."""
    path = str(tmp_path / "rough.csv")
    with open(path, "w", newline="") as out:
        out.write('id,title,score\na,x,1\nb\nc,y\n\nd,"two\nlines",2\ne,x,3,4\nf,"a,b\n",no\n"g","q""q",5\nh,,\n"","",""\n')
    schema = text_schema([*FIELDS, BAD])
    plain = one_task(spark, path, schema, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD).cache().collect()
    expected = set()
    for r in plain:
        too_long = r[BAD] is not None and next(csv.reader([r[BAD]]))[len(FIELDS) :]
        if not too_long and (r.score is None or r.score.isdigit()):
            expected.add((r.id, r.title, r.score and int(r.score)))
    assert len(plain) == 9 and len(expected) == 7
    for size in (64, 1 << 20):
        blocks(size)
        assert {tuple(r) for r in csv_tolerant_scan(spark, path, FIELDS, in_splits=True).collect()} == expected


def test_a_quote_that_never_closes(spark, blocks, tmp_path):
    path = str(tmp_path / "open.csv")
    with open(path, "w", newline="") as out:
        out.write('id,title,score\na,x,1\nb,"open' + "\nmore" * 100)
    blocks(64)
    rows = csv_text(spark, path, FIELDS, in_splits=True).collect()
    assert len(rows) == 2 and rows[0].id in "ab"


def test_no_rows(spark, tmp_path):
    path = tmp_path / "head.csv"
    path.write_text("id,title,score\n")
    assert csv_text(spark, str(path), FIELDS, in_splits=True).count() == 0
    path.write_text("")
    assert csv_text(spark, str(path), FIELDS, in_splits=True).count() == 0 and csv_head(spark, str(path), FIELDS, 5, in_splits=True).count() == 0
