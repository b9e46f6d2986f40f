import json
import os
import random

import pytest
from pyspark.sql import functions as F

from replyforest.sources import growing
from replyforest.streaming.counts import counted, ingest_and_count
from replyforest.streaming.ingest import ingest_growing


def lines_of(frame):
    return sorted((os.path.basename(r.file), r.start, r.value) for r in frame.collect())


def expected(folder):
    found = []
    for name in sorted(os.listdir(folder)):
        data, start = (folder / name).read_bytes(), 0
        for line in data.split(b"\n")[:-1]:
            found.append((name, start, line.decode()))
            start += len(line) + 1
    return sorted(found)


def append(path, data):
    with open(path, "ab") as out:
        out.write(data)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_blocks_yield_every_line_once(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(growing, "CHUNK", 16)
    rng = random.Random(block)
    for name in "ab":
        text = "\n".join("é" * rng.randint(0, 9) + "x" * rng.choice([0, 1, 40]) for _ in range(30 if block == 1 else 200))
        append(tmp_path / name, text.encode())
    (tmp_path / "_hidden").write_text("no\n")
    if block == 1:
        parts = growing.blocks({}, growing.grown(str(tmp_path), {}), 1)
        rows = [row for p in parts for b in growing._read(str(tmp_path), p) for row in b.to_pylist()]
        found = sorted((os.path.basename(r["file"]), r["start"], r["value"]) for r in rows)
    else:
        found = lines_of(growing.lines_between(spark, str(tmp_path), block=block)[0])
    os.remove(tmp_path / "_hidden")
    assert found == expected(tmp_path)


def test_a_growing_file_yields_each_complete_line_once(spark, tmp_path):
    path, seen, offset = tmp_path / "dump", [], {}
    for data in (b"one\ntwo\nthr", b"ee\n", b"", b"four", b" and more", b"\r\nfive\n\nsix\n", b"half"):
        append(path, data)
        frame, offset = growing.lines_between(spark, str(path), offset)
        seen += [r.value for r in frame.orderBy("start").collect()]
    assert seen == ["one", "two", "three", "four and more", "five", "", "six"]
    assert list(offset.values()) == [path.stat().st_size - 4]


def test_nothing_there(spark, tmp_path):
    frame, offset = growing.lines_between(spark, str(tmp_path))
    assert frame.count() == 0 and offset == {}
    assert growing.lines_between(spark, str(tmp_path / "missing"))[0].count() == 0


def test_a_file_that_shrank_is_an_error(tmp_path):
    append(tmp_path / "a", b"one\ntwo\n")
    done = growing.grown(str(tmp_path), {})
    (tmp_path / "a").write_bytes(b"one\n")
    with pytest.raises(ValueError, match="shrunk"):
        growing.grown(str(tmp_path), done)


def record(i, sub="r"):
    return json.dumps({"id": f"i{i}", "subreddit": sub, "score": i % 3}).encode() + b"\n"


def test_the_stream_goes_on_inside_files(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def run():
        ingest_growing(spark, str(source), target, checkpoint, ["id", "subreddit"]).awaitTermination()
        return sorted(r.id for r in spark.read.schema("id string, subreddit string").parquet(target).collect())

    append(source / "a", record(1) + b"no json\n" + record(2) + record(3)[:9])
    assert run() == ["i1", "i2"]
    assert run() == ["i1", "i2"]
    append(source / "a", record(3)[9:] + record(4))
    append(source / "b", record(5) * 2)
    assert run() == ["i1", "i2", "i3", "i4", "i5", "i5"]


def stored(spark, store):
    return {(r.stat, r.key): r.value for r in counted(spark, store).collect()}


def test_counts_follow_the_ingest(spark, tmp_path):
    """After any number of restarts, and batches that are done again, the store equals one count over everything."""
    source, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    source.mkdir()
    keys = {"subreddits": F.col("subreddit"), "scores": F.col("score")}
    assert stored(spark, store) == {}
    total, rng = {}, random.Random(1)
    for turn in range(6):
        data = b""
        for i in range(rng.randint(0, 30)):
            sub = rng.choice("abc")
            data += record(i, sub)
            for key in (("subreddits", sub), ("scores", str(i % 3))):
                total[key] = total.get(key, 0) + 1
        append(source / rng.choice("xy"), data)

        def run():
            ingest_and_count(spark, str(source), store, checkpoint, ["subreddit", "score"], keys, compact_every=2).awaitTermination()

        run()
        assert stored(spark, store) == total
        if turn % 2:  # the last batch is lost from the log of commits, as after a crash, and done again
            commits = tmp_path / "cp" / "commits"
            last = max((int(n) for n in os.listdir(commits) if n.isdigit()))
            for name in (str(last), f".{last}.crc"):
                if (commits / name).exists():
                    os.remove(commits / name)
            run()
            assert stored(spark, store) == total
