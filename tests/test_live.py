"""The folder source and the event sink: restarts, repeats, aborts and late listeners."""

import json
import os

import pytest
from pyspark.sql import functions as F

from unitgraph.streaming import folder, frames


def watch(spark, tmp_path, got, **options):
    folder.register(spark)
    reader = spark.readStream.format("folder_events").option("path", str(tmp_path / "tree")).option("state", str(tmp_path / "state")).options(**options)
    query = reader.load().writeStream.foreachBatch(lambda df, _: got.extend((r.path, r.kind, r.seq) for r in df.collect()))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(r[:2] for r in got)


def test_folder_events(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "src/A.java").write_text("a")
    (tree / "gone.js").write_text("x")
    (tree / "node_modules").mkdir()
    assert watch(spark, tmp_path, []) == []  # what is there when the watch starts is no event
    (tree / "src/A.java").write_text("ab")
    (tree / "src/日 本.java").write_text("b")
    (tree / "node_modules/x.js").write_text("skipped")
    (tree / "gone.js").unlink()
    got = []
    assert watch(spark, tmp_path, got) == [("gone.js", "deleted"), ("src/A.java", "modified"), ("src/日 本.java", "created")]
    assert len({r[2] for r in got}) == 3
    assert watch(spark, tmp_path, []) == []  # a restart replays nothing
    assert len(os.listdir(tmp_path / "state")) <= 2
    (tree / "src/A.java").unlink()
    assert watch(spark, tmp_path, []) == [("src/A.java", "deleted")]


def test_existing_files_and_equal_slices(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    for k in range(20):
        (tmp_path / "tree" / f"f{k}.js").write_text("x")
    assert len(watch(spark, tmp_path, [], existing="true", slices="3")) == 20


def test_a_batch_that_runs_again_is_the_same(tmp_path):
    (tmp_path / "tree").mkdir()
    reader = folder.FolderReader({"path": str(tmp_path / "tree"), "state": str(tmp_path / "state")})
    start = reader.initialOffset()
    (tmp_path / "tree" / "a.js").write_text("1")
    end = reader.latestOffset()
    rows = lambda: sorted(r for p in reader.partitions(start, end) for r in reader.read(p))
    first = rows()
    (tmp_path / "tree" / "b.js").write_text("1")
    assert rows() == first and [r[2:] for r in first] == [("a.js", "created")]
    # a crash behind the look: the next look goes on from it
    assert reader.latestOffset() == {"version": 2} == folder.FolderReader({"path": str(tmp_path / "tree"), "state": str(tmp_path / "state")}).latestOffset()


def run_sink(spark, tmp_path, rows, column=None):
    frames.register(spark)
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{len(os.listdir(tmp_path / 'in'))}.txt").write_text("\n".join(rows))
    stream = spark.readStream.text(str(tmp_path / "in")).select((F.col("value") if column is None else column).alias("data"))
    stream.writeStream.format("event_frames").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)


def test_frames_once_each(spark, tmp_path):
    run_sink(spark, tmp_path, ["a", "b", "c"])
    run_sink(spark, tmp_path, ["d é"])
    got = sorted(map(tuple, frames.events(spark, str(tmp_path / "out")).collect()))
    assert [s for s, _ in got] == [1, 2, 3, 4] and {d for _, d in got} == {"a", "b", "c", "d é"}
    out = list(frames.replay(str(tmp_path / "out")))
    assert [s for s, _ in out] == [1, 2, 3, 4] and out[3][1] == "id: 4\ndata: d é\n\n"
    assert list(frames.replay(str(tmp_path / "out"), 3)) == out[3:] and list(frames.replay(str(tmp_path / "nowhere"))) == []
    heard = list(frames.follow(str(tmp_path / "out"), 2, heartbeat=0.2, poll=0.05, until=0.6))
    assert heard[:2] == [f for _, f in out[2:]] and heard[2:] and set(heard[2:]) == {": heartbeat\n\n"}


def test_an_aborted_batch_shows_nothing(spark, tmp_path):
    run_sink(spark, tmp_path, ["a"])
    boom = F.udf(lambda x: x if x != "bad" else 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        run_sink(spark, tmp_path, ["b", "bad"], boom(F.col("value")))
    assert [r.data for r in frames.events(spark, str(tmp_path / "out")).collect()] == ["a"]


def test_a_commit_that_is_repeated(tmp_path):
    writer = frames.FrameWriter({"path": str(tmp_path)})
    writer.commit([writer.write(iter([("x",), ("y\nz",)])), writer.write(iter([])), None], 0)
    writer.commit([writer.write(iter([("x",), ("y\nz",)]))], 0)
    writer.abort([writer.write(iter([("w",)])), None], 1)
    assert [f for _, f in frames.replay(str(tmp_path))] == ["id: 1\ndata: x\n\n", "id: 2\ndata: y\ndata: z\n\n"]
    assert len(os.listdir(tmp_path / "data")) == 1 and json.loads((tmp_path / "batches" / "000000000000.json").read_text())["next"] == 3
