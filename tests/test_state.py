"""Keyed state of changed names against the rule, across restarts, clears, late rows and quiet times."""

import json
import random

from pyspark.sql import functions as F

from unitgraph.streaming import state


def by_rule(rows):
    cleared, last = {}, {}
    for repo, op, seq, name, *_ in rows:
        if op == "clear":
            cleared[repo] = max(cleared.get(repo, -1), seq)
    for k, (repo, op, seq, name, file, short, change) in enumerate(rows):
        if op == "set" and name is not None and seq > cleared.get(repo, -1) and (seq, k) >= last.get((repo, name), ((-1, -1),))[0]:
            last[repo, name] = ((seq, k), file, change)
    return sorted((repo, name, v[1], v[2], v[0][0]) for (repo, name), v in last.items())


def operations(n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        repo = rng.choice([1, 1, 1, 2, 3])
        if rng.random() < 0.03:
            rows.append((repo, "clear", seq, None, None, None, None))
        else:
            name = f"n{rng.randrange(12)}"
            rows.append((repo, "set", seq, name, f"f{rng.randrange(3)}", name, f"c{seq}"))
    return rows


def write(folder, k, rows):
    names = ["repo_id", "op", "seq", "qualified_name", "file_path", "name", "change"]
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))


def run(spark, tmp_path, **options):
    got = []
    stream = spark.readStream.schema(state.OPERATIONS).json(str(tmp_path / "in"))
    out = state.accumulate(stream, slices=3, **options).writeStream.outputMode("update")
    out.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    return got


def stored(spark, tmp_path):
    return sorted(tuple(r[c] for c in ("repo_id", "qualified_name", "file_path", "change", "seq")) for r in state.accumulated(spark, str(tmp_path / "cp")).collect())


def test_state_across_restarts(spark, tmp_path):
    rows = operations(240, 4)
    late = [(1, "set", 3, "n1", "late", "n1", "late"), (2, "clear", 1, None, None, None, None), (None, "set", 5, "x", "", "", ""), (1, "set", 5, None, "", "", ""), (3, "set", 900, "né", None, None, None)]
    parts = [rows[:100], rows[100:180], late, rows[180:]]
    done = []
    for k, part in enumerate(parts):
        write(tmp_path / "in", k, part)
        done += part
        out = run(spark, tmp_path)
        assert stored(spark, tmp_path) == by_rule([r for r in done if r[0] is not None])
        # the output follows the rows of the batch: a name once, a clear once a slice
        assert len(out) <= len({(r[0], r[3]) for r in part if r[1] == "set"}) + 3 * sum(r[1] == "clear" for r in part)
    write(tmp_path / "in", 9, [(1, "touch", 5000, None, None, None, None)])
    touched = sorted((r[0], r[3], r[4], r[6], r[2]) for r in run(spark, tmp_path) if r[1] == "set")
    assert touched == [r for r in by_rule([r for r in done if r[0] is not None]) if r[0] == 1]


def test_names_come_again_when_it_is_quiet(spark, tmp_path):
    names = ["repo_id", "op", "seq", "qualified_name", "file_path", "name", "change", "ts"]
    folder = tmp_path / "in"
    folder.mkdir()

    def go(k, rows):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        stream = spark.readStream.schema(state.OPERATIONS + ", ts timestamp").json(str(folder)).withWatermark("ts", "0 seconds")
        got = []
        out = state.accumulate(stream, slices=1, quiet_ms=1500, event_time="ts").writeStream.outputMode("update")
        out.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
        return [(r[0], r[3]) for r in got if r[1] == "quiet"]

    at = lambda s: (1_700_000_000_000_000 + int(s * 1e6), f"2023-11-14T22:13:{20 + s:06.3f}Z")
    row = lambda repo, name, s: (repo, "set", at(s)[0], name, "f", name, "new", at(s)[1])
    assert go(0, [row(1, "a", 0), row(1, "b", 1)]) == []
    assert go(1, [row(2, "c", 2)]) == []
    assert sorted(go(2, [row(3, "d", 10)])) == [(1, "a"), (1, "b"), (2, "c")]


def test_provider_is_set(spark):
    spark.conf.unset(state._PROVIDER[0])
    assert state.accumulate(spark.readStream.format("rate").load().select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in state.OPERATIONS.split(", ")])).columns[0] == "repo_id"
    assert "RocksDB" in spark.conf.get(state._PROVIDER[0])
