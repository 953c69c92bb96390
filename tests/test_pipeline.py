"""The bounded pass: order, bounds, retries, and that nothing is written twice."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from unitgraph.plans import pipeline as P
from unitgraph.plans.embedding import HashingEmbedder


@pytest.mark.parametrize("ahead,workers", [(1, 1), (3, 2), (7, 3)])
def test_steps_are_in_order_and_bounded(ahead, workers):
    lock, taken, given, running, most = threading.Lock(), [0], [0], [0], [0, 0]

    def items():
        for k in range(60):
            with lock:
                taken[0] += 1
                most[0] = max(most[0], taken[0] - given[0])
            yield k

    def step(k):
        with lock:
            running[0] += 1
            most[1] = max(most[1], running[0])
        time.sleep(0.001 * (k % 5))
        with lock:
            running[0] -= 1
        return k * k

    out = []
    with ThreadPoolExecutor(workers) as pool:
        for x in P.in_order(items(), step, pool, ahead):
            out.append(x)
            with lock:
                given[0] += 1
    assert out == [k * k for k in range(60)] and most[0] <= ahead + 1 and most[1] <= workers


def test_an_error_of_the_reader_ends_it():
    def items():
        yield 1
        raise OSError("gone")

    with ThreadPoolExecutor(2) as pool, pytest.raises(OSError):
        list(P.in_order(items(), lambda x: x, pool, 3))


class Flaky(P.ParquetSink):
    """Writes each batch, and says that it didn't the first time."""

    def __init__(self, folder):
        super().__init__(folder)
        self.seen = set()

    def upsert(self, points):
        super().upsert(points)
        first = points.column("id")[0].as_py()
        if first not in self.seen:
            self.seen.add(first)
            raise TimeoutError("no answer")


def test_upserts(spark, tmp_path):
    folder = str(tmp_path / "points")
    rows = [(f"p{k}", f"text {k % 7}" if k % 9 else None, k) for k in range(700)]
    texts = spark.createDataFrame(rows, "id string, text string, label int").repartition(3)
    out = P.upsert_vectors(texts, HashingEmbedder(16), lambda: Flaky(folder), batch=50, pause=0.01).collect()
    assert len(out) == 700 and all(r.written and r.error is None for r in out) and {r.attempts for r in out} == {2}
    stored = spark.read.parquet(folder)
    assert stored.count() == 700 == stored.select("id").distinct().count() and set(stored.columns) == {"id", "label", "vector"}
    one = {r.id: r.vector for r in stored.collect()}
    assert np.allclose(one["p1"], HashingEmbedder(16).encode(["text 1"])[0]) and not any(one["p0"])


def test_failures_are_rows(spark, tmp_path):
    class Broken:
        def upsert(self, points):
            if "p1" in points.column("id").to_pylist():
                raise ValueError("bad point")

    texts = spark.createDataFrame([(f"p{k}", "t") for k in range(4)], "id string, text string").coalesce(1)
    got = {r.id: (r.written, r.attempts, r.error) for r in P.upsert_vectors(texts, HashingEmbedder(4), Broken, batch=1, attempts=2, pause=0).collect()}
    assert got["p1"] == (False, 2, "ValueError: bad point") and got["p2"] == (True, 1, None) and len(got) == 4
    assert P.upsert_vectors(texts.limit(0), HashingEmbedder(4), Broken).count() == 0


class Talker:
    def stream(self, prompt):
        for word in prompt.split():
            if word == "bad":
                raise RuntimeError("down")
            yield word

    def models(self):
        return ["b", "a"]


def test_streamed_answers(spark):
    prompts = spark.createDataFrame([(1, "x y z"), (2, None), (3, "bad"), (4, "one")], "id bigint, prompt string").repartition(2)
    got = {}
    for r in P.stream_answers(prompts, Talker).collect():
        got.setdefault(r.id, []).append((r.place, r.piece, r.last, r.error))
    assert got == {1: [(0, "x", False, None), (1, "y", False, None), (2, "z", True, None)], 2: [(0, "", True, None)], 3: [(0, "", True, "RuntimeError: down")], 4: [(0, "one", True, None)]}
    assert [r.model for r in P.model_list(spark, Talker).collect()] == ["a", "b"]
    assert P.model_list(spark, lambda: 1 / 0).count() == 0
