"""Islands over ranges of the time line against one sweep."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from unitgraph.operators import service as S


def swept(rows, gap):
    found, at = [], {}
    for key, start, end, tag in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])):
        furthest, island = at.get(key, (None, 0))
        if furthest is not None and start - furthest > gap:
            island += 1
        at[key] = (end if furthest is None else max(furthest, end), island)
        found.append((key, start, end, island))
    return sorted(found, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 16])
@pytest.mark.parametrize("keys", [1, 4])
def test_islands(spark, ranges, keys):
    rng = random.Random(ranges + keys)
    rows = []
    for k in range(300):
        start = rng.randrange(400)
        # some ranges reach far over their neighbours', and most rows have one key
        rows.append((rng.choice([None, 1, 1, 1, 1, 1, 2]) if keys > 1 else 1, start, start + rng.choice([0, 1, 2, 3, 60 if k % 40 == 0 else 1]), k))
    df = spark.createDataFrame(rows, "k int, s int, e int, tag int")
    got = [(r.k, r.s, r.e, r.island) for r in S.numbered_islands(df, ["k"], "s", "e", 3, ranges).collect()]
    assert sorted(got, key=repr) == swept(rows, 3) and len({r[3] for r in got}) > 3


def test_bursts_of_a_table(spark):
    rng = random.Random(5)
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = [base + timedelta(milliseconds=rng.randrange(400_000)) for _ in range(300)] + [base + timedelta(seconds=900), base + timedelta(seconds=901.5), base + timedelta(seconds=903.001)]
    df = spark.createDataFrame([(t, f"p{k % 5}", k % 2) for k, t in enumerate(at)] + [(None, "p", 0)], "ts timestamp, path string, repo int")
    want, before = [], None
    for t in sorted(at):
        if before is None or t - before > timedelta(milliseconds=1500):
            want.append([t, t, 0])
        want[-1][1:] = [t, want[-1][2] + 1]
        before = t
    got = sorted((r.first_ts.astimezone(timezone.utc), r.last_ts.astimezone(timezone.utc), r.events) for r in S.debounced(df).collect())
    assert got == [tuple(w) for w in want]
    keyed = S.debounced(df, key="repo")
    assert keyed.columns == ["repo", "first_ts", "last_ts", "events", "paths"] and keyed.count() > len(got) and sum(r.events for r in keyed.collect()) == len(at)
    assert S.debounced(df.limit(0)).count() == 0
