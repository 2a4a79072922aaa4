"""Accepted transitions by composed state maps."""

import random

import pytest

from ioclens.constants import LIFECYCLE_STATES, TRANSITIONS
from ioclens.operators import lifecycle as L
from ioclens.operators import statemaps as M

LOG = "id long, threat_input_id long, ioc_id long, state string, ts timestamp_ntz"


def brute(rows):
    out, last = [], {}
    for i, t, c, state, ts in sorted(rows, key=lambda r: (r[4], r[0])):
        prev = last.get((t, c))
        if prev == state:
            verdict = "noop"
        elif state in (["new"] if prev is None else TRANSITIONS[prev]):
            verdict = "valid"
            last[t, c] = state
        else:
            verdict = "invalid"
        out.append((i, prev, verdict))
    return sorted(out), last


def log(rng, n, threats):
    """A third of all rows belong to one threat and many share one instant."""
    import datetime as dt
    day = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        t = 0 if rng.random() < 1 / 3 else rng.choice([None, *range(1, threats)])
        c = rng.choice([None, 1, 2]) if t else 7
        ts = day if rng.random() < 0.2 else day + dt.timedelta(seconds=rng.randrange(10**6))
        rows.append((i, t, c, rng.choice([*LIFECYCLE_STATES, "new", "odd"]), ts))
    return rows


@pytest.mark.parametrize("size", [1 << 18, 40])
def test_verdicts_follow_the_last_accepted_state(spark, size):
    rows = log(random.Random(size), 1500, 20)
    df = spark.createDataFrame(rows, LOG).repartition(3)
    got = sorted((r.id, r.prev_state, r.verdict) for r in M.judged(df, L.KEYS, "ts", "id", "state", rows=size).collect())
    assert got == brute(rows)[0]


def test_maps_compose():
    rng = random.Random(3)
    assert M.MAPS[0] == tuple(range(6)) and len(M.MAPS) == len(M.THEN) < 200
    for _ in range(200):
        xs = [rng.randrange(6) for _ in range(rng.randrange(12))]
        m = 0
        for x in xs:
            m = M.THEN[m][x]
        for s in range(6):
            end = s
            for x in xs:
                end = M.STEP[end][x]
            assert M.MAPS[m][s] == end


def test_batch_of_requests(spark):
    rows = log(random.Random(5), 400, 8)
    rows.sort(key=lambda r: (r[4], r[0]))
    df = spark.createDataFrame(rows, LOG)
    old, new = spark.createDataFrame(rows[:300], LOG), spark.createDataFrame(rows[300:], LOG)
    verdicts, last = brute(rows)
    ids = {r[0] for r in rows[300:]}
    accepted, rejects, state = L.apply_requests(old, new)
    assert sorted(r.id for r in accepted.collect()) == [i for i, _, v in verdicts if v == "valid" and i in ids]
    assert sorted((r.id, r.prev_state) for r in rejects.collect()) == [(i, p) for i, p, v in verdicts if v == "invalid" and i in ids]
    assert {(r.threat_input_id, r.ioc_id): r.state for r in state.collect()} == {(r[1], r[2]): last.get((r[1], r[2])) for r in rows[300:]}
    assert accepted.columns == df.columns


def test_empty_log(spark):
    assert L.transitions(spark.createDataFrame([], LOG)).count() == 0
