"""The two task-side passes against brute force, for any cut into pieces."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest

from tripline.operators import clusters
from tripline.operators.runs import _Smoother

H = 3_600_000_000

RUN_SCHEMA = pa.schema(
    [("track", pa.int64()), ("run_key", pa.string()), ("first_us", pa.int64()),
     ("first_id", pa.string()), ("first_date", pa.int64()), ("last_us", pa.int64()),
     ("last_id", pa.string()), ("last_date", pa.int64()), ("sum_lat", pa.float64()),
     ("sum_lng", pa.float64()), ("n", pa.int64()), ("first_url", pa.string()),
     ("_min_us", pa.int64()), ("_open", pa.bool_())]
)


def batches(rows, schema, size):
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema
        )


def rows_of(result):
    return [tuple(r.values()) for b in result for r in b.to_pylist()]


def cut(rows, pieces, rng):
    at = sorted(rng.randrange(len(rows) + 1) for _ in range(pieces - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


def restart_from_left(runs, min_us):
    """Runs as [key, first, last, n]; absorb the leftmost, start over, to the fixed point."""
    runs = [list(r) for r in runs]
    while True:
        for i in range(1, len(runs) - 1):
            a, m, b = runs[i - 1 : i + 2]
            if m[2] - m[1] < min_us and a[0] == b[0]:
                runs[i - 1 : i + 2] = [[a[0], a[1], b[2], a[3] + m[3] + b[3]]]
                break
        else:
            return runs


def random_runs(rng, count, keys, longest):
    runs, t, last = [], 0, None
    for _ in range(count):
        key = rng.choice([k for k in keys if k != last])
        span = rng.choice([0, rng.randrange(longest), rng.randrange(longest // 4)])
        t += rng.randrange(1, 8) * H
        runs.append((key, t, t + span * H, rng.randrange(1, 4)))
        t, last = t + span * H, key
    return runs


@pytest.mark.parametrize("seed", range(6))
def test_smoother_equals_restart_from_left(seed):
    rng = random.Random(seed)
    for _ in range(400):
        min_us = rng.choice([0, 6, 24, 24, 48]) * H
        tracks = {
            t: random_runs(rng, rng.randrange(1, 40), "ABC"[: rng.choice([2, 3])],
                           rng.choice([8, 30, 60]))
            for t in range(rng.randrange(1, 4))
        }
        rows = [
            (t, k, a, f"{a}", a, b, f"{b}", b, float(n), 2.0 * n, n, None, min_us, True)
            for t, runs in tracks.items()
            for k, a, b, n in runs
        ]
        first = []
        for piece in cut(rows, rng.randrange(1, 6), rng):
            size = rng.choice([1, 3, 100])
            first += rows_of(_Smoother(1, whole=False)(batches(piece, RUN_SCHEMA, size)))
        first.sort(key=lambda r: (r[0], not r[-1], r[2]))
        second = rows_of(_Smoother(1, whole=True)(batches(first, RUN_SCHEMA, 7)))
        got = sorted((r[0], r[2], r[1], r[5], r[10], r[8]) for r in second)
        want = sorted(
            (t, a, k, b, n, float(n))
            for t, runs in tracks.items()
            for k, a, b, n in restart_from_left(runs, min_us)
        )
        assert got == want


def test_smoother_holds_few_rows():
    """State stays small even where no run is ever long."""
    smoother = _Smoother(1, whole=True)
    rows = [
        (0, "AB"[i % 2] if i % 7 else "C", i * H, f"{i}", i, i * H, f"{i}", i, 0.0, 0.0, 1, None,
         24 * H, True)
        for i in range(5000)
    ]
    deepest = 0
    for _ in smoother(batches(rows, RUN_SCHEMA, 50)):
        deepest = max(deepest, len(smoother._stack))
    assert deepest < 60


LEADER_SCHEMA = pa.schema(
    [("track", pa.int64()), ("_us", pa.int64()), ("_id", pa.string()), ("_lat", pa.float64()),
     ("_lng", pa.float64()), ("_km", pa.float64()), ("cluster_id", pa.string()),
     ("_clat", pa.float64()), ("_clng", pa.float64()), ("_cn", pa.int64()), ("_open", pa.bool_())]
)


def naive_leaders(points, km):
    out, state = [], None
    for ident, lat, lng in points:
        if state is not None and clusters._km(state[1], state[2], lat, lng) <= km:
            state[3] += 1
            state[1] += (lat - state[1]) / state[3]
            state[2] += (lng - state[2]) / state[3]
        else:
            state = [ident, lat, lng, 1]
        out.append(state[0])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_leader_equals_sequential(seed):
    rng = random.Random(100 + seed)
    for _ in range(120):
        km = rng.choice([0.0, 5.0, 50.0, 200.0, 900.0])
        lat, lng = rng.choice([(1.3, 103.8), (79.0, 10.0), (10.0, 179.5), (88.0, -150.0)])
        points = []
        for i in range(rng.randrange(1, 120)):
            step = rng.choice([0.01, 0.2, 0.5, 3.0])
            lat = max(-90.0, min(90.0, lat + rng.uniform(-step, step)))
            lng = (lng + rng.uniform(-step, step) + 180) % 360 - 180
            points.append((f"p{i:04d}", lat, lng))
        rows = [
            (0, i, ident, a, o, km, None, None, None, None, True)
            for i, (ident, a, o) in enumerate(points)
        ]
        first = []
        for piece in cut(rows, rng.randrange(1, 6), rng):
            size = rng.choice([1, 4, 100])
            first += rows_of(
                clusters._Leader(1, whole=False)(batches(piece, LEADER_SCHEMA, size))
            )
        opened = [r for r in first if r[-1]]
        closed = [r for r in first if not r[-1]]
        second = rows_of(
            clusters._Leader(1, whole=True)(batches(opened + closed, LEADER_SCHEMA, 9))
        )
        got = [r[6] for r in sorted(second, key=lambda r: r[1])]
        assert got == naive_leaders(points, km)


def test_certain_break_is_certain():
    """Whatever the centroid was before, the next item is out of its reach."""
    rng = random.Random(7)
    for _ in range(20000):
        km = rng.uniform(0.1, 200.0)
        lat, lng = rng.uniform(-85, 85), rng.uniform(-180, 180)
        to = (lat + rng.uniform(-8, 8), lng + rng.uniform(-30, 30))
        if not clusters._certain_break(lat, lng, *to, km):
            continue
        reach = math.degrees(km / 6371.0)
        old = (lat + rng.uniform(-reach, reach), lng + rng.uniform(-9, 9) * reach)
        if clusters._km(*old, lat, lng) > km:
            continue
        n = rng.randrange(2, 50)
        now = (old[0] + (lat - old[0]) / n, old[1] + (lng - old[1]) / n)
        assert clusters._km(*now, *to) > km
