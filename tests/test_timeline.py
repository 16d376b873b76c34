"""Stays on small hand-made trips."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tripline.operators.clusters import _km
from tripline.operators.documents import timeline_summary
from tripline.operators.ordered import number_rows
from tripline.operators.runs import segment_runs
from tripline.plans.timeline import build_stays, city_stays, country_stays

POINT_DDL = (
    "track_id long, media_id long, t timestamp, local_date date, lat double, lng double, "
    "cc string, city string, admin1 string, url string"
)


def points(spark, rows, track=1):
    """rows: (hours since 2019-06-01 12:00, lat, lng, cc, city[, admin1])."""
    start = dt.datetime(2019, 6, 1, 12)
    data = []
    for i, (hours, lat, lng, cc, city, *rest) in enumerate(rows):
        t = start + dt.timedelta(hours=hours)
        data.append((track, i, t, t.date(), lat, lng, cc, city, rest[0] if rest else None, None))
    return spark.createDataFrame(data, POINT_DDL)


SG, TH = (1.30, 103.80, "SG", "Singapore"), (13.75, 100.50, "TH", "Bangkok")
TRIP = [(0, *SG), (24, *SG), (48, *TH), (72, *TH), (96, *TH), (120, *SG)]


def spans(stays):
    rows = stays.orderBy("track_id", "first_us").collect()
    return [(r.label, str(r["from"])[5:], str(r.to)[5:], r.photo_count) for r in rows]


def test_trip_by_country_and_city(spark):
    p = points(spark, TRIP)
    want = [("06-01", "06-02", 2), ("06-03", "06-05", 3), ("06-06", "06-06", 1)]
    assert spans(country_stays(p)) == [(c, *w) for c, w in zip(("SG", "TH", "SG"), want)]
    names = ("Singapore", "Bangkok", "Singapore")
    assert spans(city_stays(p)) == [(c, *w) for c, w in zip(names, want)]


def test_region_and_level(spark):
    p = points(spark, TRIP)
    assert build_stays(points=p, level="city").count() == 3
    assert build_stays(points=p, level="anything").count() == 3


def test_blips(spark):
    short = [(0, *SG), (30, *SG), (31, *TH), (33, *TH), (34, *SG), (64, *SG)]
    assert spans(country_stays(points(spark, short))) == [("SG", "06-01", "06-04", 6)]
    exact = [(0, *SG), (30, *SG), (31, *TH), (55, *TH), (56, *SG), (90, *SG)]
    assert [s[0] for s in spans(country_stays(points(spark, exact)))] == ["SG", "TH", "SG"]
    edges = [(0, *TH), (1, *SG), (40, *SG), (41, *TH)]
    assert [s[0] for s in spans(country_stays(points(spark, edges)))] == ["TH", "SG", "TH"]
    assert [s[0] for s in spans(country_stays(points(spark, short), 0))] == ["SG", "TH", "SG"]


def test_metro_and_modal_tie(spark):
    tokyo = [(0, 35.69, 139.75, "JP", "Chiyoda", " Tokyo "), (1, 35.71, 139.80, "JP", "Taito", "Tokyo")]
    assert spans(city_stays(points(spark, tokyo))) == [("Tokyo", "06-01", "06-01", 2)]
    tie = [(0, 1.30, 103.80, "SG", "B"), (1, 1.31, 103.80, "SG", "A")]
    assert spans(city_stays(points(spark, tie)))[0][0] == "B"


def test_empty(spark):
    none = points(spark, [(0, 1.0, 1.0, None, None)])
    assert country_stays(none).count() == 0
    assert city_stays(none).count() == 0


@pytest.fixture
def many_pieces(spark):
    """Keep all range partitions, however small: every order is cut into 32 pieces."""
    keys = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def naive_runs(rows):
    """[label, first hour, last hour, count] of maximal runs."""
    runs = []
    for hours, label in rows:
        if runs and runs[-1][0] == label:
            runs[-1][2:] = [hours, runs[-1][3] + 1]
        else:
            runs.append([label, hours, hours, 1])
    return runs


def naive_smooth(runs, min_hours):
    while True:
        for i in range(1, len(runs) - 1):
            a, m, b = runs[i - 1 : i + 2]
            if m[2] - m[1] < min_hours and a[0] == b[0]:
                runs[i - 1 : i + 2] = [[a[0], a[1], b[2], a[3] + m[3] + b[3]]]
                break
        else:
            return runs


def test_one_hot_track_over_many_pieces(spark, many_pieces):
    """A single track, cut into range partitions within runs, blips and clusters."""
    rng = random.Random(5)
    rows, cc = [], "A"
    for i in range(2000):
        cc = rng.choice("ABC") if rng.random() < 0.3 else cc
        lat = {"A": 1.0, "B": 1.8, "C": 20.0}[cc]
        rows.append((i * 2, lat + rng.random() / 5, 100 + rng.random() / 5, cc, cc.lower()))
    p = points(spark, rows)
    runs = segment_runs(p, F.col("cc")).orderBy("first_us").collect()
    want = naive_runs([(r[0], r[3]) for r in rows])
    assert [(r.run_key, r.n) for r in runs] == [(w[0], w[3]) for w in want]
    got = [(s[0], s[3]) for s in spans(country_stays(p, 9))]
    assert got == [(w[0], w[3]) for w in naive_smooth(want, 9)]

    state, labels, ids = None, {}, []
    for r in rows:
        if state and _km(state[1], state[2], r[1], r[2]) <= 50:
            state[3] += 1
            state[1] += (r[1] - state[1]) / state[3]
            state[2] += (r[2] - state[2]) / state[3]
        else:
            state = [len(ids), r[1], r[2], 1]
        ids.append(state[0])
        labels.setdefault(state[0], []).append(r[4])
    modal = {c: max(dict.fromkeys(ls), key=ls.count) for c, ls in labels.items()}
    want = naive_smooth(naive_runs([(r[0], modal[c]) for r, c in zip(rows, ids)]), 9)
    assert [(s[0], s[3]) for s in spans(city_stays(p, 50, 9))] == [(w[0], w[3]) for w in want]


def test_numbering_across_pieces(spark, many_pieces):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    bad = number_rows(df, ["g"], ["v"]).where(F.col("position") != F.floor(F.col("v") / 2) + 1)
    assert bad.count() == 0


def test_summary(spark):
    row = timeline_summary(country_stays(points(spark, TRIP))).first()
    assert (row.stays, row.photos, row.places, row.days) == (3, 6, 2, 6)
