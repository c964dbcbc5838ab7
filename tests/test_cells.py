import math
import random

import numpy as np
import pytest
from cartulary.functions import geohash, hexgrid, s2
from cartulary.operators.index import BoundsIndex, GeohashIndex, HexIndex, S2Index
from cartulary.operators.query import bbox_query, scan_query
from cartulary.plans import planner
from cartulary.schema import BOXES, BBox
from cartulary.sources import derived
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LON, LAT = st.floats(-180, 180), st.floats(-90, 90)


def test_boxes_are_checked():
    for bad in ((1, 0, 0, 0), (0, 1, 0, 0), (179, 0, -179, 1), (float("nan"), 0, 1, 1), (0, 0, math.inf, 1)):
        with pytest.raises(ValueError):
            BBox(*bad)


@settings(max_examples=300, deadline=None)
@given(LON, LON, LAT, LAT, st.floats(0, 1), st.floats(0, 1), st.integers(0, 6))
def test_s2_cover_holds_its_points(a, b, c, d, u, v, level):
    x0, x1, y0, y1 = min(a, b), max(a, b), min(c, d), max(c, d)
    cells = set(s2.cover_box(BBox(x0, y0, x1, y1), level).tolist())
    xs, ys = np.array([x0, x1, x0, x1, x0 + u * (x1 - x0)]), np.array([y0, y0, y1, y1, y0 + v * (y1 - y0)])
    assert set(s2.cell_of(xs, np.minimum(ys, y1), level).tolist()) <= cells


def test_s2_known_cells(spark):
    assert s2.cell_of([0.0], [0.0])[0] == 0x1000000000000001
    assert len(s2.cover_box(BOXES["small"], 15)) == 342
    leaf = s2.cell_of([103.25], [26.43])
    assert s2.parent(s2.parent(leaf, 15), 10)[0] == s2.parent(leaf, 10)[0] == s2.cell_of([103.25], [26.43], 10)[0]
    south = s2.cell_of([10.0, -170.0], [-80.0, 5.0])
    rows = spark.createDataFrame([(int(c),) for c in [*leaf, *south]], "c long").select("c", s2.parent_column(F.col("c"), 9).alias("p")).collect()
    assert all(r.p == s2.parent([r.c], 9)[0] for r in rows)


def test_s2_postings_come_once(spark):
    rows = [(1, -180.0, -90.0, 180.0, 90.0), (2, -100.0, 10.0, 170.0, 50.0), (3, 102.0, 25.0, 104.0, 27.0), (4, 44.9, 34.0, 45.2, 36.0), (5, 0.0, 0.0, 0.0, 0.0)]
    f = spark.createDataFrame(rows, "fid long, min_x double, min_y double, max_x double, max_y double")
    got = [(r.fid, r.cell) for r in s2.cells_of(f, 4).collect()]
    assert len(got) == len(set(got))
    for fid, *box in rows:
        assert {c for i, c in got if i == fid} == set(s2.cover_box(BBox(*box), 4).tolist())
    assert sum(i == 1 for i, _ in got) == 6 * 4**4


def test_auto_level(spark):
    areas = [0.0, 1e-9, 1e-4, 0.5, 64800.0]
    got = spark.createDataFrame([(a,) for a in areas], "a double").select(s2.auto_level_column(F.col("a")).alias("l")).collect()
    assert [r.l for r in got] == [s2.auto_level(a) for a in areas] and got[0].l == 30
    assert s2.effective_level(15, BOXES["large"]) == 15


def test_geohash_known_and_neighbourly(spark):
    pts = [(103.2504, 26.4297), (180.0, 90.0), (-180.0, -90.0), (0.0, 0.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    got = [r.g for r in df.select(geohash.encode(F.col("y"), F.col("x"), 6).alias("g")).collect()]
    assert got == ["wk9qme", "zzzzzz", "000000", "s00000"]
    assert geohash.bits(5) == (13, 12)
    with pytest.raises(ValueError):
        geohash.bits(13)


def test_sampled_cover_is_a_subset(spark):
    f = derived.features(spark, "/root/testdata/sf0.001")
    exact, sampled = GeohashIndex(6).build(f), GeohashIndex(6, mode="sampled").build(f)
    for box in (BOXES["small"], BBox(103.25, 26.42, 103.2545, 26.4245)):
        a, b = ({r.cell for r in i.query_cells(box).collect()} for i in (exact, sampled))
        assert b <= a and len(a) == geohash.count_cells(box, 6)


def test_hex_cells_hold_nearby_points(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(-179, 179), rng.uniform(-89, 89)) for _ in range(400)]
    for resolution in (2, 6, 9):
        s = hexgrid.size(resolution)
        b = hexgrid.buffer_of(resolution)
        df = spark.createDataFrame(pts, "x double, y double").withColumn("c", hexgrid.cell_of(F.col("x"), F.col("y"), resolution))
        df = df.withColumn("r", F.explode(hexgrid.rows_of(F.col("y") - b, F.col("y") + b, resolution)))
        df = df.withColumn("q", F.explode(hexgrid.columns_of(F.col("x") - b, F.col("x") + b, F.col("r"), resolution)))
        seen = df.withColumn("cover", hexgrid.cell_id(F.col("q"), F.col("r"))).groupBy("x", "y").agg(F.max((F.col("c") == F.col("cover")).cast("int")).alias("ok"))
        assert seen.count() == len(pts) and seen.where("ok = 0").count() == 0
        assert s > 0
    with pytest.raises(ValueError):
        hexgrid.size(16)


@pytest.fixture(scope="module")
def wide(spark):
    """Features anywhere on the globe, also across face borders and at the poles."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x, y = rng.choice([(-45, 35.3), (45, -35.2), (135, 0), (0, 90), (100, -90), (rng.uniform(-180, 179), rng.uniform(-90, 89))])
        x, y = float(max(-180, min(179.8, x + rng.uniform(-0.1, 0.1)))), float(max(-90, min(89.8, y + rng.uniform(-0.1, 0.1))))
        rows.append((i, x, y, x + rng.uniform(0, 0.2), min(90.0, y + rng.uniform(0, 0.2))))
    return spark.createDataFrame(rows, "fid long, min_x double, min_y double, max_x double, max_y double").cache()


@pytest.mark.parametrize("index", [GeohashIndex(4), GeohashIndex(5), S2Index(8), S2Index(11), HexIndex(4), BoundsIndex()], ids=lambda i: i.name)
def test_candidates_hold_the_exact_answer(wide, index):
    index.build(wide)
    bounds = BoundsIndex().build(wide)
    rng = random.Random(5)
    for k in range(8):
        x, y = rng.choice([(-45, 35), (134.9, -0.1), (-180, 88), (rng.uniform(-170, 160), rng.uniform(-80, 70))])
        box = BBox(x, y, x + rng.choice([0.1, 2, 15]), min(90, y + rng.choice([0.1, 2, 15])))
        want = {r.fid for r in scan_query(wide, box).collect()}
        assert want <= {r.fid for r in index.query(box).collect()}, box
        for use_bounds in (True, False):
            assert sorted(r.fid for r in bbox_query(wide, index, box, bounds, use_bounds).collect()) == sorted(want)


def test_unloaded_index_and_save(spark, wide, tmp_path):
    with pytest.raises(RuntimeError):
        S2Index().query(BOXES["small"])
    path = str(tmp_path / "cells")
    assert not GeohashIndex.exists(spark, path)
    index = GeohashIndex(4).build_or_load(wide, path)
    assert GeohashIndex.exists(spark, path)
    again = GeohashIndex(4).build_or_load(wide.limit(0), path)
    assert again.table.count() == index.table.count() == sum(r.n for r in index.cell_counts().collect())
    assert {(r.cell, f) for r in again.postings().collect() for f in r.fids} == {(r.cell, r.fid) for r in index.table.collect()}


def test_planner_chooses(spark, wide):
    index = S2Index(20).build(wide)
    assert planner.choose(None, BOXES["small"]).way == "scan"
    assert planner.choose(GeohashIndex(5).build(wide), BOXES["medium"]).way == "probe"
    found, choice = planner.run(wide, index, BOXES["large"])
    assert choice.way == "scan" and choice.cells > 10_000
    assert {r.fid for r in found.collect()} == {r.fid for r in scan_query(wide, BOXES["large"]).collect()}


def test_box_filter_reaches_the_scan(spark, wide, tmp_path, capsys):
    path = str(tmp_path / "bounds")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    BoundsIndex().build(wide).save(path)
    BoundsIndex().load(spark, path).query(BOXES["small"]).explain()
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("LessThanOrEqual(min_x", "GreaterThanOrEqual(max_x", "LessThanOrEqual(min_y", "GreaterThanOrEqual(max_y"):
        assert part in pushed
    assert "morton" not in plan[plan.index("ReadSchema") :]


def test_probe_broadcasts_the_cells(spark, wide, tmp_path, capsys):
    path = str(tmp_path / "index")
    GeohashIndex(5).build(wide).save(path)
    GeohashIndex(5).load(spark, path).query(BOXES["small"]).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
