import struct

import numpy as np
import pytest
from cartulary.functions import codec, geometry
from cartulary.operators.query import geometry_query
from cartulary.operators.index import GeohashIndex
from cartulary.schema import BBox
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

LINE5 = [(103.2504, 26.4297), (103.2604, 26.4397), (103.2704, 26.4497), (103.2804, 26.4597), (103.2904, 26.4697)]
COORDS = "fid long, geom_type int, coords array<struct<x:double,y:double>>"
POINTS = st.lists(st.tuples(st.floats(-180, 180), st.floats(-90, 90)), max_size=20)


def test_bbox_of(spark):
    rows = [(1, 1, LINE5), (2, 0, []), (3, 0, LINE5[:1])]
    got = {r.fid: tuple(r.b) for r in spark.createDataFrame(rows, COORDS).select("fid", geometry.bbox_of("coords").alias("b")).collect()}
    assert got == {1: (103.2504, 26.4297, 103.2904, 26.4697), 2: (0, 0, 0, 0), 3: (103.2504, 26.4297, 103.2504, 26.4297)}


def test_type_codes(spark):
    names = {"POINT": 0, "Point25D": 0, "wkbLineString": 1, "LINESTRING": 1, "POLYGON": 2, "Polygon ZM": 2, "MULTIPOINT": 3, "MultiLineString25D": 4, "MULTIPOLYGON": 5, "CURVE": 0, None: 0}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", geometry.geometry_code(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names


def test_flatten_keeps_exterior_rings(spark):
    ring, hole = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)]
    rows = [(2, [[ring, hole]]), (5, [[ring, hole], [hole]]), (1, [[ring]]), (9, [[ring]])]
    df = spark.createDataFrame(rows, "t int, parts array<array<array<struct<x:double,y:double>>>>")
    got = [[tuple(p) for p in r.c] for r in df.select(geometry.flatten_parts(F.col("t"), F.col("parts")).alias("c")).collect()]
    assert got == [ring, ring + hole, ring, []]


def test_properties(spark):
    df = spark.createDataFrame([(1, "测试要素", 100.5, None), (2, "", 5.0, 7)], "fid long, name string, length double, n int")
    df = df.select("fid", geometry.stringify({"name": F.col("name"), "length": F.col("length"), "n": F.col("n")}).alias("properties"))
    got = {r.fid: r for r in df.select("fid", "properties", geometry.get_property(F.col("properties"), "n", "默认值").alias("d")).collect()}
    assert got[1].properties == {"name": "测试要素", "length": "100.5"} and got[1].d == "默认值"
    assert got[2].properties == {"name": "", "length": "5.0", "n": "7"} and got[2].d == "7"
    typed = geometry.pivot_properties(df, {"length": "double", "n": "int"}).orderBy("fid").collect()
    assert [(r.length, r.n) for r in typed] == [(100.5, None), (5.0, 7)]


def test_envelope_order(spark):
    r = spark.range(1).select(geometry.reorder_envelope(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("b")).head().b
    assert tuple(r) == (1, 3, 2, 4)


def test_exact_geometry(spark):
    box = BBox(2, 2, 4, 4)
    cases = {
        "point inside": (0, [(3, 3)], True), "point on the edge": (0, [(4, 4)], True), "point outside": (3, [(1, 1), (5, 5)], False),
        "line across": (1, [(0, 3), (9, 3)], True), "line past the corner": (1, [(0, 3), (3, 6)], False), "line touches": (1, [(0, 4), (9, 4)], True),
        "box in polygon": (2, [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], True), "polygon around": (2, [(0, 0), (9, 0), (9, 9), (8, 1), (0, 0)], False),
        "polygon inside": (2, [(2.5, 2.5), (3, 2.5), (3, 3), (2.5, 2.5)], True),
    }
    rows = [(i, t, [(float(x), float(y)) for x, y in c]) for i, (t, c, _) in enumerate(cases.values())]
    df = spark.createDataFrame(rows, COORDS).select("*", geometry.bbox_of("coords").alias("b")).select("fid", "geom_type", "coords", "b.*")
    want = {i for i, (_, _, hit) in enumerate(cases.values()) if hit}
    assert {r.fid for r in geometry.rect_intersects(df, box).collect()} == want
    assert {r.fid for r in geometry_query(df, GeohashIndex(4).build(df), box).collect()} == want


@given(POINTS, st.sampled_from(["plain", "adaptive"]))
def test_round_trip_moves_little(points, mode):
    back = codec.decode_points(codec.encode_points(np.array(points).reshape(-1, 2), mode), mode)
    assert len(back) == len(points)
    if mode == "plain" or all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) < 1 for a, b in zip(points, points[1:], strict=False)):
        for i, (a, b) in enumerate(zip(points, back, strict=True)):
            assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 3e-5 * (i + 1)


@given(POINTS)
def test_raw_is_lossless(points):
    assert codec.decode_points(codec.encode_points(np.array(points).reshape(-1, 2), "raw"), "raw").tolist() == [list(p) for p in points]


def test_layouts_and_flags():
    line = codec.encode_points(np.array(LINE5))
    assert len(line) == 17 + 8 * 4 < 80 and line[16] == codec.FLOAT and struct.unpack("<2d", line[:16]) == LINE5[0]
    assert codec.encode_points(np.zeros((0, 2))) == b"" and len(codec.encode_points(np.array(LINE5[:1]))) == 16
    short = codec.encode_points(np.array([(0, 0), (1.5, 2.5), (100, -100)]))
    assert short[16] == codec.SHORT and struct.unpack("<4h", short[17:]) == (2, 2, 98, -102)  # halves go to the even number
    whole = codec.encode_points(np.array([(0, 0), (40000.4, 0)]))
    assert whole[16] == codec.INT and struct.unpack("<2i", whole[17:]) == (40000, 0)
    assert codec.encode_points(np.array([(0, 0), (3e9, 0)]))[16] == codec.FLOAT
    cut = codec.encode_points(np.array([(0, 0), (1.9, -1.9)]), "truncated")
    assert cut[16] == codec.SHORT and struct.unpack("<2h", cut[17:]) == (1, -1)
    assert codec.decode_points(codec.encode_points(np.array(LINE5), "truncated")).tolist() == [list(LINE5[0])] * 5
    assert len(codec.encode_points(np.array(LINE5), "plain")) == 16 + 8 * 4


def test_damaged_bytes():
    assert len(codec.decode_points(b"123")) == 0
    assert codec.decode_points(struct.pack("<2d", 1, 2) + b"\x09abcd").tolist() == [[1, 2]]
    assert codec.decode_points(struct.pack("<2dB4h", 1, 2, 0, 1, 1, 2, 2)[:-1]).tolist() == [[1, 2], [2, 3]]


def test_columns_agree_with_bytes(spark):
    rows = [(1, 1, LINE5), (2, 1, []), (3, 0, LINE5[:1]), (4, 1, [(0.0, 0.0), (2.5, 3.5), (3.0, 3.0)]), (5, 1, [(103.2504, 26.4297)] * 3), (6, 1, None)]
    df = spark.createDataFrame(rows, COORDS)
    out = df.select("fid", "coords", codec.largest_delta(F.col("coords")).alias("m"), *[codec.decode(codec.encode(F.col("coords"), m), m).alias(m) for m in codec.MODES]).collect()
    by = {r.fid: r for r in out}
    assert by[6].adaptive is None
    for r in out:
        if r.coords is not None:
            points = np.array(r.coords, float).reshape(-1, 2)
            for m in codec.MODES:
                assert [tuple(p) for p in r[m]] == [tuple(p) for p in codec.decode_points(codec.encode_points(points, m), m)]
    assert by[4].m == 3.5 and len(by[5].adaptive) == 3
    steps = codec.deltas(F.col("coords"))
    sums = df.where("size(coords) > 0").select("coords", codec.decode_sql(F.col("coords")[0], steps).alias("s")).collect()
    for r in sums:
        assert np.allclose([tuple(p) for p in r.s], [tuple(p) for p in r.coords], atol=1e-9)
    with pytest.raises(ValueError):
        codec.encode(F.col("coords"), "zip")
