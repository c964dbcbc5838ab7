"""The store, dictionary, offsets, file sources, profiles, statistics and the incremental layer."""

import json
import os
import struct

import pytest
from cartulary.operators import dictionary, offsets, profile, stats, store
from cartulary.operators.index import GeohashIndex, S2Index
from cartulary.schema import BENCH_SCHEMA, BOXES, FEATURE_SCHEMA
from cartulary.sources import dat, derived, export, shapefile
from cartulary.streaming import append
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

ROWS = [
    (1, 0, [(120.0, 30.0)], 120.0, 30.0, 120.0, 30.0, {"name": "点", "type": "poi"}),
    (2, 1, [(120.0, 30.0), (120.1, 30.1), (120.2, 30.2)], 120.0, 30.0, 120.2, 30.2, {"name": "line", "type": "道路", "note": ""}),
    (0, 2, [(120.0, 30.0), (120.1, 30.0), (120.1, 30.1), (120.0, 30.0)], 120.0, 30.0, 120.1, 30.1, {"name": "poly", "type": "poi"}),
    (3, 0, [], 0.0, 0.0, 0.0, 0.0, {"name": "empty"}),
    (9, 0, [(1.0, 1.0)], 1.0, 1.0, 1.0, 1.0, {}),
]


@pytest.fixture(scope="module")
def layer(spark):
    return spark.createDataFrame(ROWS, FEATURE_SCHEMA).cache()


def test_store(spark, layer, tmp_path):
    path = str(tmp_path / "layer")
    with pytest.raises(FileNotFoundError):
        store.FeatureStore.open(spark, path)
    kept = store.FeatureStore.ensure(layer, path)
    assert store.FeatureStore.ensure(layer.limit(0), path).ids().count() == 4  # empty geometry left out, written once
    kept = store.FeatureStore.open(spark, path).cache()
    assert kept.has(0) and not kept.has(3) and not kept.has(999999)
    assert kept.get(2).geom_type == 1 and kept.get_attributes(2)["note"] == "" and kept.get_attributes(999999) == {}
    with pytest.raises(KeyError):
        kept.get(999999)
    assert [r.fid for r in kept.get_many([9, 0, 0, 77]).collect()] == [0, 9]
    assert [r.fid for r in kept.sequential(2).collect()] == [0, 1]
    assert [r.fid for r in kept.random(3, 5).collect()] == [r.fid for r in kept.random(3, 5).collect()]
    assert {r.fid for r in store.missing(kept.features, spark.createDataFrame([(9,), (10,)], "fid long")).collect()} == {10}
    picks = store.random_with_replacement(kept.features, 50).collect()
    assert len(picks) == 50 and {p.fid for p in picks} <= {0, 1, 2, 9}
    kept.clear_cache()
    store.FeatureStore.write(layer.where("fid = 1"), path, "append")
    assert kept.geometries().count() == 5


def test_dictionary(spark, layer):
    rows = dictionary.to_rows(layer.where("fid < 3"))
    pool = dictionary.build_pool(rows).cache()
    got = {r.value: r.string_id for r in pool.collect()}
    want: dict[str, int] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.fid, r.pos)):
        for s in (r.key, r.value):
            want.setdefault(s, len(want))
    assert got == want and len(got) == 9
    encoded = dictionary.encode(rows, pool)
    back = dictionary.decode(encoded, pool)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select("fid", "pos", "key", "value").collect()))
    assert {r.fid: r.properties for r in dictionary.to_maps(back).collect()} == {r[0]: r[7] for r in ROWS if r[0] < 3}
    with pytest.raises(PySparkException):
        dictionary.decode(encoded, pool, strict=True).collect()
    assert {tuple(p) for p in {r.fid: r.pairs for r in dictionary.encode_pairs(rows, pool).collect()}[2]} == {(got[k], got[v]) for k, v in ROWS[1][7].items()}
    ids = spark.createDataFrame([(0,), (8,), (999,)], "string_id int")
    assert {r.string_id: r.value for r in dictionary.lookup(ids, pool).collect()} == {0: next(k for k, i in want.items() if i == 0), 8: next(k for k, i in want.items() if i == 8), 999: ""}
    assert {r.value: r.string_id for r in dictionary.intern(spark.createDataFrame([("poi",), ("x",)], "value string"), pool).collect()} == {"poi": want["poi"], "x": None}
    s = dictionary.pool_stats(pool).head()
    assert (s.strings, s.bytes) == (9, sum(len(v.encode()) for v in got)) and s.stored_bytes == s.bytes + 36
    chars, raw = (dictionary.compression_stats(rows, u).head() for u in ("chars", "bytes"))
    assert chars.compressed_size == raw.compressed_size == 3 * 12 + 7 * 8 and raw.original_size - chars.original_size == 2 + 4
    assert dictionary.build_pool(rows.limit(0)).collect() == []


def test_duplicate_keys_keep_the_last(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a", "z")], "fid long, pos int, key string, value string")
    assert dictionary.to_maps(rows).head().properties == {"b": "y", "a": "z"}


def test_offsets_and_json(spark, tmp_path):
    recs = spark.createDataFrame([(5, 10), (1, 7), (3, 2)], "fid long, n long")
    got = {r.fid: r.offset for r in offsets.running_offsets(recs, "n").collect()}
    assert got == {1: 0, 3: 7, 5: 9}
    again = spark.createDataFrame([(1, 0, "old"), (1, 9, "new"), (2, 4, "only")], "fid long, offset long, v string")
    assert {r.fid: r.v for r in offsets.last_wins(again).collect()} == {1: "new", 2: "only"}
    text = {"version": 1, "data": {"features": {"12": {"geom_offset": 0, "attr_offset": 3}, "7": {"geom_offset": 9, "attr_offset": 8}}}}
    (tmp_path / "i.json").write_text(json.dumps(text))
    assert sorted(map(tuple, offsets.read_json(spark, str(tmp_path / "i.json")).collect())) == [(7, 9, 8), (12, 0, 3)]
    round_trip = offsets.to_json(offsets.read_json(spark, str(tmp_path / "i.json"))).head().value
    assert json.loads(round_trip) == text
    (tmp_path / "bad.json").write_text('{"data": {}}')
    with pytest.raises(PySparkException):
        offsets.read_json(spark, str(tmp_path / "bad.json")).collect()


@pytest.mark.parametrize("mode", ["adaptive", "plain"])
def test_dat_layer(spark, layer, tmp_path, mode):
    paths = dat.write_layer(layer, str(tmp_path), "roads", mode)
    raw = open(paths["geom"], "rb").read()
    fid, kind, *box, n = struct.unpack_from("<QB7x4dI", raw)
    assert (fid, kind, n, box) == (0, 2, len(raw[52 : 52 + n]), [120.0, 30.0, 120.1, 30.1])
    back = {r.fid: r for r in dat.read_layer(spark, str(tmp_path), "roads", mode).collect()}
    assert back.keys() == {0, 1, 2, 9}
    for r in ROWS:
        if r[2]:
            assert back[r[0]].properties == r[7] and back[r[0]].geom_type == r[1]
            assert max(abs(a - b) for p, q in zip(r[2], back[r[0]].coords, strict=True) for a, b in zip(p, q, strict=True)) < 1e-6
    index = {r.fid: r for r in offsets.read_json(spark, paths["index"]).collect()}
    scanned = {r.fid: r.offset for r in dat.read(spark, "geom", paths["geom"]).collect()}
    assert {f: r.geom_offset for f, r in index.items()} == scanned
    assert {f: r.attr_offset for f, r in index.items()} == {r.fid: r.offset for r in dat.read(spark, "attr", paths["attr"]).collect()}
    split = dat.read(spark, "geom", paths["geom"], sorted(scanned.values())[1:3])
    assert split.rdd.getNumPartitions() == 3 and {r.fid: r.offset for r in split.collect()} == scanned
    near = dat.read(spark, "geom", paths["geom"]).where("fid >= 1 AND bbox.min_x <= 2.0")
    assert [r.fid for r in near.collect()] == [9]
    with open(paths["geom"], "ab") as f:
        f.write(raw[: 52 + n - 1])
    with pytest.raises(PySparkException):
        dat.read(spark, "geom", paths["geom"]).collect()


def test_appended_records_last_wins(spark, layer, tmp_path):
    a = dat.pack_geometry(1, 0, (0, 0, 0, 0), b"") + dat.pack_geometry(1, 5, (1, 1, 2, 2), b"")
    (tmp_path / "x_geom.dat").write_bytes(a)
    rows = dat.read(spark, "geom", str(tmp_path))
    assert [r.geom_type for r in offsets.last_wins(rows).collect()] == [5]


def test_index_files(spark, tmp_path):
    f = derived.features(spark, "/root/testdata/sf0.001").limit(50).cache()
    cells = S2Index(13).build(f).table
    dat.index_table(cells, str(tmp_path / "x_s2.idx"), "s2idx")
    assert sorted(map(tuple, dat.read(spark, "s2idx", str(tmp_path)).collect())) == sorted(map(tuple, cells.select("cell", "fid").collect()))
    dat.index_table(f, str(tmp_path / "x_rtree.idx"), "rtreeidx")
    assert os.path.getsize(tmp_path / "x_rtree.idx") == 8 + 36 * 50
    assert {r.fid: r.min_x for r in dat.read(spark, "rtreeidx", str(tmp_path)).collect()} == {r.fid: r.min_x for r in f.collect()}
    (tmp_path / "x_index.bin").write_bytes(struct.pack("<I", 2) + struct.pack("<Qqq", 4, 0, 1) + struct.pack("<Qqq", 9, 70, 33))
    assert sorted(map(tuple, dat.read(spark, "offsets", str(tmp_path)).collect())) == [(4, 0, 1), (9, 70, 33)]


def shp_bytes(kind, contents):
    body = b"".join(struct.pack(">2i", i + 1, len(c) // 2) + c for i, c in enumerate(contents))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body


def poly(kind, parts):
    points = [p for part in parts for p in part]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def dbf_bytes(fields, rows):
    size = 1 + sum(w for _, _, w, _ in fields)
    head = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size)
    desc = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in fields)
    return head + desc + b"\r" + b"".join(b" " + b"".join(str(v).encode().ljust(w) for v, (_, _, w, _) in zip(r, fields, strict=True)) for r in rows)


def test_shapefile(spark, tmp_path):
    outer, hole, other = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 20), (20, 21), (21, 21), (20, 20)]
    shapes = [struct.pack("<i2d", 1, 3, 4), struct.pack("<i", 0), poly(3, [[(0, 0), (1, 1)]]), poly(13, [[(0, 0), (1, 1)], [(5, 5), (6, 6)]]), poly(5, [outer, hole]), poly(15, [outer, hole, other])]
    shapes += [struct.pack("<i4di", 8, 0, 0, 0, 0, 2) + struct.pack("<4d", 1, 2, 3, 4), struct.pack("<i", 31) + b"\0" * 60]
    (tmp_path / "a.shp").write_bytes(shp_bytes(1, shapes))
    fields = [("NAME", "C", 10, 0), ("N", "N", 6, 0), ("F", "N", 8, 2), ("D", "D", 8, 0), ("L", "L", 1, 0)]
    (tmp_path / "a.dbf").write_bytes(dbf_bytes(fields, [("r%d" % i, i, "%.2f" % (i / 4), "20240131", "T") for i in range(7)] + [("", "", "", "", "?")]))
    got = {r.fid: r for r in shapefile.read(spark, str(tmp_path)).collect()}
    assert {i: r.geom_type for i, r in got.items()} == {0: 0, 2: 1, 3: 4, 4: 2, 5: 5, 6: 3}
    assert got[0].properties == {"NAME": "r0", "N": "0", "F": "0.0", "D": "2024/01/31", "L": "1"}
    assert [tuple(p) for p in got[4].coords] == outer and got[5].part_offsets == [0, 5] and len(got[5].coords) == 9
    assert (got[5].min_x, got[5].max_y) == (0, 21) and got[6].part_offsets == [0, 1]
    (tmp_path / "b.shp").write_bytes(b"no")
    with pytest.raises(PySparkException):
        shapefile.read(spark, str(tmp_path / "b.shp")).collect()


def test_geojson_and_json_attributes(spark, layer):
    lines = [json.loads(r.value) for r in export.geojson(layer).collect()]
    by = {x["id"]: x for x in lines}
    assert by[1]["geometry"] == {"type": "Point", "coordinates": [120.0, 30.0]} and by[0]["geometry"]["coordinates"][0][0] == [120.0, 30.0]
    assert by[2]["properties"] == ROWS[1][7] and 3 not in by
    back = {r.fid: r.properties for r in export.attributes_from_json(export.attributes_json(layer)).collect()}
    assert back == {r[0]: r[7] for r in ROWS}


def test_profiles(spark, layer):
    sized = layer.select("fid", "geom_type", F.size("coords").alias("coords_n"), (F.size("coords") * 16 + 52).cast("long").alias("geom_bytes"), F.size("properties").alias("n_properties"))
    i = profile.integrity(sized, sized).head()
    assert (i.valid_geometries, i.geometry_percent, i.valid_records) == (4, 80.0, 4)
    c = profile.consistency(layer, layer.where("fid <> 1"), layer.where("fid > 1")).head()
    assert (c.missing_both, c.missing_geometry, c.missing_attributes, c.consistent) == (1, 0, 1, False)
    e = profile.memory_estimate(sized.select(F.lit(1000).alias("n_bytes")), sized.select(F.lit(10).alias("n_bytes"))).head()
    assert e.pressure == "very high" and e.estimated_bytes == 5 * 32
    none = profile.memory_estimate(sized.limit(0).select(F.lit(1).alias("n_bytes")), sized.limit(0).select(F.lit(1).alias("n_bytes"))).head()
    assert none.elements == 0 and none.target_geometry_mb is None
    sizes = layer.select("fid", offsets.attribute_text_size(F.col("properties")).alias("n")).collect()
    want = {r[0]: 12 + len(json.dumps(r[7], ensure_ascii=False, separators=(",", ":")).encode()) for r in ROWS}
    assert {r.fid: r.n for r in sizes} == want


def test_t_distribution():
    # tabulated quantiles of the two-sided 5 %, 1 % and 0.1 % levels
    for freedom, quantiles in {1: (12.706, 63.657), 10: (2.228, 3.169, 4.587), 30: (2.042, 2.750, 3.646), 120: (1.980, 2.617, 3.373)}.items():
        for t, p in zip(quantiles, (0.05, 0.01, 0.001), strict=False):
            assert abs(stats.t_p_value(t, freedom) / p - 1) < 0.01
    assert stats.t_p_value(0.0, 5) == 1.0 and stats.t_p_value(None, 5) is None and stats.t_p_value(1.0, 0) is None


def test_statistics(spark):
    rows = [("s2", 10, 1.0), ("s2", 10, 2.0), ("s2", 10, 3.0), ("ogr", 10, 4.0), ("ogr", 10, 6.0), ("ogr", 10, 8.0), ("s2", 100, 5.0), ("s2", 10, -1.0)]
    r = spark.createDataFrame(rows, "index_type string, data_size long, time_ms double")
    one = {x.data_size: x for x in stats.sample_stats(r.where("index_type = 's2'"), "data_size").collect()}
    assert (one[10].n, one[10].mean, one[10].median, one[10].std) == (3, 2.0, 2.0, 1.0) and one[100].std == 0.0
    good = r.where("time_ms > 0 AND data_size = 10")
    t = stats.t_test(good, "data_size").head()
    assert abs(t.t - (2 - 6) / ((2.5**0.5) * (2 / 3) ** 0.5)) < 1e-12 and t.freedom == 4 and 0.02 < t.p < 0.05 and t.significance == "significant"
    d = stats.cohens_d(good, "data_size").head()
    assert abs(d.d - 4 / 2.5**0.5) < 1e-12 and d.effect == "large"
    assert stats.improvement(good).head().time_gain == pytest.approx(66.6666667) and stats.mean_speedup(good).head().mean_speedup == 3.0
    assert stats.nearest_size(r, 55).head().data_size == 10
    assert stats.PRESETS["quick"] == (3, (100, 1000))


def test_harness_and_result_files(spark, tmp_path):
    def fails():
        raise RuntimeError("broken")

    rows = stats.measure(spark, {("s2", "spatial_query", 10): lambda: 3, ("ogr", "build", 10): fails}, iterations=2)
    got = rows.collect()
    assert [(x.index_type, x.result_count, x.iterations) for x in got] == [("s2", 3, 2)] and rows.schema == BENCH_SCHEMA
    stats.write_results(rows, str(tmp_path / "r"))
    back = stats.read_results(spark, str(tmp_path / "r"))
    assert stats.series(back, "spatial_query", "s2").count() == 1 and stats.series(back, "build").count() == 0


def test_stream_keeps_the_index(spark, layer, tmp_path):
    src, feats, idx, check = (str(tmp_path / n) for n in ("src", "features", "index", "checkpoint"))
    index = GeohashIndex(5)
    for part in (layer.where("fid < 2 AND size(coords) > 0"), layer.where("fid >= 2 AND size(coords) > 0")):
        part.write.mode("append").parquet(src)
        append.append_index(append.read_features(spark, src), index, feats, idx, check).awaitTermination()
    assert {r.fid for r in spark.read.parquet(feats).collect()} == {0, 1, 2, 9}
    loaded = GeohashIndex(5).load(spark, idx)
    assert {r.fid for r in loaded.query(BOXES["small"].expand(20)).collect()} == {0, 1, 2}


def test_window_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    batch = append.counts_by_window(events, "ts", "event_type")
    assert sum(r.n for r in batch.collect()) == events.count()


def test_picks_follow_the_circle_of_hashes(spark):
    from bisect import bisect_left

    for n, k in ((400, 1000), (3, 50)):
        features = spark.range(n).select(F.col("id").alias("fid"))
        circle = sorted((r.h, r.fid) for r in features.select(F.xxhash64("fid", F.lit(42)).alias("h"), "fid").collect())
        asked = {r.id: r.p for r in spark.range(k).select("id", F.xxhash64("id", F.lit(43)).alias("p")).collect()}
        want = {i: circle[bisect_left(circle, (p, -1)) % n][1] for i, p in asked.items()}
        assert {r.pick: r.fid for r in store.random_with_replacement(features, k).collect()} == want
