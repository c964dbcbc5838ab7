"""All registered queries of the feature layer operators, and their SQL.

Indexes are built inside the queries, from features that the order tables give
(sources.derived). A query with the exact check answers as the plain box scan
does, so its SQL is the box predicate, whatever index it goes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import codec, geohash, geometry, hexgrid, s2
from cartulary.operators import dictionary, offsets, profile, query, stats, store, tester
from cartulary.operators.index import BoundsIndex, GeohashIndex, HexIndex, S2Index
from cartulary.schema import BOXES, BBox
from cartulary.session import cut, scratch
from cartulary.sources import dat, derived, export

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL that the counterparts share
_FEATURES = derived.FEATURES.format(orders="orders")
_N = derived.POINTS
_VERTICES = derived.VERTICES.format(numbered=f"SELECT *, unnest(generate_series(0, n - 1)) AS pos FROM (SELECT *, {_N} AS n FROM ({_FEATURES}))")
_ATTRIBUTES = f"""
SELECT fid, 0 AS pos, 'status' AS key, o_orderstatus AS value FROM ({_FEATURES}) JOIN orders ON fid = o_orderkey
UNION ALL SELECT fid, 1, 'priority', o_orderpriority FROM ({_FEATURES}) JOIN orders ON fid = o_orderkey
UNION ALL SELECT fid, 2, 'cents', CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR) FROM ({_FEATURES}) JOIN orders ON fid = o_orderkey WHERE fid % 7 <> 0
UNION ALL SELECT fid, 3, 'note', CASE WHEN fid % 50 = 0 THEN '' ELSE 'n' END FROM ({_FEATURES})
"""
_RESULTS = """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 's2' ELSE 'ogr' END AS index_type,
  CAST(CASE event_id % 5 WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 1000 WHEN 3 THEN 5000 ELSE 10000 END AS BIGINT) AS data_size, value AS time_ms FROM events
"""
_WITH = f"WITH f AS ({_FEATURES}), v AS ({_VERTICES}), a AS ({_ATTRIBUTES}), r AS ({_RESULTS})"


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = f"{_WITH}\n{sql}" if sql.lstrip().upper().startswith("SELECT") else sql
        return fn

    return add


def sql_box(box: BBox) -> str:
    a, b, c, d = box.astuple()
    return f"min_x <= CAST({c!r} AS DOUBLE) AND max_x >= CAST({a!r} AS DOUBLE) AND min_y <= CAST({d!r} AS DOUBLE) AND max_y >= CAST({b!r} AS DOUBLE)"


# ---- box queries --------------------------------------------------------------------------------------------------

for _name, _box in BOXES.items():

    @register(f"bbox_scan_{_name}", f"SELECT fid, geom_type FROM f WHERE {sql_box(_box)}")
    def _scan(spark, sf, box=_box):
        return query.scan_query(derived.features(spark, sf), box).select("fid", "geom_type")


SMALL, MEDIUM, LARGE = BOXES["small"], BOXES["medium"], BOXES["large"]
_EXACT = f"SELECT fid FROM f WHERE {sql_box(MEDIUM)}"
_EXACT_SMALL = f"SELECT fid FROM f WHERE {sql_box(SMALL)}"


def _gh(prefix: str, value: str, low: int, span: int, n: int) -> str:
    return f"greatest(0, least({(1 << n) - 1}, CAST(floor(({value} - CAST({low} AS DOUBLE)) / CAST({span} AS DOUBLE) * CAST({1 << n} AS DOUBLE)) AS BIGINT)))"


def _gx(value: str, precision: int = 6) -> str:
    return _gh("x", value, -180, 360, geohash.bits(precision)[0])


def _gy(value: str, precision: int = 6) -> str:
    return _gh("y", value, -90, 180, geohash.bits(precision)[1])


_CELLS = f"""(SELECT fid, gy * {1 << geohash.bits(6)[0]} + unnest(generate_series(x0, x1)) AS cell FROM (
  SELECT fid, {_gx("min_x")} AS x0, {_gx("max_x")} AS x1, unnest(generate_series({_gy("min_y")}, {_gy("max_y")})) AS gy FROM f))"""


def _box_cells(box: BBox) -> str:
    x0, x1 = (_gx(f"CAST({v!r} AS DOUBLE)") for v in (box.min_x, box.max_x))
    y0, y1 = (_gy(f"CAST({v!r} AS DOUBLE)") for v in (box.min_y, box.max_y))
    return f"(SELECT gy * {1 << geohash.bits(6)[0]} + unnest(generate_series({x0}, {x1})) AS cell FROM (SELECT unnest(generate_series({y0}, {y1})) AS gy))"


def _string(key: str) -> str:
    return " || ".join(f"substr('{geohash.ALPHABET}', CAST((({key}) >> {5 * (5 - i)}) & 31 AS INT) + 1, 1)" for i in range(6))


def _interleave(gx: str, gy: str) -> str:
    return " | ".join(f"(((({gx if k % 2 == 0 else gy}) >> {14 - k // 2}) & 1) << {29 - k})" for k in range(30))


@register("geohash_encode", f"SELECT fid, {_string('key')} AS geohash, x AS gx, y AS gy FROM (SELECT fid, x, y, {_interleave('x', 'y')} AS key FROM (SELECT fid, {_gx('min_x')} AS x, {_gy('min_y')} AS y FROM f))")
def geohash_encode(spark, sf):
    x, y = F.col("min_x"), F.col("min_y")
    return derived.features(spark, sf).select("fid", geohash.encode(y, x, 6).alias("geohash"), geohash.grid_x(x, 6).alias("gx"), geohash.grid_y(y, 6).alias("gy"))


@register("geohash_index_postings", f"SELECT cell, fid FROM {_CELLS}")
def geohash_index_postings(spark, sf):
    return GeohashIndex(6).index(derived.features(spark, sf))


@register("geohash_cell_counts", f"SELECT cell, count(*) AS n FROM {_CELLS} GROUP BY cell")
def geohash_cell_counts(spark, sf):
    return GeohashIndex(6).build(derived.features(spark, sf)).cell_counts()


@register("geohash_distinct_cells", f"SELECT count(DISTINCT cell) AS cells FROM {_CELLS}")
def geohash_distinct_cells(spark, sf):
    return GeohashIndex(6).build(derived.features(spark, sf)).table.agg(F.count_distinct("cell").alias("cells"))


@register("geohash_candidates", f"SELECT DISTINCT fid FROM {_CELLS} JOIN {_box_cells(MEDIUM)} USING (cell)")
def geohash_candidates(spark, sf):
    return GeohashIndex(6).build(derived.features(spark, sf)).query(MEDIUM)


@register("geohash_postings_of_box", f"SELECT fid, count(*) AS n FROM {_CELLS} JOIN {_box_cells(SMALL)} USING (cell) GROUP BY fid")
def geohash_postings_of_box(spark, sf):
    """Candidates with their duplicates, as a probe finds them."""
    return GeohashIndex(6).build(derived.features(spark, sf)).candidates(SMALL).groupBy("fid").agg(F.count("*").alias("n"))


def _hybrid(index, box, use_bounds, exact):
    def run(spark, sf):
        f = derived.features(spark, sf)
        bounds = BoundsIndex().build(f) if use_bounds else None
        return query.bbox_query(f, index().build(f), box, bounds, use_bounds, exact)

    return run


register("geohash_exact", _EXACT)(_hybrid(lambda: GeohashIndex(5), MEDIUM, False, True))
register("geohash_bounds", _EXACT)(_hybrid(lambda: GeohashIndex(5), MEDIUM, True, False))
register("geohash_hybrid", _EXACT)(_hybrid(lambda: GeohashIndex(5), MEDIUM, True, True))
register("geohash_hybrid_small", _EXACT_SMALL)(_hybrid(lambda: GeohashIndex(7), SMALL, True, True))
register("s2_exact", _EXACT_SMALL)(_hybrid(lambda: S2Index(15), SMALL, False, True))
register("s2_bounds", _EXACT)(_hybrid(lambda: S2Index(12), MEDIUM, True, False))
register("s2_hybrid", _EXACT)(_hybrid(lambda: S2Index(12), MEDIUM, True, True))
register("s2_hybrid_large", f"SELECT fid FROM f WHERE {sql_box(LARGE)}")(_hybrid(lambda: S2Index(15), LARGE, True, True))
register("hex_buffered_exact", _EXACT_SMALL)(_hybrid(lambda: HexIndex(8), SMALL, False, True))
register("hex_hybrid", _EXACT)(_hybrid(lambda: HexIndex(7), MEDIUM, True, True))
register("bounds_query", _EXACT)(lambda spark, sf: BoundsIndex().build(derived.features(spark, sf)).query(MEDIUM))


@register("s2_candidates")
def s2_candidates(spark, sf):
    return S2Index(15).build(derived.features(spark, sf)).query(SMALL)


@register("s2_cell_counts")
def s2_cell_counts(spark, sf):
    return S2Index(13).build(derived.features(spark, sf)).cell_counts()


@register("s2_point_cells")
def s2_point_cells(spark, sf):
    f = query.scan_query(derived.features(spark, sf), LARGE)
    x, y = geometry.center_of()
    return f.select("fid", s2.cell_column(x, y, 10).alias("cell"))


@register("hex_point_cells")
def hex_point_cells(spark, sf):
    x, y = geometry.center_of()
    return derived.features(spark, sf).select("fid", hexgrid.cell_of(x, y, 7).alias("cell"))


@register("hex_candidates")
def hex_candidates(spark, sf):
    return HexIndex(8).build(derived.features(spark, sf)).query(SMALL)


@register("sql_cell_lookup", f"SELECT DISTINCT fid FROM {_CELLS} WHERE cell IN (SELECT cell FROM {_box_cells(SMALL)})")
def sql_cell_lookup(spark, sf):
    """The index as a SQL table."""
    index = GeohashIndex(6).build(derived.features(spark, sf))
    return spark.sql("SELECT DISTINCT i.fid FROM {index} i LEFT SEMI JOIN {cells} c ON i.cell = c.cell", index=index.table, cells=index.query_cells(SMALL))


@register("exact_geometry_filter")
def exact_geometry_filter(spark, sf):
    return geometry.rect_intersects(derived.layer(spark, sf), MEDIUM).select("fid", "geom_type")


@register("region_records", f"SELECT fid, geom_type, min_x, min_y, max_x, max_y FROM f WHERE {sql_box(SMALL)}")
def region_records(spark, sf):
    f = derived.features(spark, sf)
    return query.region_query(f, GeohashIndex(6).build(f), SMALL).select("fid", "geom_type", *geometry.SIDES)


_BOXES_SQL = """(SELECT c_custkey AS box_id, CAST(102 AS DOUBLE) + CAST((c_custkey*3571) % 290000 AS DOUBLE)/CAST(100000 AS DOUBLE) AS bx,
  CAST(25 AS DOUBLE) + CAST((c_custkey*7411) % 290000 AS DOUBLE)/CAST(100000 AS DOUBLE) AS "by" FROM customer)"""


@register(
    "multi_bbox_join",
    f"""SELECT box_id, fid FROM f JOIN {_BOXES_SQL} b ON min_x <= bx + CAST(0.05 AS DOUBLE) AND max_x >= bx AND min_y <= b."by" + CAST(0.05 AS DOUBLE) AND max_y >= b."by" """,
)
def multi_bbox_join(spark, sf):
    """A box per customer: the spatial join on shared cells."""
    k = F.col("c_custkey")
    x = F.lit(102.0) + ((k * 3571) % 290000).cast("double") / F.lit(100000.0)
    y = F.lit(25.0) + ((k * 7411) % 290000).cast("double") / F.lit(100000.0)
    boxes = spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("box_id"), x.alias("min_x"), y.alias("min_y"), (x + 0.05).alias("max_x"), (y + 0.05).alias("max_y"))
    return query.boxes_query(derived.features(spark, sf), boxes)


@register("display_flags", f"SELECT fid, {sql_box(MEDIUM)} AS is_hit FROM f")
def display_flags(spark, sf):
    f = derived.features(spark, sf).select("fid", *geometry.SIDES)
    return query.display_flags(f, query.scan_query(f, MEDIUM)).select("fid", "is_hit")


@register(
    "index_precision",
    f"SELECT count(*) AS candidates, CAST(sum(CASE WHEN {sql_box(MEDIUM)} THEN 1 ELSE 0 END) AS BIGINT) AS results, CAST(sum(CASE WHEN {sql_box(MEDIUM)} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ratio "
    f"FROM f JOIN (SELECT DISTINCT fid FROM {_CELLS} JOIN {_box_cells(MEDIUM)} USING (cell)) USING (fid)",
)
def index_precision(spark, sf):
    f = derived.features(spark, sf)
    return query.precision_of(f, GeohashIndex(6).build(f), MEDIUM)


@register(
    "auto_level",
    "SELECT fid, CASE WHEN a > 0 THEN least(30, greatest(10, 30 - CAST(round_even(log10(a * CAST(10000 AS DOUBLE)), 0) AS INT))) ELSE 30 END AS level, "
    "CASE WHEN a > 0 THEN least(30, greatest(10, 30 - CAST(trunc(log10(a * CAST(10000 AS DOUBLE))) AS INT))) ELSE 30 END AS level_cut "
    "FROM (SELECT fid, (max_x - min_x) * (max_y - min_y) AS a FROM f)",
)
def auto_level(spark, sf):
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return derived.features(spark, sf).select("fid", s2.auto_level_column(area).alias("level"), s2.auto_level_column(area, "cut").alias("level_cut"))


@register(
    "bench_points",
    "SELECT fid, (min_x + max_x) / CAST(2 AS DOUBLE) AS lon, (min_y + max_y) / CAST(2 AS DOUBLE) AS lat FROM f "
    "WHERE min_x < max_x AND min_y < max_y AND (min_x + max_x) / 2 BETWEEN -180 AND 180 AND (min_y + max_y) / 2 BETWEEN -90 AND 90 AND NOT (geom_type = 5 AND fid % 23 > 10)",
)
def bench_points(spark, sf):
    """Centres of features with an extent, in range and of few parts."""
    x, y = geometry.center_of()
    f = derived.features(spark, sf).withColumn("num_parts", F.when(F.col("geom_type") == 5, F.col("fid") % 23).otherwise(1))
    kept = f.where("min_x < max_x AND min_y < max_y").where(x.between(-180, 180) & y.between(-90, 90)).where("NOT (geom_type = 5 AND num_parts > 10)")
    return kept.select("fid", x.alias("lon"), y.alias("lat"))


@register("valid_boxes", "SELECT geom_type, CAST(sum(CASE WHEN min_x <= max_x AND min_y <= max_y THEN 1 ELSE 0 END) AS BIGINT) AS valid, count(*) AS n FROM f GROUP BY geom_type")
def valid_boxes(spark, sf):
    return derived.features(spark, sf).groupBy("geom_type").agg(F.count_if(geometry.is_valid_bbox()).alias("valid"), F.count("*").alias("n"))


@register("type_names", "SELECT fid, CASE geom_type WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINE' WHEN 2 THEN 'POLYGON' WHEN 3 THEN 'MULTIPOINT' WHEN 4 THEN 'MULTILINE' ELSE 'MULTIPOLYGON' END AS name, geom_type AS code FROM f")
def type_names(spark, sf):
    f = derived.features(spark, sf).withColumn("name", geometry.geometry_name(F.col("geom_type")))
    return f.select("fid", "name", geometry.geometry_code(F.col("name")).alias("code"))


@register("geohash_posting_lists", f"SELECT cell, string_agg(CAST(fid AS VARCHAR), ',' ORDER BY fid) AS fids FROM {_CELLS} GROUP BY cell")
def geohash_posting_lists(spark, sf):
    lists = GeohashIndex(6).build(derived.features(spark, sf)).postings()
    return lists.select("cell", F.array_join(F.col("fids").cast("array<string>"), ",").alias("fids"))


@register("index_memory", f"SELECT count(DISTINCT cell) AS cells, count(*) AS postings, CAST(count(DISTINCT cell) * 16 + count(*) * 8 AS BIGINT) AS bytes FROM {_CELLS}")
def index_memory(spark, sf):
    return profile.index_memory(GeohashIndex(6).index(derived.features(spark, sf)))


@register(
    "index_tester",
    f"SELECT index_type, 'medium' AS box, (SELECT count(*) FROM f WHERE {sql_box(MEDIUM)}) AS results FROM (SELECT unnest(['geohash', 's2', 'hex', 'bounds']) AS index_type)",
)
def index_tester(spark, sf):
    f = derived.features(spark, sf)
    made = [i.build(f) for i in (GeohashIndex(6), S2Index(12), HexIndex(7), BoundsIndex())]
    return tester.compare(f, made, {"medium": MEDIUM}).select("index_type", "box", "results")


@register("flattened_parts", "SELECT fid, CASE WHEN geom_type IN (2, 5) THEN 4 ELSE 2 END * CASE WHEN geom_type >= 3 THEN 2 ELSE 1 END AS points, min_x AS first_x, CASE WHEN geom_type >= 3 THEN max_y ELSE min_y END AS second_part_y FROM f")
def flattened_parts(spark, sf):
    """Geometries as parts of rings: exterior rings of all parts, one after the other."""
    def point(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    ring = F.array(point("min_x", "min_y"), point("max_x", "min_y"), point("max_x", "max_y"), point("min_x", "min_y"))
    hole = F.array(point("min_x", "max_y"))
    line = F.array(point("min_x", "min_y"), point("max_x", "max_y"))
    far_ring = F.array(point("min_x", "max_y"), point("max_x", "max_y"), point("max_x", "min_y"), point("min_x", "max_y"))
    far_line = F.array(point("min_x", "max_y"), point("max_x", "min_y"))
    area, many = F.col("geom_type").isin(2, 5), F.col("geom_type") >= 3
    first = F.when(area, F.array(ring, hole)).otherwise(F.array(line))
    second = F.when(area, F.array(far_ring, hole)).otherwise(F.array(far_line))
    parts = F.when(many, F.array(first, second)).otherwise(F.array(first))
    f = derived.features(spark, sf).withColumn("c", geometry.flatten_parts(F.col("geom_type"), parts))
    second_start = F.when(many, F.get("c", (F.size("c") / 2).cast("int"))["y"]).otherwise(F.get("c", F.lit(0))["y"])
    return f.select("fid", F.size("c").alias("points"), F.get("c", F.lit(0))["x"].alias("first_x"), second_start.alias("second_part_y"))


@register("empty_geometries_dropped", "SELECT fid FROM f WHERE fid % 10 <> 0")
def empty_geometries_dropped(spark, sf):
    """Features without coordinates, or with an empty list of them, do not get into a layer."""
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    shaped = derived.layer(spark, sf).withColumn("coords", F.when(F.col("fid") % 20 == 0, none).when(F.col("fid") % 20 == 10, F.slice("coords", 1, 0)).otherwise(F.col("coords")))
    return store.FeatureStore.write(shaped, scratch(spark, "shaped")).features.select("fid")


# ---- lookups ------------------------------------------------------------------------------------------------------

_SOME = [7, 11, 42, 99, 123, 999999]
_SOME_SQL = ", ".join(map(str, _SOME))


@register("feature_lookup", "SELECT fid, geom_type, min_x, min_y, max_x, max_y FROM f WHERE fid = 42")
def feature_lookup(spark, sf):
    return derived.features(spark, sf).where("fid = 42").select("fid", "geom_type", *geometry.SIDES)


@register("batch_geometries", f"SELECT fid, geom_type, min_x, max_y FROM f WHERE fid IN ({_SOME_SQL})")
def batch_geometries(spark, sf):
    return store.get_many(derived.features(spark, sf), _SOME).select("fid", "geom_type", "min_x", "max_y")


@register("batch_attributes", f"SELECT fid, pos, key, value FROM a WHERE fid IN ({_SOME_SQL})")
def batch_attributes(spark, sf):
    return store.get_many(derived.attributes(spark, sf), _SOME).select("fid", "pos", "key", "value")


@register("geometry_with_attributes", f"SELECT f.fid, geom_type, key, value FROM f JOIN a ON f.fid = a.fid WHERE f.fid < 500 AND {sql_box(MEDIUM)}")
def geometry_with_attributes(spark, sf):
    f = query.scan_query(derived.features(spark, sf), MEDIUM).where("fid < 500")
    return f.join(derived.attributes(spark, sf), "fid").select("fid", "geom_type", "key", "value")


@register("has_feature", f"SELECT id, id IN (SELECT fid FROM f) AS found FROM (SELECT unnest([{_SOME_SQL}]) AS id)")
def has_feature(spark, sf):
    asked = spark.createDataFrame([(i,) for i in _SOME], "id int")
    known = store.get_many(derived.features(spark, sf), _SOME).select(F.col("fid").cast("int").alias("id"), F.lit(True).alias("k"))
    return asked.join(known, "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("found"))


@register("missing_features", f"SELECT CAST(id AS BIGINT) AS fid FROM (SELECT unnest([{_SOME_SQL}]) AS id) WHERE id NOT IN (SELECT fid FROM f)")
def missing_features(spark, sf):
    return store.missing(derived.features(spark, sf), spark.createDataFrame([(i,) for i in _SOME], "fid long"))


@register("all_feature_ids", "SELECT DISTINCT fid FROM f")
def all_feature_ids(spark, sf):
    return derived.features(spark, sf).select("fid").distinct()


@register("first_test_features", "SELECT fid FROM f WHERE fid <> 0 ORDER BY fid LIMIT 10")
def first_test_features(spark, sf):
    return store.sequential(derived.features(spark, sf).where("fid <> 0"), 10).select("fid")


@register("sequential_read", "SELECT f.fid, geom_type, count(key) AS fields FROM (SELECT * FROM f ORDER BY fid LIMIT 1000) f LEFT JOIN a ON f.fid = a.fid GROUP BY f.fid, geom_type")
def sequential_read(spark, sf):
    first = store.sequential(derived.features(spark, sf), 1000).select("fid", "geom_type")
    return first.join(derived.attributes(spark, sf), "fid", "left").groupBy("fid", "geom_type").agg(F.count("key").alias("fields"))


@register("random_read")
def random_read(spark, sf):
    return store.random_features(derived.features(spark, sf), 1000).select("fid", "geom_type")


@register("random_picks")
def random_picks(spark, sf):
    return store.random_with_replacement(derived.features(spark, sf).select("fid"), 1000)


# ---- coordinates --------------------------------------------------------------------------------------------------


@register("coords_exploded", "SELECT fid, pos, x, y FROM v")
def coords_exploded(spark, sf):
    return derived.vertices(spark, sf).select("fid", "pos", "x", "y")


@register("bbox_from_coords", "SELECT fid, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v GROUP BY fid")
def bbox_from_coords(spark, sf):
    return derived.layer(spark, sf).select("fid", geometry.bbox_of("coords").alias("b")).select("fid", "b.*")


_QUANTISED = """(SELECT fid, pos, x, y, dx, dy, flag, CASE WHEN flag = 2 THEN CAST(CAST(dx AS FLOAT) AS DOUBLE) ELSE round_even(dx, 0) END AS qx,
  CASE WHEN flag = 2 THEN CAST(CAST(dy AS FLOAT) AS DOUBLE) ELSE round_even(dy, 0) END AS qy FROM (
  SELECT *, CASE WHEN m < 1 THEN 2 WHEN m < 32767 THEN 0 WHEN m < 2147483647 THEN 1 ELSE 2 END AS flag FROM (
  SELECT *, coalesce(max(greatest(abs(dx), abs(dy))) OVER (PARTITION BY fid), 0) AS m FROM (
  SELECT *, x - lag(x) OVER (PARTITION BY fid ORDER BY pos) AS dx, y - lag(y) OVER (PARTITION BY fid ORDER BY pos) AS dy FROM v))))"""


@register("delta_quantised", f"SELECT fid, pos, dx, dy, CAST(flag AS INT) AS flag, qx, qy FROM {_QUANTISED} WHERE dx IS NOT NULL")
def delta_quantised(spark, sf):
    return codec.quantised_vertices(derived.vertices(spark, sf)).where("dx IS NOT NULL").select("fid", "pos", "dx", "dy", "flag", "qx", "qy")


@register(
    "delta_roundtrip_error",
    f"""SELECT geom_type, count(*) AS points, max(greatest(abs(x - rx), abs(y - ry))) < 1e-6 AS within FROM (
  SELECT fid, x, y, first_value(x) OVER w + coalesce(sum(qx) OVER w, 0) AS rx, first_value(y) OVER w + coalesce(sum(qy) OVER w, 0) AS ry
  FROM {_QUANTISED} WINDOW w AS (PARTITION BY fid ORDER BY pos ROWS UNBOUNDED PRECEDING)) JOIN f USING (fid) GROUP BY geom_type""",
)
def delta_roundtrip_error(spark, sf):
    """Bytes and back: how far points move."""
    layer = derived.layer(spark, sf)
    back = layer.select("geom_type", "coords", codec.decode(codec.encode(F.col("coords"))).alias("again"))
    moved = F.zip_with("coords", "again", lambda a, b: F.greatest(F.abs(a.x - b.x), F.abs(a.y - b.y)))
    per = back.select("geom_type", F.size("again").alias("n"), F.array_max(moved).alias("e"))
    return per.groupBy("geom_type").agg(F.sum("n").cast("long").alias("points"), (F.max("e") < 1e-6).alias("within"))


_ENCODED = "(SELECT fid, CASE WHEN n = 1 THEN 16 ELSE 17 + 8 * (n - 1) END AS bytes, 16 * n AS raw, n FROM (SELECT fid, count(*) AS n FROM v GROUP BY fid))"


@register("compression_ratio", f"SELECT CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum(bytes) AS BIGINT) AS encoded_bytes, (1 - CAST(sum(bytes) AS DOUBLE) / CAST(sum(raw) AS DOUBLE)) * 100 AS ratio FROM {_ENCODED}")
def compression_ratio(spark, sf):
    return codec.ratio(derived.layer(spark, sf))


@register("codec_modes")
def codec_modes(spark, sf):
    """Encoded bytes per mode and the largest move of a point."""
    layer = derived.layer(spark, sf)
    rows = None
    for mode in codec.MODES:
        one = layer.select(F.lit(mode).alias("mode"), "coords", codec.encode(F.col("coords"), mode).alias("b")).withColumn("again", codec.decode(F.col("b"), mode))
        moved = F.array_max(F.zip_with("coords", "again", lambda a, b: F.greatest(F.abs(a.x - b.x), F.abs(a.y - b.y))))
        one = one.groupBy("mode").agg(F.sum(F.octet_length("b")).alias("bytes"), F.max(moved).alias("largest_move"))
        rows = one if rows is None else rows.unionAll(one)
    return rows


@register("geojson_lines")
def geojson_lines(spark, sf):
    return export.geojson(derived.layer(spark, sf))


# ---- dictionary ---------------------------------------------------------------------------------------------------

_POOL = """(SELECT CAST(row_number() OVER (ORDER BY fid, pos, kv) - 1 AS INT) AS string_id, s AS value FROM (
  SELECT s, fid, pos, kv, row_number() OVER (PARTITION BY s ORDER BY fid, pos, kv) AS k FROM (
  SELECT fid, pos, 0 AS kv, key AS s FROM a UNION ALL SELECT fid, pos, 1, value FROM a)) WHERE k = 1)"""


@register("pool_dictionary", f"SELECT string_id, value FROM {_POOL}")
def pool_dictionary(spark, sf):
    return dictionary.build_pool(derived.attributes(spark, sf))


@register("pool_encode", f"SELECT fid, pos, k.string_id AS key_id, w.string_id AS value_id FROM a JOIN {_POOL} k ON a.key = k.value JOIN {_POOL} w ON a.value = w.value")
def pool_encode(spark, sf):
    a = derived.attributes(spark, sf)
    return dictionary.encode(a, cut(dictionary.build_pool(a), "pool"))


@register("pool_decode", "SELECT fid, pos, key, value FROM a")
def pool_decode(spark, sf):
    a = derived.attributes(spark, sf)
    pool = cut(dictionary.build_pool(a), "pool")
    return dictionary.decode(dictionary.encode(a, pool), pool)


@register("pool_maps", "SELECT fid, count(*) AS fields, max(CASE WHEN key = 'status' THEN value END) AS status, max(CASE WHEN key = 'cents' THEN value END) AS cents FROM a GROUP BY fid")
def pool_maps(spark, sf):
    a = derived.attributes(spark, sf)
    pool = cut(dictionary.build_pool(a), "pool")
    maps = dictionary.to_maps(dictionary.decode(dictionary.encode(a, pool), pool))
    return maps.select("fid", F.size("properties").cast("long").alias("fields"), F.try_element_at("properties", F.lit("status")).alias("status"), F.try_element_at("properties", F.lit("cents")).alias("cents"))


@register("pool_lookup", f"SELECT id AS string_id, coalesce(value, '') AS value FROM (SELECT unnest([0, 1, 5, 999999999]) AS id) LEFT JOIN {_POOL} ON id = string_id")
def pool_lookup(spark, sf):
    ids = spark.createDataFrame([(0,), (1,), (5,), (999999999,)], "string_id int")
    return dictionary.lookup(ids, dictionary.build_pool(derived.attributes(spark, sf))).select("string_id", "value")


@register("pool_stats", f"SELECT count(*) AS strings, CAST(sum(strlen(value)) AS BIGINT) AS bytes, CAST(sum(strlen(value)) + 4 * count(*) AS BIGINT) AS stored_bytes FROM {_POOL}")
def pool_stats(spark, sf):
    return dictionary.pool_stats(dictionary.build_pool(derived.attributes(spark, sf)))


def _compression(unit: str) -> str:
    size = "length" if unit == "chars" else "strlen"
    return f"""SELECT original_size, compressed_size, (1 - CAST(compressed_size AS DOUBLE) / CAST(original_size AS DOUBLE)) * 100 AS ratio FROM (
  SELECT CAST(sum(12 + t) AS BIGINT) AS original_size, CAST(sum(12 + 8 * n) AS BIGINT) AS compressed_size FROM (
  SELECT fid, sum({size}(key) + {size}(value) + 2) AS t, count(*) AS n FROM a GROUP BY fid))"""


for _unit in ("chars", "bytes"):

    @register(f"compression_stats_{_unit}", _compression(_unit))
    def _stats(spark, sf, unit=_unit):
        return dictionary.compression_stats(derived.attributes(spark, sf), unit)


@register("pool_sharing", 'SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS "unique", (1 - CAST(count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) * 100 AS saved FROM (SELECT s, count(*) AS n FROM (SELECT key AS s FROM a UNION ALL SELECT value FROM a) GROUP BY s)')
def pool_sharing(spark, sf):
    return dictionary.sharing(derived.attributes(spark, sf))


@register("attribute_defaults", "SELECT f.fid, coalesce(value, 'none') AS cents FROM f LEFT JOIN (SELECT * FROM a WHERE key = 'cents') c ON f.fid = c.fid")
def attribute_defaults(spark, sf):
    return derived.layer(spark, sf).select("fid", geometry.get_property(F.col("properties"), "cents", "none").alias("cents"))


@register("typed_properties", "SELECT f.fid, CAST(value AS BIGINT) AS cents FROM f LEFT JOIN (SELECT * FROM a WHERE key = 'cents') c ON f.fid = c.fid")
def typed_properties(spark, sf):
    return geometry.pivot_properties(derived.layer(spark, sf).select("fid", "properties"), {"cents": "long"}).select("fid", "cents")


@register("attribute_text_size", "SELECT f.fid, CAST(CASE WHEN n IS NULL THEN 14 ELSE 14 + t + n - 1 END AS INT) AS size FROM f LEFT JOIN (SELECT fid, count(*) AS n, sum(strlen(key) + strlen(value) + 5) AS t FROM a GROUP BY fid) USING (fid)")
def attribute_text_size(spark, sf):
    return derived.layer(spark, sf).select("fid", offsets.attribute_text_size(F.col("properties")).alias("size"))


@register("stringified_attributes", "SELECT o_orderkey AS fid, k AS key, v AS value FROM (SELECT o_orderkey, unnest(['status', 'custkey', 'when']) AS k, unnest([o_orderstatus, CAST(o_custkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')]) AS v FROM orders)")
def stringified_attributes(spark, sf):
    """Typed fields as a map of strings."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    whole = geometry.stringify({"status": F.col("o_orderstatus"), "custkey": F.col("o_custkey"), "when": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})
    return o.select(F.col("o_orderkey").alias("fid"), F.explode(whole).alias("key", "value"))


@register("attributes_json", "SELECT fid, key, value FROM a")
def attributes_json(spark, sf):
    """Properties to JSON text and back."""
    back = export.attributes_from_json(export.attributes_json(derived.layer(spark, sf)))
    return back.select("fid", F.explode("properties").alias("key", "value"))


# ---- offsets ------------------------------------------------------------------------------------------------------


def _records(spark, sf) -> tuple[DataFrame, DataFrame]:
    layer = derived.layer(spark, sf)
    n = F.size("coords")
    geom = layer.select("fid", (F.lit(offsets.GEOM_HEADER) + F.when(n == 1, 16).otherwise(17 + 8 * (n - 1))).cast("long").alias("n_bytes"))
    attr = layer.select("fid", (offsets.ATTR_HEADER + offsets.PAIR * F.size("properties")).cast("long").alias("n_bytes"))
    return geom, attr


_GEOM_BYTES, _ATTR_BYTES = f"(SELECT fid, 52 + bytes AS n FROM {_ENCODED})", "(SELECT f.fid, 12 + 8 * count(key) AS n FROM f LEFT JOIN a ON f.fid = a.fid GROUP BY f.fid)"
_OFFSETS = f"""(SELECT g.fid, CAST(sum(g.n) OVER (ORDER BY g.fid ROWS UNBOUNDED PRECEDING) - g.n AS BIGINT) AS geom_offset,
  CAST(sum(t.n) OVER (ORDER BY g.fid ROWS UNBOUNDED PRECEDING) - t.n AS BIGINT) AS attr_offset FROM {_GEOM_BYTES} g JOIN {_ATTR_BYTES} t ON g.fid = t.fid)"""


def _offset_index(spark, sf) -> DataFrame:
    layer, n = derived.layer(spark, sf), F.size("coords")
    geom = (F.lit(offsets.GEOM_HEADER) + F.when(n == 1, 16).otherwise(17 + 8 * (n - 1))).cast("long")
    attr = (offsets.ATTR_HEADER + offsets.PAIR * F.size("properties")).cast("long")
    both = layer.select("fid", geom.alias("g"), attr.alias("a"))
    return offsets.running_sums(both, {"geom_offset": "g", "attr_offset": "a"}).select("fid", "geom_offset", "attr_offset")


@register("offset_index", f"SELECT fid, geom_offset, attr_offset FROM {_OFFSETS}")
def offset_index(spark, sf):
    return _offset_index(spark, sf)


@register("json_index_parse", f"SELECT fid, geom_offset, attr_offset FROM {_OFFSETS}")
def json_index_parse(spark, sf):
    """The offset index to JSON documents, a group of features each, and back."""
    return offsets.from_json(offsets.to_json(_offset_index(spark, sf).withColumn("g", F.col("fid") % 16), "g"))


@register("offset_last_wins", 'SELECT fid, max("offset") AS "offset", CAST(arg_max(l_linenumber, "offset") AS INT) AS l_linenumber FROM (SELECT l_orderkey AS fid, l_linenumber, l_partkey * 100000 + l_suppkey AS "offset" FROM lineitem) GROUP BY fid HAVING count(*) = count(DISTINCT "offset")')
def offset_last_wins(spark, sf):
    """Records appended under one id: the last counts. Orders whose records have equal offsets are left out."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("fid"), "l_linenumber", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("offset"))
    clear = rows.groupBy("fid").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("d")).where("n = d").select("fid")
    return offsets.last_wins(rows.join(clear, "fid", "left_semi")).select("fid", "offset", "l_linenumber")


@register("feature_store", f"SELECT fid, geom_type, min_x, max_y FROM f WHERE fid IN ({_SOME_SQL})")
def feature_store(spark, sf):
    """A layer written as a store, opened again and asked for some features."""
    kept = store.FeatureStore.write(derived.layer(spark, sf), scratch(spark, "store"))
    return store.FeatureStore.open(spark, kept.path).get_many(_SOME).select("fid", "geom_type", "min_x", "max_y")


@register("saved_index", _EXACT)
def saved_index(spark, sf):
    """Both indexes saved, loaded and asked."""
    f = derived.features(spark, sf)
    cells = GeohashIndex(5).build_or_load(f, scratch(spark, "cells"))
    bounds = BoundsIndex().build_or_load(f, scratch(spark, "bounds"))
    return query.bbox_query(f, cells, MEDIUM, bounds)


@register("dat_geometry_scan", "SELECT fid, geom_type, CAST(n AS INT) AS points, min_x, max_y FROM f JOIN (SELECT fid, count(*) AS n FROM v GROUP BY fid) USING (fid) WHERE fid >= 100")
def dat_geometry_scan(spark, sf):
    """Geometry record files written by all tasks and scanned again, with a filter that headers decide."""
    dat.register(spark)
    path = scratch(spark, "geom").removeprefix("file:")
    geom, _, _ = dat.encoded_layer(derived.layer(spark, sf))
    geom.select("fid", "geom_type", "bbox", "coords_bin", "offset").write.format("dat").option("kind", "geom").mode("append").save(path)
    found = dat.read(spark, "geom", path).where("fid >= 100")
    return found.select("fid", "geom_type", F.size(codec.decode(F.col("coords_bin"))).alias("points"), F.col("bbox.min_x").alias("min_x"), F.col("bbox.max_y").alias("max_y"))


@register("dat_attribute_scan", "SELECT fid, pos, key, value FROM a")
def dat_attribute_scan(spark, sf):
    """Attribute and pool files written and scanned again, decoded through the pool."""
    dat.register(spark)
    path = scratch(spark, "attr").removeprefix("file:")
    _, attr, pool = dat.encoded_layer(derived.layer(spark, sf))
    attr.select("fid", "pairs", "offset").write.format("dat").option("kind", "attr").mode("append").save(path)
    pool.coalesce(1).write.format("dat").option("kind", "pool").mode("append").save(path)
    rows = dat.read(spark, "attr", path).select("fid", F.posexplode("pairs").alias("pos", "p")).select("fid", "pos", "p.key_id", "p.value_id")
    back = dictionary.decode(rows, dat.read(spark, "pool", path))
    place = F.when(F.col("key") == "status", 0).when(F.col("key") == "priority", 1).when(F.col("key") == "cents", 2).otherwise(3)
    return back.select("fid", place.alias("pos"), "key", "value")


# ---- profiles -----------------------------------------------------------------------------------------------------


def _sized(spark, sf) -> DataFrame:
    n = F.size("coords")
    size = (F.lit(offsets.GEOM_HEADER) + F.when(n == 1, 16).otherwise(17 + 8 * (n - 1))).cast("long")
    return derived.layer(spark, sf).select("fid", "geom_type", n.alias("coords_n"), size.alias("geom_bytes"), F.size("properties").alias("n_properties"))


@register(
    "geom_type_distribution",
    f"SELECT geom_type, n, bytes, n * CAST(100 AS DOUBLE) / sum(n) OVER () AS percent, CASE geom_type WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINE' WHEN 2 THEN 'POLYGON' WHEN 3 THEN 'MULTIPOINT' WHEN 4 THEN 'MULTILINE' ELSE 'MULTIPOLYGON' END AS name "
    f"FROM (SELECT geom_type, count(*) AS n, CAST(sum(g.n) AS BIGINT) AS bytes FROM f JOIN {_GEOM_BYTES} g USING (fid) GROUP BY geom_type)",
)
def geom_type_distribution(spark, sf):
    return profile.geom_type_distribution(_sized(spark, sf), "geom_bytes")


@register("field_distribution", "SELECT key, count(*) AS n, CAST(sum(strlen(value)) AS BIGINT) AS bytes, count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM f) AS percent FROM a GROUP BY key")
def field_distribution(spark, sf):
    return profile.field_distribution(derived.attributes(spark, sf), derived.features(spark, sf))


@register(
    "layer_totals",
    f"""SELECT features, coords, geom_bytes, fields, attr_bytes, CAST(coords AS DOUBLE) / features AS coords_per_feature, CAST(geom_bytes AS DOUBLE) / features AS geom_bytes_per_feature,
  CAST(fields AS DOUBLE) / features AS fields_per_feature, CAST(attr_bytes AS DOUBLE) / features AS attr_bytes_per_feature FROM
  (SELECT count(*) AS features, CAST(sum(n) AS BIGINT) AS coords, CAST(sum(52 + bytes) AS BIGINT) AS geom_bytes FROM {_ENCODED}), (SELECT count(*) AS fields, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS attr_bytes FROM a)""",
)
def layer_totals(spark, sf):
    return profile.layer_totals(_sized(spark, sf), derived.attributes(spark, sf))


@register(
    "integrity_ratio",
    "SELECT count(*) AS geometries, count(*) AS valid_geometries, count(*) AS records, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid_records, CAST(100 AS DOUBLE) AS geometry_percent, "
    "sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*) AS attribute_percent FROM (SELECT f.fid, count(key) AS n FROM f LEFT JOIN a ON f.fid = a.fid GROUP BY f.fid)",
)
def integrity_ratio(spark, sf):
    rows = _sized(spark, sf)
    return profile.integrity(rows, rows)


@register(
    "consistency_check",
    """SELECT count(*) AS fids, CAST(sum(CASE WHEN NOT g AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS missing_both, CAST(sum(CASE WHEN NOT g AND t THEN 1 ELSE 0 END) AS BIGINT) AS missing_geometry,
  CAST(sum(CASE WHEN g AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS missing_attributes,
  greatest(sum(CASE WHEN NOT g AND NOT t THEN 1 ELSE 0 END), sum(CASE WHEN NOT g AND t THEN 1 ELSE 0 END), sum(CASE WHEN g AND NOT t THEN 1 ELSE 0 END)) <= count(*) * 0.05 AS consistent
  FROM (SELECT fid, fid % 40 <> 0 AS g, fid % 100 <> 0 AS t FROM f)""",
)
def consistency_check(spark, sf):
    """Geometry and attribute tables that each lack some features."""
    f = derived.features(spark, sf).select("fid")
    return profile.consistency(f, f.where("fid % 40 <> 0"), f.where("fid % 100 <> 0"))


@register(
    "memory_estimate",
    f"""SELECT *, CASE WHEN target_total_gb < 1 THEN 'low' WHEN target_total_gb < 4 THEN 'medium' WHEN target_total_gb < 8 THEN 'high' ELSE 'very high' END AS pressure FROM (
  SELECT *, (target_geometry_mb + target_attribute_mb + target_index_mb) / CAST(1024 AS DOUBLE) AS target_total_gb FROM (
  SELECT elements, geometry_bytes, attribute_bytes, elements * 16 AS offset_index_bytes, elements * 32 AS estimated_bytes, geometry_bytes * (CAST(10000000 AS DOUBLE) / elements) / CAST(1048576 AS DOUBLE) AS target_geometry_mb,
  attribute_bytes * (CAST(10000000 AS DOUBLE) / elements) / CAST(1048576 AS DOUBLE) AS target_attribute_mb, CAST(320000000 AS DOUBLE) / CAST(1048576 AS DOUBLE) AS target_index_mb FROM
  (SELECT count(*) AS elements, CAST(sum(n) AS BIGINT) AS geometry_bytes FROM {_GEOM_BYTES}), (SELECT CAST(sum(n) AS BIGINT) AS attribute_bytes FROM {_ATTR_BYTES})))""",
)
def memory_estimate(spark, sf):
    return profile.memory_estimate(*_records(spark, sf))


@register(
    "conversion_stats",
    f"""SELECT total, valid, geometry_size, pool_size, original_size, attribute_size, original_size - attribute_size AS saved_bytes, (1 - CAST(attribute_size AS DOUBLE) / CAST(original_size AS DOUBLE)) * 100 AS ratio FROM
  (SELECT count(*) AS total, count(*) AS valid, CAST(sum(52 + bytes) AS BIGINT) AS geometry_size FROM {_ENCODED}), (SELECT count(*) AS pool_size FROM {_POOL}),
  (SELECT original_size, compressed_size AS attribute_size FROM ({_compression("bytes")}))""",
)
def conversion_stats(spark, sf):
    a = derived.attributes(spark, sf)
    return profile.conversion_stats(_sized(spark, sf), dictionary.build_pool(a), a)


# ---- statistics ---------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded(name: str, sql: str):
    def add(fn: Query) -> Query:
        return register(name, sql)(lambda spark, sf: _rounded(fn(derived.results(spark, sf))))

    return add


_POS = "(SELECT * FROM r WHERE time_ms > 0)"
_PIVOT = "(SELECT data_size, avg(CASE WHEN index_type = 's2' THEN time_ms END) AS s2, avg(CASE WHEN index_type = 'ogr' THEN time_ms END) AS ogr FROM r GROUP BY data_size)"
_MOMENTS = """(SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS pooled FROM (SELECT data_size, count(*) FILTER (index_type = 's2') AS n1, count(*) FILTER (index_type = 'ogr') AS n2,
  avg(time_ms) FILTER (index_type = 's2') AS m1, avg(time_ms) FILTER (index_type = 'ogr') AS m2, var_samp(time_ms) FILTER (index_type = 's2') AS v1, var_samp(time_ms) FILTER (index_type = 'ogr') AS v2 FROM r GROUP BY data_size) WHERE n1 > 1 AND n2 > 1)"""

rounded(
    "bench_stats_sample",
    f"SELECT index_type, data_size, count(*) AS n, round(avg(time_ms), 6) AS mean, round(median(time_ms), 6) AS median, round(coalesce(stddev_samp(time_ms), 0), 6) AS std, round(min(time_ms), 6) AS least, round(max(time_ms), 6) AS largest FROM {_POS} GROUP BY index_type, data_size",
)(lambda r: stats.sample_stats(r, "index_type", "data_size"))
rounded(
    "bench_stats_pop",
    "SELECT index_type, data_size, round(avg(time_ms), 6) AS mean, round(min(time_ms), 6) AS least, round(max(time_ms), 6) AS largest, round(stddev_pop(time_ms), 6) AS std, CAST(sum(event_id) // count(*) AS BIGINT) AS mean_count FROM r GROUP BY index_type, data_size",
)(lambda r: stats.population_stats(r, "index_type", "data_size", counts="event_id"))
rounded(
    "bench_spread",
    "SELECT index_type, round(avg(time_ms), 6) AS mean, round(stddev_pop(time_ms), 6) AS std, round(median(time_ms), 6) AS median, round(min(time_ms), 6) AS least, round(max(time_ms), 6) AS largest FROM r GROUP BY index_type",
)(lambda r: stats.spread(r, "index_type"))
rounded("improvement", f"SELECT data_size, round((ogr - s2) / ogr * 100, 6) AS time_gain, round((s2 - ogr) / ogr * 100, 6) AS change FROM {_PIVOT} WHERE ogr > 0")(stats.improvement)
rounded("speedup", f"SELECT data_size, round(ogr / s2, 6) AS speedup FROM {_PIVOT} WHERE s2 > 0")(stats.speedups)
rounded("mean_speedup", f"SELECT round(avg(ogr / s2), 6) AS mean_speedup FROM {_PIVOT} WHERE ogr / s2 > 0")(stats.mean_speedup)
rounded(
    "regression",
    f"SELECT index_type, round(regr_slope(ln(time_ms), ln(data_size)), 6) AS slope, round(regr_intercept(ln(time_ms), ln(data_size)), 6) AS intercept, round(corr(ln(time_ms), ln(data_size)), 6) AS r, round(regr_r2(ln(time_ms), ln(data_size)), 6) AS r2 FROM {_POS} GROUP BY index_type",
)(lambda r: stats.regression(r, "index_type"))
rounded("cohens_d", f"SELECT data_size, round(d, 6) AS d, CASE WHEN d < 0.2 THEN 'negligible' WHEN d < 0.5 THEN 'small' WHEN d < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM (SELECT data_size, abs(m1 - m2) / pooled AS d FROM {_MOMENTS})")(lambda r: stats.cohens_d(r, "data_size"))
rounded("ttest_statistic", f"SELECT data_size, round((m1 - m2) / (pooled * sqrt(CAST(1 AS DOUBLE) / n1 + CAST(1 AS DOUBLE) / n2)), 6) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS freedom FROM {_MOMENTS}")(lambda r: stats.t_test(r, "data_size").select("data_size", "t", "freedom"))
rounded("nearest_size", "SELECT arg_min(data_size, abs(data_size - 10000) * 100000 + data_size) AS data_size FROM r")(stats.nearest_size)
rounded("throughput", "SELECT index_type, data_size, round(CASE WHEN sum(time_ms) > 0 THEN data_size * count(*) / (sum(time_ms) / 1000) ELSE 0 END, 6) AS per_second FROM r GROUP BY index_type, data_size")(
    lambda r: r.groupBy("index_type", "data_size").agg(F.count("*").alias("n"), F.sum("time_ms").alias("t")).select("index_type", "data_size", stats.rate(F.col("data_size") * F.col("n"), F.col("t") / 1000).alias("per_second"))
)
rounded("memory_per_feature", "SELECT data_size, round(avg(time_ms) * 1024 / data_size, 6) AS kb_per_feature FROM r GROUP BY data_size")(lambda r: stats.memory_per_feature(r.withColumnRenamed("time_ms", "memory_usage_mb")))
rounded("summary_report", "SELECT index_type, round(avg(time_ms), 6) AS mean, round(min(time_ms), 6) AS least, round(max(time_ms), 6) AS largest FROM r GROUP BY index_type")(lambda r: stats.summary(r, "time_ms"))
rounded("result_series", "SELECT event_id, data_size, round(time_ms, 6) AS time_ms FROM r WHERE index_type = 's2'")(lambda r: stats.series(r, index_type="s2").select("event_id", "data_size", "time_ms"))


@register("result_file", "SELECT index_type, data_size, round(avg(time_ms), 6) AS avg_time_ms, count(*) AS result_count FROM r WHERE index_type = 's2' GROUP BY index_type, data_size")
def result_file(spark, sf):
    """Results written as a document, read again and filtered by operation and index type."""
    r = derived.results(spark, sf)
    t = F.col("time_ms")
    rows = r.groupBy("index_type", "data_size").agg(F.avg(t).alias("avg_time_ms"), F.min(t).alias("min_time_ms"), F.max(t).alias("max_time_ms"), F.stddev_pop(t).alias("std_dev_ms"), F.count("*").alias("result_count"))
    rows = rows.select("index_type", F.lit("spatial_query").alias("operation"), "data_size", "avg_time_ms", "min_time_ms", "max_time_ms", "std_dev_ms", "result_count", F.lit(0.0).alias("memory_usage_mb"), F.lit(1).alias("iterations"))
    path = scratch(spark, "results")
    stats.write_results(rows, path)
    back = stats.series(stats.read_results(spark, path), "spatial_query", "s2")
    return back.select("index_type", "data_size", F.round("avg_time_ms", 6).alias("avg_time_ms"), "result_count")


@register("ttest")
def ttest(spark, sf):
    return stats.t_test(derived.results(spark, sf), "data_size")
