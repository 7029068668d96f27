"""Trip queries over points, zones and buildings: the twelve shapes of the public spatial set.

Trips are derived from ``events`` (places by arithmetic on the key), zones from
``nation`` and buildings from ``part`` as axis-parallel boxes, so most oracles
are closed-form SQL. Stored WKB columns go through ``geometry.from_wkb`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import geometry as G
from tidewell.operators import spatialjoin as J
from tidewell.sources.tables import table

_SQL_TRIPS = """trips AS (SELECT event_id AS tripkey, user_id AS custkey, ts AS pickup, event_id * 7 % 3600 AS seconds, value AS dist, event_id * 31 % 977 AS tip,
  (event_id * 37 % 3600) / 10.0::DOUBLE - 180 AS px, (event_id * 91 % 1700) / 10.0::DOUBLE - 85 AS py,
  (event_id * 37 % 3600) / 10.0::DOUBLE - 180 + (event_id % 11 - 5) * 2 AS dx, (event_id * 91 % 1700) / 10.0::DOUBLE - 85 + (event_id % 7 - 3) * 2 AS dy FROM events)"""
_SQL_ZONES = """zones AS (SELECT n_nationkey AS zonekey, n_name AS zone, n_nationkey % 5 * 70 - 175.05::DOUBLE AS x0, n_nationkey // 5 * 34 - 84.05::DOUBLE AS y0,
  n_nationkey % 5 * 70 - 175.05::DOUBLE + 60 AS x1, n_nationkey // 5 * 34 - 84.05::DOUBLE + 30 AS y1 FROM nation)"""
_SQL_BUILDINGS = """buildings AS (SELECT p_partkey AS bkey, p_name AS bname, (p_partkey * 53 % 3511) / 10.0::DOUBLE - 175.03 AS x0, (p_partkey * 29 % 1709) / 10.0::DOUBLE - 85.03 AS y0,
  (p_partkey * 53 % 3511) / 10.0::DOUBLE - 175.03 + 0.7 + p_partkey % 7 AS x1, (p_partkey * 29 % 1709) / 10.0::DOUBLE - 85.03 + 0.6 + p_partkey % 5 AS y1 FROM part)"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    px, py = (k * 37 % 3600) / 10.0 - 180, (k * 91 % 1700) / 10.0 - 85
    return e.select(
        k.alias("tripkey"), F.col("user_id").alias("custkey"), F.col("ts").alias("pickup"), (k * 7 % 3600).alias("seconds"), F.col("value").alias("dist"), (k * 31 % 977).alias("tip"),
        G.point(px, py).alias("p"), G.point(px + (k % 11 - 5) * 2, py + (k % 7 - 3) * 2).alias("d"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0 = k % 5 * 70 - 175.05, F.floor(k / 5) * 34 - 84.05
    x0, y0 = x0.cast("double"), y0.cast("double")
    return table(spark, sf_dir, "nation").select(k.alias("zonekey"), F.col("n_name").alias("zone"), G.box(x0, y0, x0 + 60, y0 + 30).alias("shape"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = (k * 53 % 3511) / 10.0 - 175.03, (k * 29 % 1709) / 10.0 - 85.03
    return table(spark, sf_dir, "part").select(k.alias("bkey"), F.col("p_name").alias("bname"), G.box(x0, y0, x0 + 0.7 + k % 7, y0 + 0.6 + k % 5).alias("shape"))


def spatial_q1(spark, sf_dir):
    """Nearest pickups around a place: bounding box first, exact distance then, top-k."""
    centre = G.wkt("POINT (10.5 20.25)")
    t = trips(spark, sf_dir).where((F.abs(F.col("p.x") - 10.5) <= 15) & (F.abs(F.col("p.y") - 20.25) <= 15))
    d = G.distance(F.col("p"), centre)
    return t.where(d <= 15).select("tripkey", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), "pickup", F.round(d, 9).alias("distance")).orderBy("distance", "tripkey").limit(100)


def spatial_q2(spark, sf_dir):
    """Count inside one named zone."""
    shape = zones(spark, sf_dir).where("zone = 'NATION_7'").limit(1)
    return J.point_join(trips(spark, sf_dir), "p", shape, "shape", strict=False, size=60.0).agg(F.count("*").alias("n"))


def spatial_q3(spark, sf_dir):
    """Monthly statistics inside a buffered box."""
    r = G.wkt("POLYGON((-30 -20, 20 -20, 20 25, -30 25, -30 -20))")
    t = trips(spark, sf_dir).where(F.col("p.x").between(-34, 24) & F.col("p.y").between(-24, 29)).where(G.polygon_distance(F.col("p"), r) <= 4)
    month = F.date_trunc("month", "pickup").cast("timestamp_ntz").alias("month")
    return t.groupBy(month).agg(F.count("tripkey").alias("n"), F.round(F.avg("dist"), 6).alias("avg_distance"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(F.avg("tip"), 6).alias("avg_tip")).orderBy("month")


def spatial_q4(spark, sf_dir):
    """Zones of the trips with the largest tips."""
    best = trips(spark, sf_dir).orderBy(F.desc("tip"), "tripkey").limit(1000)
    return J.point_join(best, "p", zones(spark, sf_dir), "shape", size=60.0).groupBy("zonekey", "zone").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zonekey")


def spatial_q5(spark, sf_dir):
    """Convex hull area of a customer's drop-offs per month."""
    month = F.date_trunc("month", "pickup").cast("timestamp_ntz").alias("month")
    t = trips(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name"), "custkey")
    g = t.groupBy("custkey", "c_name", month).agg(F.collect_list("d").alias("points"), F.count("*").alias("n")).where("n > 5")
    return g.select("custkey", "c_name", "month", F.round(G.hull_area(F.col("points")), 6).alias("hull_area"), "n").orderBy(F.desc("hull_area"), "custkey", "month").limit(100)


def spatial_q6(spark, sf_dir):
    """Zones that meet a box, with statistics of the pickups in them."""
    r = G.wkt("POLYGON((-60 -40, 70 -40, 70 40, -60 40, -60 -40))")
    z = zones(spark, sf_dir).where(G.polygons_intersect(F.col("shape"), r))
    return J.point_join(trips(spark, sf_dir), "p", z, "shape", size=60.0).groupBy("zonekey", "zone").agg(F.count("tripkey").alias("n"), F.round(F.avg("dist"), 6).alias("avg_distance"), F.round(F.avg("seconds"), 6).alias("avg_seconds")).orderBy(F.desc("n"), "zonekey")


def spatial_q7(spark, sf_dir):
    """Reported against straight-line distance."""
    line = G.line_length(F.col("p"), F.col("d")) / 0.000009
    t = trips(spark, sf_dir).select("tripkey", F.col("dist").alias("reported"), line.alias("line"))
    return t.select("tripkey", "reported", F.round("line", 3).alias("line"), F.round(F.col("reported") / F.nullif("line", F.lit(0.0)), 12).alias("ratio")).orderBy(F.desc_nulls_last("ratio"), F.desc("reported"), "tripkey").limit(100)


def spatial_q8(spark, sf_dir):
    """Pickups near each building: trips are counted by place first."""
    places = trips(spark, sf_dir).groupBy("p").agg(F.count("*").alias("trips"))
    return J.point_join(places, "p", buildings(spark, sf_dir), "shape", reach=0.45, deal=True).groupBy("bkey", "bname").agg(F.sum("trips").alias("n")).orderBy(F.desc("n"), "bkey").limit(100)


def spatial_q9(spark, sf_dir):
    """Overlapping buildings by intersection over union."""
    pairs = J.overlaps(buildings(spark, sf_dir), "bkey", "shape", 100)
    return pairs.select("a", "b", *(F.round(c, 6).alias(c) for c in ("area_a", "area_b", "overlap", "iou"))).orderBy(F.desc("iou"), "a", "b").limit(100)


def spatial_q10(spark, sf_dir):
    """Statistics of every zone, with those that no trip starts in."""
    z = zones(spark, sf_dir)
    inside = J.point_join(trips(spark, sf_dir), "p", z, "shape", size=60.0).groupBy("zonekey").agg(F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(F.avg("dist"), 6).alias("avg_distance"), F.count("tripkey").alias("n"))
    return z.select("zonekey", "zone").join(inside, "zonekey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).orderBy(F.desc_nulls_last("avg_seconds"), "zonekey").limit(100)


def spatial_q11(spark, sf_dir):
    """Trips between different zones."""
    z = zones(spark, sf_dir)
    t = J.point_join(trips(spark, sf_dir), "p", z.select(F.col("zonekey").alias("from_zone"), F.col("shape").alias("from_shape")), "from_shape", size=60.0).drop("from_shape")
    t = J.point_join(t, "d", z.select(F.col("zonekey").alias("to_zone"), F.col("shape").alias("to_shape")), "to_shape", size=60.0)
    return t.where("from_zone <> to_zone").agg(F.count("*").alias("n"))


def spatial_q12(spark, sf_dir):
    """Pickups farthest from their five nearest buildings: each place is looked up once.

    A key on m trips has each distance m times, of which the five least count.
    """
    t = trips(spark, sf_dir)
    keys, places = t.groupBy("tripkey", "p").agg(F.count("*").cast("int").alias("m")), t.select("p").distinct().withColumn("place", F.col("p"))
    near = J.nearest_polygons(places, "place", "p", buildings(spark, sf_dir).select("shape"), "shape", 5)
    lists = near.groupBy("place").agg(F.array_sort(F.collect_list("distance")).alias("gaps"))
    mean = lambda gaps: F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) / F.size(gaps)
    repeated = F.slice(F.flatten(F.transform("gaps", lambda g: F.array_repeat(g, F.least("m", F.lit(5))))), 1, 5)
    far = keys.join(lists.withColumn("mean", mean(F.col("gaps"))).hint("merge"), F.col("p") == F.col("place"))
    far = far.select("tripkey", F.round(F.when(F.col("m") == 1, F.col("mean")).otherwise(mean(repeated)), 9).alias("avg_distance"))
    return far.orderBy(F.desc("avg_distance"), "tripkey").limit(100)


_ALL = (spatial_q1, spatial_q2, spatial_q3, spatial_q4, spatial_q5, spatial_q6, spatial_q7, spatial_q8, spatial_q9, spatial_q10, spatial_q11, spatial_q12)
_IN = "px > x0 AND px < x1 AND py > y0 AND py < y1"
_GAP = "sqrt(pow(greatest(x0 - px, 0, px - x1), 2) + pow(greatest(y0 - py, 0, py - y1), 2))"


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    return {
        "spatial_q1": f"WITH {_SQL_TRIPS} SELECT tripkey, px AS lon, py AS lat, pickup, round(sqrt((px - 10.5) * (px - 10.5) + (py - 20.25) * (py - 20.25)), 9) AS distance FROM trips WHERE sqrt((px - 10.5) * (px - 10.5) + (py - 20.25) * (py - 20.25)) <= 15 ORDER BY distance, tripkey LIMIT 100",
        "spatial_q2": f"WITH {_SQL_TRIPS}, {_SQL_ZONES} SELECT count(*) AS n FROM trips, zones WHERE zone = 'NATION_7' AND px >= x0 AND px <= x1 AND py >= y0 AND py <= y1",
        "spatial_q3": f"WITH {_SQL_TRIPS} SELECT CAST(date_trunc('month', pickup) AS TIMESTAMP) AS month, count(*) AS n, round(avg(dist), 6) AS avg_distance, round(avg(seconds), 6) AS avg_seconds, round(avg(tip), 6) AS avg_tip FROM (SELECT *, -30 AS x0, 20 AS x1, -20 AS y0, 25 AS y1 FROM trips) WHERE {_GAP} <= 4 GROUP BY 1",
        "spatial_q4": f"WITH {_SQL_TRIPS}, {_SQL_ZONES} SELECT zonekey, zone, count(*) AS n FROM (SELECT * FROM trips ORDER BY tip DESC, tripkey LIMIT 1000), zones WHERE {_IN} GROUP BY zonekey, zone",
        "spatial_q6": f"WITH {_SQL_TRIPS}, {_SQL_ZONES} SELECT zonekey, zone, count(*) AS n, round(avg(dist), 6) AS avg_distance, round(avg(seconds), 6) AS avg_seconds FROM trips, zones WHERE x0 <= 70 AND x1 >= -60 AND y0 <= 40 AND y1 >= -40 AND {_IN} GROUP BY zonekey, zone",
        "spatial_q7": f"WITH {_SQL_TRIPS}, l AS (SELECT tripkey, dist AS reported, sqrt((px - dx) * (px - dx) + (py - dy) * (py - dy)) / 0.000009 AS line FROM trips) SELECT tripkey, reported, round(line, 3) AS line, round(reported / nullif(line, 0), 12) AS ratio FROM l ORDER BY ratio DESC NULLS LAST, reported DESC, tripkey LIMIT 100",
        "spatial_q8": f"WITH {_SQL_TRIPS}, {_SQL_BUILDINGS} SELECT bkey, bname, count(*) AS n FROM trips, buildings WHERE px >= x0 - 0.45 AND px <= x1 + 0.45 AND {_GAP} <= 0.45 GROUP BY bkey, bname ORDER BY n DESC, bkey LIMIT 100",
        "spatial_q9": f"""WITH {_SQL_BUILDINGS}, p AS (SELECT a.bkey AS a, b.bkey AS b, (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS overlap FROM buildings a, buildings b
  WHERE a.bkey < b.bkey AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
SELECT a, b, round(area_a, 6) AS area_a, round(area_b, 6) AS area_b, round(overlap, 6) AS overlap, round(overlap / (area_a + area_b - overlap), 6) AS iou FROM p ORDER BY iou DESC, a, b LIMIT 100""",
        "spatial_q10": f"WITH {_SQL_TRIPS}, {_SQL_ZONES} SELECT zonekey, zone, round(avg(seconds), 6) AS avg_seconds, round(avg(dist), 6) AS avg_distance, count(tripkey) AS n FROM zones LEFT JOIN trips ON {_IN} GROUP BY zonekey, zone",
        "spatial_q11": f"WITH {_SQL_TRIPS}, {_SQL_ZONES} SELECT count(*) AS n FROM trips, zones a, zones b WHERE px > a.x0 AND px < a.x1 AND py > a.y0 AND py < a.y1 AND dx > b.x0 AND dx < b.x1 AND dy > b.y0 AND dy < b.y1 AND a.zonekey <> b.zonekey",
        "spatial_q12": f"WITH {_SQL_TRIPS}, {_SQL_BUILDINGS}, d AS (SELECT tripkey, {_GAP} AS g FROM trips, buildings), r AS (SELECT *, row_number() OVER (PARTITION BY tripkey ORDER BY g) AS i FROM d) SELECT tripkey, round(avg(g), 9) AS avg_distance FROM r WHERE i <= 5 GROUP BY tripkey ORDER BY avg_distance DESC, tripkey LIMIT 100",
    }
