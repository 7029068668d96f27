"""Spatial joins as equi-joins on grid cells with an exact refinement.

A polygon (or the neighbourhood of a point) is listed in every cell that its
bounds meet, a point in its own cell; rows meet by cell equality, so no
nested loop is planned, and a predicate decides each candidate. A point has one cell, so
point joins give each pair once; polygon pairs are kept in one cell only.

The planner guesses the size of a table before its rows are listed in cells, so
joins with many polygons ask for a merge join: no list of cells is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import geometry as G


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def cells_of(bounds: Column, size: float, reach: float = 0.0) -> Column:
    """Array of (cx, cy): the cells that the bounds, widened by ``reach``, meet."""
    xs = F.sequence(_cell(bounds["x0"] - reach, size), _cell(bounds["x1"] + reach, size))
    ys = F.sequence(_cell(bounds["y0"] - reach, size), _cell(bounds["y1"] + reach, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def cell_size(polygons: DataFrame, shape: str, reach: float = 0.0) -> float:
    """Cells about as large as the mean polygon, so that one meets few cells and a cell few polygons."""
    b = G.bounds(F.col(shape))
    mean = polygons.agg(F.avg(F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]))).first()[0]
    return max(float(mean or 0) + 2 * reach, 1e-9)


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows over all cores if their input is too small to fill them by its own splits.

    The plan's own estimate decides, so large inputs keep their partitions and aren't shuffled.
    """
    session = rows.sparkSession
    cores = session.sparkContext.defaultParallelism
    split = session._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * split else rows


def point_join(points: DataFrame, at: str, polygons: DataFrame, shape: str, reach: float = 0.0, strict: bool = True, size: float | None = None, deal: bool = False) -> DataFrame:
    """Pairs of points and polygons: strictly within (``strict``), touching, or at most ``reach`` apart.

    ``deal`` deals both sides by cell (for many polygons, or many candidates a
    point). Bounds stand beside a polygon as plain columns, so that a candidate outside of
    them is dropped before the exact test; the ring is read for other shapes than boxes only.
    """
    size = size or cell_size(polygons, shape, reach)
    left = points.withColumn("cx", _cell(F.col(at)["x"], size)).withColumn("cy", _cell(F.col(at)["y"], size))
    right = polygons.withColumn("__b", G.bounds(F.col(shape))).withColumn("__r", F.when(~G.is_box(F.col(shape)), F.col(shape))).withColumn("__c", F.explode(cells_of(F.col("__b"), size, reach))).select("*", "__c.cx", "__c.cy").drop("__c")
    p, r, b = F.col(at), F.col("__r"), F.col("__b")
    near = p["x"].between(b["x0"] - reach, b["x1"] + reach) & p["y"].between(b["y0"] - reach, b["y1"] + reach)
    exact = G.polygon_distance(p, r) <= reach if reach else G.within(p, r) if strict else G.intersects(p, r)
    boxed = G.box_distance(p, b) <= reach if reach else G.in_box(p, b, strict)
    return left.join(right.hint("merge") if deal else right, ["cx", "cy"]).where(near & F.when(r.isNull(), boxed).otherwise(exact)).drop("cx", "cy", "__b", "__r")


def polygon_pairs(polygons: DataFrame, key: str, shape: str, size: float | None = None, boxes: bool = True) -> DataFrame:
    """Rows (a, b, shape_a, shape_b, frame_a, frame_b) of intersecting polygons with key a < b; without ``boxes``, no pairs of two boxes."""
    size = size or cell_size(polygons, shape)
    named = spread(polygons.select(F.col(key).alias("__k"), F.col(shape).alias("__s")))
    listed = named.select("*", G.bounds(F.col("__s")).alias("__b"), G.frame(F.col("__s")).alias("__f")).select("*", F.explode(cells_of(F.col("__b"), size)).alias("c"))
    x, y = (listed.select("c", *(F.col(f"__{n}").alias(f"{n}_{side}") for n in "ksbf")) for side in "ab")
    both = x.join(y.hint("merge"), "c").where("k_a < k_b and b_a.x0 <= b_b.x1 and b_b.x0 <= b_a.x1 and b_a.y0 <= b_b.y1 and b_b.y0 <= b_a.y1").where("true" if boxes else "f_a is null or f_b is null")
    # Of the cells that both meet, only the one with the low corner of the common bounds counts.
    once = both.where((F.col("c.cx") == _cell(F.greatest(F.col("b_a.x0"), F.col("b_b.x0")), size)) & (F.col("c.cy") == _cell(F.greatest(F.col("b_a.y0"), F.col("b_b.y0")), size)))
    meet = G.polygons_intersect(F.col("s_a"), F.col("s_b"), F.col("f_a"), F.col("f_b"))
    return once.where(meet).select(*(F.col(f"{n}_{side}").alias(name + side) for n, name in (("k", ""), ("s", "shape_"), ("f", "frame_")) for side in "ab"))


def overlaps(polygons: DataFrame, key: str, shape: str, best: int) -> DataFrame:
    """Rows (a, b, area_a, area_b, overlap, iou) of intersecting polygons with key a < b: at least all
    whose iou, rounded to six decimals, is the ``best``-th highest or more.

    Boxes whose low corners share a small cell come first; ``best`` pairs of them reach some iou t.
    For boxes, the iou is at most that of their sides, so where it is t or more, two sides differ at
    either end by at most (1 / t - 1) of the shorter, and only boxes with low corners as near as that
    need to meet. Pairs with another shape are all returned, and all pairs where t is below a half.
    """
    corners = ("x0", "y0", "x1", "y1")
    framed = polygons.where(G.bounds(F.col(shape))["x0"].isNotNull()).select(F.col(key).alias("k"), G.frame(F.col(shape)).alias("f")).persist()
    *most, x0, y0, x1, y1, n, others = framed.agg(F.max(F.expr("f.x1 - f.x0")), F.max(F.expr("f.y1 - f.y0")), F.min("f.x0"), F.min("f.y0"), F.max("f.x1"), F.max("f.y1"), F.count("f"), F.count_if(F.col("f").isNull())).first()
    boxes = framed.where("f is not null").select("k", *(F.col(f"f.{c}").alias(c) for c in corners))
    side = lambda i: boxes.select(*(F.col(c).alias(f"{c}_{i}") for c in boxes.columns))
    area = lambda f: (f["x1"] - f["x0"]) * (f["y1"] - f["y0"])
    fa, fb = ({c: F.col(f"{c}_{i}") for c in corners} for i in "ab")
    common = [F.least(fa[f"{c}1"], fb[f"{c}1"]) - F.greatest(fa[f"{c}0"], fb[f"{c}0"]) for c in "xy"]
    overlap = common[0] * common[1]
    iou = F.when(F.col("overlap") == 0, 0.0).otherwise(F.col("overlap") / (F.col("area_a") + F.col("area_b") - F.col("overlap")))

    def meet(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
        both = a.join(b.hint("merge"), ["cx", "cy"]).where("k_a < k_b and x0_a <= x1_b and x0_b <= x1_a and y0_a <= y1_b and y0_b <= y1_a").where(overlap >= least * (area(fa) + area(fb) - overlap))
        return both.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), area(fa).alias("area_a"), area(fb).alias("area_b"), overlap.alias("overlap")).withColumn("iou", iou)

    def cornered(i: str, w: float, h: float) -> DataFrame:
        return side(i).withColumn("cx", _cell(F.col(f"x0_{i}"), w)).withColumn("cy", _cell(F.col(f"y0_{i}"), h))

    reached = []
    if n:
        near = max(((x1 - x0) * (y1 - y0) * 4 / n) ** 0.5, max(x1 - x0, y1 - y0) / 2**20, 1e-9)  # about four boxes a cell
        reached = meet(cornered("a", near, near), cornered("b", near, near), 0.0).select(F.round("iou", 6).alias("iou")).orderBy(F.desc("iou")).limit(best).collect()
    least = reached[-1].iou - 1e-6 if len(reached) == best else 0.0
    found = None
    if least >= 0.5:
        far = 1 / least - 1
        reach = {"x": F.lit(far) * (fb["x1"] - fb["x0"]) + 1e-9, "y": F.lit(far) * (fb["y1"] - fb["y0"]) + 1e-9}
        w, h = (max(far * v, 1e-9) for v in most)
        cells = [F.sequence(_cell(fb[f"{c}0"] - reach[c], step), _cell(fb[f"{c}0"] + reach[c], step)) for c, step in (("x", w), ("y", h))]
        listed = side("b").withColumn("ys", cells[1]).withColumn("cx", F.explode(cells[0])).withColumn("cy", F.explode("ys")).drop("ys")
        found = meet(cornered("a", w, h), listed, least)
        if not others:
            return found
    rest = polygon_pairs(polygons, key, shape, boxes=found is None)
    measure = lambda i: F.coalesce(area(F.col(f"frame_{i}")), G.area(F.col(f"shape_{i}"))).alias(f"area_{i}")
    rest = rest.select("a", "b", measure("a"), measure("b"), G.intersection_area(F.col("shape_a"), F.col("shape_b"), F.col("frame_a"), F.col("frame_b")).alias("overlap")).withColumn("iou", iou)
    return found.unionByName(rest) if found is not None else rest


def covered(polygons: DataFrame, size: float, k: int) -> DataFrame:
    """Cells (cx, cy) in which every point has k or more of the boxes ``polygons.__b`` around it.

    A cell strictly between those of a box's two corners lies inside of the box.
    """
    low, high = ([_cell(F.col("__b")[c], size) for c in names] for names in (("x0", "y0"), ("x1", "y1")))
    inner = [F.sequence(a + 1, z - 1) for a, z in zip(low, high)]
    boxes = polygons.where((low[0] + 2 <= high[0]) & (low[1] + 2 <= high[1]))
    cells = boxes.select(inner[1].alias("ys"), F.explode(inner[0]).alias("cx")).select("cx", F.explode("ys").alias("cy"))
    return cells.groupBy("cx", "cy").count().where(F.col("count") >= k).select("cx", "cy")


def nearest_polygons(points: DataFrame, key: str, at: str, polygons: DataFrame, shape: str, k: int, size: float | None = None) -> DataFrame:
    """Rows (key, distance, rank) of each point's k nearest polygons; ``key`` is unique.

    Where boxes lie k deep on average, points in cells that k boxes cover wholly are
    done first, at distance 0. The others go in rounds with doubling cells: a point looks at its 3 x 3 cells, and is done
    when its k-th distance is at most one cell, as nothing nearer can lie
    outside of them. What is left goes on; the last round's cell spans everything.
    A polygon met in several of the cells counts in the lowest of them.
    """
    b = G.bounds(F.col(shape))
    low_high = lambda c: (F.min(c), F.max(c))
    px, py = F.col(at)["x"], F.col(at)["y"]
    p = points.agg(*low_high(px), *low_high(py)).first()
    boxed = polygons.select(F.when(~G.is_box(F.col(shape)), F.col(shape)).alias("__r"), b.alias("__b"))
    wide, high = F.expr("__b.x1 - __b.x0"), F.expr("__b.y1 - __b.y0")
    boxed = boxed.persist()
    *q, side, n, others, total = boxed.agg(F.min("__b.x0"), F.max("__b.x1"), F.min("__b.y0"), F.max("__b.y1"), F.avg(F.greatest(wide, high)), F.count("__b.x0"), F.count("__r"), F.sum(F.when(F.col("__r").isNull(), wide * high))).first()
    if None in (*p, *q):
        return points.select(key, F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    span = max(max(p[1], q[1]) - min(p[0], q[0]), max(p[3], q[3]) - min(p[2], q[2]))
    whole_area = (q[1] - q[0]) * (q[3] - q[2])
    left, done = points.select(key, at), []
    if not size and side and (total or 0) >= k * whole_area:
        cell = max(side / 4, span / 2**20)
        deep = covered(boxed.where("__r is null"), cell, k).withColumn("__deep", F.lit(True))
        left = left.withColumn("cx", _cell(px, cell)).withColumn("cy", _cell(py, cell)).join(deep.hint("merge"), ["cx", "cy"], "left").drop("cx", "cy").persist()
        done.append(left.where("__deep").select(key, F.lit(0.0).alias("distance"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")))
        left = left.where("__deep is null").drop("__deep")
    # Nine cells that hold about 2 k polygons at even density, and no polygon in very many cells.
    size = size or max(side / 2, (whole_area * 2 * k / (9 * n)) ** 0.5, span / 2**20, 1e-9)
    while True:
        last = size >= 2 * span
        cx, cy = _cell(px, size), _cell(py, size)
        asked = left.select(key, at, (cx - 1).alias("lx"), (cy - 1).alias("ly"), F.explode(neighbours(px, py, size)).alias("c"))
        first = [_cell(F.col("__b")[c], size).alias(f"f{c[0]}") for c in ("x0", "y0")]
        listed = boxed.select("__r", "__b", *first, F.explode(cells_of(F.col("__b"), size)).alias("c"))
        once = (F.col("c.cx") == F.greatest("lx", "fx")) & (F.col("c.cy") == F.greatest("ly", "fy"))
        gap = G.box_distance(F.col(at), F.col("__b"))
        if others:
            gap = F.when(F.col("__r").isNull(), gap).otherwise(G.polygon_distance(F.col(at), F.col("__r")))
        pairs = asked.join(listed.hint("merge"), "c").where(once).select(key, gap.alias("distance"))
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance"))).where(F.col("rank") <= k)
        whole = Window.partitionBy(key)
        found = ranked.select(key, "distance", "rank", F.max("distance").over(whole).alias("far"), F.count("*").over(whole).alias("n"))
        if last:
            done.append(found.select(key, "distance", "rank"))
            break
        found = found.persist()
        good = found.where((F.col("n") == k) & (F.col("far") <= size))
        done.append(good.select(key, "distance", "rank"))
        before, left = left, left.join(good.where("rank = 1").select(key).hint("merge"), key, "left_anti").persist()
        empty = left.isEmpty()
        before.unpersist()
        if empty:
            break
        size *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def neighbours(x: Column, y: Column, size: float) -> Column:
    """Array of (cx, cy): a point's cell and the eight around it."""
    cx, cy = _cell(x, size), _cell(y, size)
    return F.flatten(F.transform(F.sequence(cx - 1, cx + 1), lambda a: F.transform(F.sequence(cy - 1, cy + 1), lambda c: F.struct(a.alias("cx"), c.alias("cy")))))
