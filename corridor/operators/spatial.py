"""Spatial joins: lines with polygons, and lines with nearly equal lines."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.constants import BRIDGE_NAMES, BRIDGE_RINGS
from corridor.functions import geometry as G
from corridor.operators import line_blocks
from corridor.operators.frames import join_small, join_unique
from corridor.operators.graph import components
from corridor.scratch import checkpoint, is_small

FEW_POLYGONS = 64
#: Rows of a leaf beyond which it is cut, rows of a block of a leaf, representatives of a leaf at a time.
CROWD = 512
BLOCK = 4096
HEADS = 8
#: Tolerances in a side of the cells of both ends (a wider cell has fewer visitors) and of the cells that cut a crowded leaf.
END_CELL = 16.0
CUT_CELL = 4.0
#: Where on a line its vertices are looked at to cut a crowded leaf; and the sign for its box.
PROBES = [0.5, 0.25, 0.75, 0.0, 1.0]
CORNER = -1.0
#: Degrees by which a path's columns are widened against rounding, and the least size of a counted grid's cells.
MARGIN = line_blocks.MARGIN
LEAST_CELL = 1e-5
#: Comparisons that cost as much as a row of a cell; those that are worth another block while cores are idle, and the most of a block.
ROW_PAIRS = 50
TASK_PAIRS = 64_000_000
BLOCK_PAIRS = 512_000_000
#: Vertices of a line block, edges in a row, vertices for which a line counts once where lines are dealt, bits of a place in a side and of a lot.
BLOCK_VERTICES = 131_072
PACK = 64
WEIGHT = 64
PLACE_BITS = 20
LOT_BITS = 22


def polygons(features: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygon rows with ring ``edges`` and bounding ``box``, made once per polygon."""
    edges = F.flatten(F.transform(rings, lambda r: G.segments(r)))
    return features.withColumns({"edges": edges, "box": G.bounds(F.flatten(rings))}).drop(rings)


def bridge_polygons(spark: SparkSession) -> DataFrame:
    """The three bridge outlines."""
    rows = [(i, BRIDGE_NAMES[i], [ring]) for i, ring in BRIDGE_RINGS.items()]
    schema = "id int, bridge string, rings array<array<struct<lon:double,lat:double>>>"
    return polygons(spark.createDataFrame(rows, schema))


def _padded(box: Column, pad: float) -> Column:
    return F.struct(
        (box["x0"] - pad).alias("x0"), (box["y0"] - pad).alias("y0"),
        (box["x1"] + pad).alias("x1"), (box["y1"] + pad).alias("y1"),
    )


def _hit(coords: Column, line_box: Column, edges: Column, polygon_box: Column, pad: float | None) -> Column:
    """Bounding boxes first; with ``pad`` the padded box alone decides."""
    if pad is not None:
        return G.boxes_meet(line_box, _padded(polygon_box, pad))
    return G.boxes_meet(line_box, polygon_box) & G.line_meets_polygon(coords, edges)


def _cells(box: Column, cell: float) -> Column:
    """All grid cells a box touches."""
    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(box[low] / cell), F.floor(box[high] / cell))

    return F.flatten(
        F.transform(span("x0", "x1"), lambda x: F.transform(
            span("y0", "y1"), lambda y: F.struct(x.alias("cx"), y.alias("cy"))))
    )


def _bands(parts: DataFrame, cell: float) -> DataFrame:
    """Rows with ends ``a`` and ``b``, once for each grid row ``cy`` they pass, with the columns ``c0`` to ``c1`` they pass in it.

    A long part is followed along its path, so it has about as many cells as its
    length holds. The margin makes up for rounding.
    """
    box = G.segment_box({"a": F.col("a"), "b": F.col("b")})
    rows = parts.withColumn("_box", box).withColumn(
        "cy", F.explode(F.sequence(F.floor(F.col("_box.y0") / cell), F.floor(F.col("_box.y1") / cell)))
    )
    slope = F.try_divide(F.col("b.lon") - F.col("a.lon"), F.col("b.lat") - F.col("a.lat"))
    at = lambda lat: F.col("a.lon") + (lat - F.col("a.lat")) * slope
    low, high = at(F.greatest(F.col("_box.y0"), F.col("cy") * cell)), at(F.least(F.col("_box.y1"), (F.col("cy") + 1) * cell))
    x0 = F.greatest(F.col("_box.x0"), F.coalesce(F.least(low, high) - MARGIN, "_box.x0"))
    x1 = F.least(F.col("_box.x1"), F.coalesce(F.greatest(low, high) + MARGIN, "_box.x1"))
    return rows.withColumns({"c0": F.floor(F.least(x0, x1) / cell), "c1": F.floor(F.greatest(x0, x1) / cell)}).drop("_box")


def _spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str], most: int = BLOCK
) -> DataFrame:
    """Inner join in which no key has more than about ``most`` rows of each side in one place.

    The rows of a key counted to have more are dealt over parts by a hash of their
    number, on both sides; each part of one side meets each part of the other.
    """
    def crowded(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias(name)).where(F.col(name) > 1)

    cuts = checkpoint(crowded(left, "_ls").join(crowded(right, "_rs"), keys, "full"))
    if cuts.isEmpty():
        return left.join(right, keys)

    def dealt(df: DataFrame, own: str, other: str, numbers: list[str], part: str, every: str) -> DataFrame:
        placed = join_small(df, cuts, keys, "left")
        return placed.withColumn(part, F.pmod(F.xxhash64(*numbers), F.coalesce(own, F.lit(1)))).withColumn(
            every, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1))
        ).drop("_ls", "_rs")

    return dealt(left, "_ls", "_rs", left_id, "_i", "_j").join(dealt(right, "_rs", "_ls", right_id, "_j", "_i"), [*keys, "_i", "_j"])


def _mean_reach(parts: DataFrame) -> tuple[float, int]:
    """Sum of the longer box sides of ``a``-``b`` rows, and their number."""
    reach = F.greatest(F.abs(F.col("a.lon") - F.col("b.lon")), F.abs(F.col("a.lat") - F.col("b.lat")))
    row = parts.agg(F.sum(reach).alias("sum"), F.count(F.lit(1)).alias("n")).first()
    return row["sum"] or 0.0, row["n"]


def _inside(starts: DataFrame, edge_bands: DataFrame, cell: float) -> DataFrame:
    """``(_line, _block, _polygon)`` of the start points inside a polygon, by even-odd ray casting.

    Cells that no edge of a polygon passes are all inside or all outside. In a grid
    row they form runs between the cells with edges, so a large polygon has few
    runs, whatever its area. Points in a run marked inside are surely inside; points
    in a cell with edges are tested against the polygon's edges of that grid row.
    A run is found at the level of its own length: it lies in two blocks of it at most.
    """
    rows = checkpoint(edge_bands.groupBy("_polygon", "cy").agg(
        F.collect_list(F.struct("a", "b")).alias("edges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("c0", "c1"))))).alias("passed"),
    ))
    after = F.slice("passed", F.lit(2), F.size("passed"))
    gaps = F.filter(
        F.zip_with(F.slice("passed", F.lit(1), F.size("passed") - 1), after, lambda p, n: F.struct((p + 1).alias("f"), (n - 1).alias("t"))),
        lambda g: g["f"] <= g["t"],
    )
    middle = G.point((F.col("g.f") + 0.5) * cell, (F.col("cy") + 0.5) * cell)
    sure = rows.select("_polygon", "cy", "edges", F.explode(gaps).alias("g")).where(G.point_inside(middle, F.col("edges")))
    passed = rows.select("_polygon", "cy", F.explode("passed").alias("f"), F.lit(False).alias("sure")).withColumn("t", F.col("f"))
    runs = sure.select("_polygon", "cy", "g.f", "g.t", F.lit(True).alias("sure")).unionByName(passed)
    width = F.col("t") - F.col("f") + 1
    runs = runs.withColumn("level", F.ceil(F.log2(width)).cast("int"))
    runs = checkpoint(runs.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("f") / F.pow(F.lit(2.0), "level")), F.floor(F.col("t") / F.pow(F.lit(2.0), "level"))))))
    levels = [r["level"] for r in runs.select("level").distinct().collect()]  # at most the bits of a cell number
    if not levels:
        return starts.select("_line", "_block").withColumn("_polygon", F.lit(0).cast("bigint")).where("false")
    placed = starts.withColumns({"cx": F.floor(F.col("p.lon") / cell), "cy": F.floor(F.col("p.lat") / cell)})
    placed = placed.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    placed = placed.withColumn("block", F.floor(F.col("cx") / F.pow(F.lit(2.0), "level")))
    met = _spread_join(placed, runs, ["cy", "level", "block"], ["_line"], ["_polygon", "f"]).where("cx between f and t")
    met = checkpoint(met.select("_line", "_block", "p", "_polygon", "cy", "sure"))
    tested = join_unique(met.where("not sure"), rows.select("_polygon", "cy", "edges"), ["_polygon", "cy"])
    tested = tested.where(G.point_inside(F.col("p"), F.col("edges")))
    named = ["_line", "_block", "_polygon"]
    return met.where("sure").select(named).unionByName(tested.select(named))


def _finer(lines: DataFrame, edges: DataFrame, cell: float) -> tuple[float, float]:
    """(size of the cells, pairs to compare): cells so much smaller that more of them would cost more rows than they save pairs.

    The rows and pairs of cells of size ``cell`` are counted. With smaller cells lines have more rows, in
    proportion, and meet fewer edges in them; a row costs about ``ROW_PAIRS`` comparisons.
    """
    def counted(parts: DataFrame, name: str) -> DataFrame:
        cells = _bands(parts, cell).select("cy", F.explode(F.sequence("c0", "c1")).alias("cx"))
        return cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("double").alias(name))

    both = checkpoint(counted(lines, "_l").join(counted(edges, "_e"), ["cx", "cy"], "full").fillna(0.0, ["_l", "_e"]))
    found = both.agg(F.sum(F.col("_l") + F.col("_e")).alias("rows"), F.sum(F.col("_l") * F.col("_e")).alias("pairs")).first()
    rows, pairs = found["rows"] or 0.0, found["pairs"] or 0.0
    share = min(1.0, (ROW_PAIRS * rows / pairs) ** 0.5) if pairs else 1.0
    finer = max(cell * share, min(cell, LEAST_CELL))
    return finer, pairs * finer / cell


def _place(box: Column, low: Column, side: Column) -> Column:
    """Number of the middle of a box along a Z-shaped curve, so that near places mostly have near numbers."""
    def apart(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    def step(axis: str) -> Column:
        share = F.try_divide((box[f"{axis}0"] + box[f"{axis}1"]) / 2 - low[f"{axis}0"], side)
        return apart(F.coalesce(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (2**PLACE_BITS - 1)), F.lit(0)).cast("bigint"))

    return step("x").bitwiseOR(F.shiftleft(step("y"), 1))


def _dealt(boxed: DataFrame, coords: str, blocks: int) -> DataFrame:
    """``boxed`` with ``_block``: lines dealt over about equal blocks of vertices, those of one place side by side.

    Lines of one and the same place are told apart by a lot, so a crowded place becomes many blocks.
    """
    if blocks == 1:
        return boxed.withColumn("_block", F.lit(0))
    least, most = (F.struct(*[f(f"_box.{c}{n}").alias(f"{c}{n}") for c in "xy" for n in "01"]).alias(f.__name__) for f in (F.min, F.max))
    spread = boxed.agg(least, most).first()
    low, high = spread["min"], spread["max"]
    corner = {n: F.lit(low[n]).cast("double") for n in ("x0", "y0")}
    side = max((high[f"{c}1"] - low[f"{c}0"] for c in "xy" if low[f"{c}0"] is not None), default=0.0)
    lot = F.pmod(F.xxhash64("_line", F.lit("lot")), F.lit(2**LOT_BITS))
    key = F.shiftleft(_place(F.col("_box"), corner, F.lit(side)), LOT_BITS).bitwiseOR(lot)
    times = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.coalesce(F.size(coords), F.lit(0)) / WEIGHT).cast("int"))))
    shares = [n / blocks for n in range(1, blocks)]
    cuts = boxed.select(key.alias("key"), times).agg(F.percentile_approx("key", shares, max(10_000, 10 * blocks))).first()[0] or []
    return boxed.withColumn("_block", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < key)) if cuts else F.lit(0))


def _blocks(spark: SparkSession, vertices: int, pairs: float) -> int:
    """How many line blocks: each has bounded vertices and pairs, and there are enough for the cores if that is worth the copies of edges."""
    spread = min(2 * spark.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))
    return max(1, spread, math.ceil(vertices / BLOCK_VERTICES), math.ceil(pairs / BLOCK_PAIRS))


def _join_blocks(boxed: DataFrame, areas: DataFrame, coords: str, label: str, cell: float | None, most: int = line_blocks.MOST_CELLS) -> DataFrame:
    """Lines with the label of each polygon that meets them, null without: an edge of it touches a part of the line, or the line starts inside.

    A task has whole lines, so what it finds is neither shuffled nor stored, however much that is. Lines
    of one place form a block; the pieces of edges on wide cells that its parts pass are copied to it, and
    so are the polygons in which its lines start. In a task edges and parts meet on the cells
    along their paths. Their size follows from the counted extents, about three cells for the mean part,
    and from the pairs counted in such cells, however large single polygons are.
    """
    spark = boxed.sparkSession
    part = lambda c: F.posexplode(c).alias("_no", "_part")
    lines = boxed.select("_line", part(G.segments(F.col(coords)))).select("_line", "_part.*")
    edges = checkpoint(areas.select("_polygon", "_label", part("edges")).select("_polygon", "_label", F.col("_no").alias("_edge"), "_part.*"))
    (length, n), (more, m) = _mean_reach(lines), _mean_reach(edges)
    wide, pairs = max((length + more) / (3 * max(n + m, 1)), LEAST_CELL), 0.0
    if cell is None:
        cell, pairs = _finer(lines, edges, wide)
    tile, column = max(cell, wide), F.explode(F.sequence("c0", "c1")).alias("cx")
    blocks = _blocks(spark, n + boxed.count(), pairs)  # a line has a vertex more than parts
    dealt = _dealt(boxed, coords, blocks)
    parts = dealt.select("_block", F.explode(G.segments(F.col(coords))).alias("_part")).select("_block", "_part.*")
    passed = checkpoint(_bands(parts, tile).select("_block", "cy", column).distinct())
    ends = F.array(*[F.col(f"{end}.{c}") for end in "ab" for c in ("lon", "lat")])
    pieces = _bands(edges, tile).select("_polygon", "_label", "cy", column, F.floor(F.col("_edge") / PACK).alias("_piece"), ends.alias("_end"))
    pieces = checkpoint(pieces.groupBy("_polygon", "cx", "cy", "_piece").agg(F.any_value("_label").alias("_label"), F.flatten(F.collect_list("_end")).alias("_ends")))
    near = _spread_join(pieces, passed, ["cx", "cy"], ["_polygon", "_piece"], ["_block"])
    start = G.start_point(F.col(coords))
    starts = dealt.select("_line", "_block", start.alias("p")).where("p.lon is not null and p.lat is not null")
    inside = join_small(_inside(starts, _bands(edges, cell), cell), areas.select("_polygon", "_label"), ["_polygon"])
    row = F.struct(*[F.col(c) for c in boxed.columns if c not in ("_line", "_box")]).alias("_row")
    sent = dealt.select("_block", "_line", row).unionByName(inside, allowMissingColumns=True).unionByName(
        near.select("_block", "_polygon", "_label", "_ends"), allowMissingColumns=True
    )
    sent = sent.repartitionById(blocks, F.col("_block").cast("int")).sortWithinPartitions(F.asc_nulls_first("_polygon")).drop("_block")
    kind = T.StructType([T.StructField("_row", sent.schema["_row"].dataType), T.StructField("_found", T.ArrayType(sent.schema["_label"].dataType))])
    met = sent.mapInArrow(line_blocks.meet_blocks(coords, cell, most), kind)
    return met.select("_row.*", F.explode_outer("_found").alias(label))


def join_polygons(
    lines: DataFrame, shapes: DataFrame, key: str, label: str = "bridge", coords: str = "coords",
    pad: float | None = None, cell: float | None = None, few: int = FEW_POLYGONS,
) -> DataFrame:
    """Left join of lines with the polygons they meet: one row per line row and polygon that meet, null without.

    Up to ``few`` polygons (counted, not assumed) are sent to every task, so the
    lines are not shuffled. More of them meet blocks of lines on grid cells instead: the
    edges on the cells along their paths, their inner cells as runs marked inside
    (with ``pad`` on the cells of their boxes). ``cell`` is its size, by default taken from the counted extents. Both
    ways give the same rows, whatever the keys and labels: on the grid, line rows
    and polygons carry numbers of their own, so repeated and null keys keep their
    own polygons and polygons of one label count separately.
    """
    boxed = lines.drop(label).withColumn("_box", G.bounds(F.col(coords)))
    areas = shapes.select(F.col(label).alias("_label"), "edges", F.col("box").alias("_area"))
    hit = _hit(F.col(coords), F.col("_box"), F.col("edges"), F.col("_area"), pad)
    if is_small(areas, few):
        joined = boxed.join(F.broadcast(areas), hit, "left")
        return joined.withColumn(label, F.col("_label")).drop("_box", "_label", "edges", "_area")

    boxed = checkpoint(boxed.withColumn("_line", F.monotonically_increasing_id()))
    areas = checkpoint(areas.withColumn("_polygon", F.monotonically_increasing_id()))
    if pad is None:
        return _join_blocks(boxed, areas.select("_polygon", "_label", "edges"), coords, label, cell)
    size = cell or 0.05
    area_cells = areas.select("*", F.explode(_cells(_padded(F.col("_area"), pad), size)).alias("_cell")).select("*", "_cell.*")
    line_cells = boxed.select("_line", coords, "_box", F.explode(_cells(F.col("_box"), size)).alias("_cell")).select("*", "_cell.*")
    met = line_cells.drop("_cell").join(area_cells.drop("_cell"), ["cx", "cy"]).where(hit)
    hits = met.select("_line", "_polygon").distinct()
    named = checkpoint(join_small(hits, areas.select("_polygon", F.col("_label").alias(label)), ["_polygon"]).drop("_polygon"))
    return boxed.join(named, "_line", "left").drop("_line", "_box")


def _near_cells(lon: Column, lat: Column, cell: float, reach: float) -> Column:
    box = F.struct(
        (lon - reach).alias("x0"), (lat - reach).alias("y0"), (lon + reach).alias("x1"), (lat + reach).alias("y1")
    )
    return _cells(box, cell)


def _split(rows: DataFrame, own: Column, reached: Column, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(smaller leaves, leaves as they were): rows at home in the cell ``own`` and visiting all others they reach.

    A leaf is cut only if that at least halves its comparisons (rows at home times all
    rows); lines around a border of cells would else become visitors of every part.
    Visitors of cells in which no row is at home are of no use and dropped.
    """
    placed = rows.withColumns({"_own": own, "_cell": F.explode(reached)}).withColumns(
        {"_in": F.col("_home") & (F.col("_cell") == F.col("_own")), "_part": F.xxhash64("_leaf", "_cell")}
    )
    parts = placed.groupBy("_leaf", "_part").agg(F.count(F.lit(1)).alias("_k"), F.count_if("_in").alias("_at")).where("_at > 0")
    parts = checkpoint(parts)
    work = parts.groupBy("_leaf").agg(F.sum(F.col("_k") * F.col("_at")).alias("_work"))
    paying = checkpoint(work.join(sizes, "_leaf").where("2 * _work <= _n * _h").select("_leaf", F.lit(True).alias("_cut"), "_n"))
    marked = checkpoint(join_unique(rows, paying.drop("_n"), ["_leaf"], "left", paying.select("_leaf", "_n")))
    same = marked.where("_cut is null").drop("_cut")
    cut = marked.where("_cut").drop("_cut").withColumns({"_own": own, "_cell": F.explode(reached)}).select(
        F.xxhash64("_leaf", "_cell").alias("_leaf"), (F.col("_home") & (F.col("_cell") == F.col("_own"))).alias("_home"), "_id", "_line", "_box"
    )
    inhabited = parts.select(F.col("_part").alias("_leaf"), F.col("_k").alias("_n"))
    return checkpoint(join_unique(cut, inhabited.select("_leaf"), ["_leaf"], "inner", inhabited)), same


def _cut_by(tolerance: float) -> tuple[Column, Column]:
    """The cell in which a row is at home and those it reaches, by what column ``_by`` of its leaf names.

    That is the place of a vertex on the line, or ``CORNER``: then the corner of the bounding box, in cells of
    four times the leaf's longest extent ``_sx``, ``_sy``. Boxes that meet begin no further apart than the
    longest is; without any extent they begin alike. A side as long as the tolerance is not looked at.
    """
    point = F.col("_line")[F.floor(F.col("_by") * (F.size("_line") - 1)).cast("int")]
    cell = CUT_CELL * tolerance

    def side(axis: str) -> tuple[Column, Column]:
        low, most = F.col(f"_box.{axis}0"), F.col(f"_s{axis}")
        exact, wide, at = F.xxhash64(low), most >= tolerance, lambda v: F.floor(F.try_divide(v, 4.0 * most))
        own = F.when(wide, F.lit(0).cast("long")).when(most == 0, exact).otherwise(at(low))
        span = F.sequence(at(low - 1.001 * most), at(low + 1.001 * most))
        return own, F.when(wide, F.array(F.lit(0).cast("long"))).when(most == 0, F.array(exact)).otherwise(span)

    (x, xs), (y, ys) = side("x"), side("y")
    corners = F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    corner = F.col("_by") == CORNER
    own = F.when(corner, F.struct(x.alias("cx"), y.alias("cy"))).otherwise(
        F.struct(F.floor(point["lon"] / cell).alias("cx"), F.floor(point["lat"] / cell).alias("cy"))
    )
    return own, F.when(corner, corners).otherwise(_near_cells(point["lon"], point["lat"], cell, 1.001 * tolerance))


def _full(rows: DataFrame, crowd: int) -> DataFrame:
    """Leaves of more than ``crowd`` rows: their rows ``_n`` and those at home ``_h``. Stored."""
    sizes = rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_home").alias("_h"))
    return checkpoint(sizes.where((F.col("_h") > 0) & (F.col("_n") > crowd)))


def _crowded(rows: DataFrame, full: DataFrame, tolerance: float, boxes: bool) -> DataFrame:
    """The ``full`` leaves with the best cut ``_by``, null if none would help.

    The lines at home spread over some cells at each place that could be looked at; the
    place with the widest spread is taken, if it is two cells at least.
    """
    rows = join_unique(rows, full, ["_leaf"], "inner", full.select("_leaf", "_n"))
    home = lambda v: F.when(F.col("_home"), v)
    spread = lambda v: F.max(home(v)) - F.min(home(v))
    width, height = F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0")
    places = []
    for n, place in enumerate(PROBES):
        point = F.col("_line")[F.floor(F.lit(place) * (F.size("_line") - 1)).cast("int")]
        places.append((F.greatest(spread(point["lon"]), spread(point["lat"])) / (CUT_CELL * tolerance)).alias(f"_w{n}"))
    counts = rows.groupBy("_leaf", "_n", "_h").agg(
        F.max(width).alias("_sx"), F.max(height).alias("_sy"),
        spread(F.col("_box.x0")).alias("_rx"), spread(F.col("_box.y0")).alias("_ry"), *places,
    )
    corner = [
        F.when(F.col(f"_s{c}") < tolerance, F.when(F.col(f"_s{c}") > 0, F.col(f"_r{c}") / (4.0 * F.col(f"_s{c}"))).otherwise(F.col(f"_r{c}") / 1e-9))
        for c in "xy"
    ]
    options = [F.struct(F.col(f"_w{n}").alias("w"), F.lit(place).alias("by")) for n, place in enumerate(PROBES)]
    if boxes:
        options.append(F.struct(F.coalesce(F.greatest(*corner), F.lit(0.0)).alias("w"), F.lit(CORNER).alias("by")))
    best = F.array_max(F.array(*options))
    return counts.select("_leaf", "_n", "_h", "_sx", "_sy", F.when(best["w"] >= 2, best["by"]).alias("_by"))


def _leaves(lines: DataFrame, key: str, coords: str, tolerance: float, boxes: bool, crowd: int) -> tuple[DataFrame, bool]:
    """Rows ``(_leaf, _home, _id, _line, _box)``: every line at home in one leaf and a visitor of all others it can be near to.

    A leaf is first a vertex count and the cells of both ends. Leaves of more than
    ``crowd`` rows are counted and cut again where their lines spread most: at a vertex, or by the corners of the bounding boxes, if those must meet. Two near lines
    always share the home leaf of each. Stored. With it whether no leaf was crowded; the
    rows then have no ``_box``.
    """
    cell, reach, line = END_CELL * tolerance, 1.001 * tolerance, F.col(coords)
    rows = lines.where(F.size(line) > 0).select(
        F.size(line).cast("long").alias("_leaf"), F.lit(True).alias("_home"), F.col(key).alias("_id"), line.alias("_line")
    )
    for point in (G.start_point(F.col("_line")), G.end_point(F.col("_line"))):
        own = F.struct(F.floor(point["lon"] / cell).alias("cx"), F.floor(point["lat"] / cell).alias("cy"))
        rows = rows.withColumns({"_own": own, "_cell": F.explode(_near_cells(point["lon"], point["lat"], cell, reach))}).withColumns(
            {"_home": F.col("_home") & (F.col("_cell") == F.col("_own")), "_leaf": F.xxhash64("_leaf", "_cell")}
        ).drop("_own", "_cell")
    rows, done = checkpoint(rows), []
    full = _full(rows, crowd)
    if full.isEmpty():
        return rows, True
    rows = rows.withColumn("_box", G.bounds(F.col("_line")))
    while True:
        wide = checkpoint(_crowded(rows, full, tolerance, boxes).where("_by is not null"))
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows]), False  # parts of stored tables
        marked = checkpoint(join_unique(rows, wide.select("_leaf", "_sx", "_sy", "_by"), ["_leaf"], "left", wide.select("_leaf", "_n")))
        done.append(marked.where("_by is null").drop("_sx", "_sy", "_by"))
        rows, same = _split(marked.where("_by is not null"), *_cut_by(tolerance), wide.select("_leaf", "_n", "_h"))
        done.append(same.drop("_sx", "_sy", "_by"))
        full = _full(rows, crowd)


def _near(line: Column, box: Column, line2: Column, box2: Column, tolerance: float, boxes: bool) -> Column:
    near = G.almost_equal(line, line2, tolerance)
    return G.boxes_meet(box, box2) & near if boxes else near


def _compared(left: DataFrame, right: DataFrame, condition: Column, block: int = BLOCK, within: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` of rows of one leaf that meet the condition, compared in blocks.

    A leaf is cut into as many blocks on each side as it holds ``block`` rows, and each
    block meets each other one under a key of its own, so no key has more than about
    ``2 * block`` rows. The right columns end with ``2``. ``within`` if the left rows are
    among the right ones and meet other rows only: a leaf of one row is then left out.
    """
    sides = left.select("_leaf", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select("_leaf", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sizes = sides.groupBy("_leaf").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).where(F.col("_l") > 0).where(F.col("_r") > int(within))
    blocks = checkpoint(sizes.select("_leaf", *[F.ceil(F.col(f"_{n}") / block).cast("int").alias(f"_b{n}") for n in "lr"]))
    counts = blocks.select("_leaf", (F.greatest("_bl", "_br") * block).cast("long").alias("_n"))

    def dealt(df: DataFrame, mine: str, other: str, at: str, across: str) -> DataFrame:
        joined = join_unique(df, blocks, ["_leaf"], "inner", counts)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(across)
        return joined.select(*df.columns, F.pmod(F.xxhash64("_id"), F.col(mine)).cast("int").alias(at), every)

    mine = dealt(left, "_bl", "_br", "_i", "_j")
    theirs = dealt(right, "_br", "_bl", "_j", "_i")
    renamed = theirs.select("_leaf", "_i", "_j", *[F.col(c).alias(f"{c}2") for c in right.columns if c != "_leaf"])
    return mine.join(renamed, ["_leaf", "_i", "_j"]).where(condition).select(F.col("_id").alias("a"), F.col("_id2").alias("b"))


def _within_leaves(rows: DataFrame, tolerance: float, boxes: bool) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of near lines where no leaf is crowded: each leaf is compared as it is."""
    one = rows.where("_home").select("_leaf", F.col("_id").alias("a"), F.col("_line").alias("l"))
    two = rows.select("_leaf", F.col("_id").alias("b"), F.col("_line").alias("m"))
    begin = F.abs(G.start_point(F.col("l"))["lon"] - G.start_point(F.col("m"))["lon"]) <= 1.001 * tolerance
    pairs = one.join(two, "_leaf").where((F.col("a") < F.col("b")) & begin & G.almost_equal(F.col("l"), F.col("m"), tolerance))
    if boxes:
        pairs = pairs.where(G.boxes_meet(G.bounds(F.col("l")), G.bounds(F.col("m"))))
    return pairs.select("a", "b")


def near_pairs(
    lines: DataFrame, key: str, coords: str = "coords", decimal: int = 4, boxes: bool = True, crowd: int = CROWD
) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of lines equal vertex by vertex within a tolerance.

    ``lines`` must hold each geometry once. ``boxes`` keeps only pairs whose bounding
    boxes meet. The pairs are the result here; to merge groups use ``near_groups``.
    """
    tolerance = 0.5 * 10.0**-decimal
    rows, calm = _leaves(lines, key, coords, tolerance, boxes, crowd)
    if calm:
        return _within_leaves(rows, tolerance, boxes)
    near = _near(F.col("_line"), F.col("_box"), F.col("_line2"), F.col("_box2"), tolerance, boxes)
    return _compared(rows.where("_home").drop("_home"), rows.drop("_home"), (F.col("_id") < F.col("_id2")) & near, within=True)


def near_groups(lines: DataFrame, key: str, coords: str = "coords", decimal: int = 4, crowd: int = CROWD) -> DataFrame:
    """``(key, component)`` of the lines that near-equal pairs connect; a line alone has no row.

    Leaves that stay crowded however they are cut are not listed pair by pair. In each
    of them a few lines at a time become representatives: all lines of the leaf are
    compared with them, and the lines near to one are covered and need no more. When
    representatives cover little beyond themselves, the lines that are left are compared
    with all others. A pair that could still connect two groups has a line outside the
    largest group of its leaf, so only those are compared at last.
    """
    tolerance = 0.5 * 10.0**-decimal
    near = _near(F.col("_line"), F.col("_box"), F.col("_line2"), F.col("_box2"), tolerance, True)
    rows, calm = _leaves(lines, key, coords, tolerance, True, crowd)
    if calm:
        return components(_within_leaves(rows, tolerance, True)).withColumnRenamed("node", key)
    counts = rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_home").alias("_h"))
    crowded = checkpoint(counts.where((F.col("_h") > 0) & (F.col("_n") > crowd)).drop("_h"))
    if crowded.isEmpty():
        links = _compared(rows.where("_home").drop("_home"), rows.drop("_home"), (F.col("_id") < F.col("_id2")) & near, within=True)
        return components(links).withColumnRenamed("node", key)
    marked = checkpoint(join_unique(rows, crowded.select("_leaf", F.lit(True).alias("_full")), ["_leaf"], "left", crowded))
    few, full = marked.where("_full is null").drop("_full"), marked.where("_full").drop("_full")
    links = [_compared(few.where("_home").drop("_home"), few.drop("_home"), (F.col("_id") < F.col("_id2")) & near, within=True)]
    covered, resolved = _cover(full, crowded, tolerance)
    links.append(covered)
    rest = resolved.where("_rest").select("_leaf", "_id")
    left = checkpoint(full.where("_home").drop("_home").join(rest, ["_leaf", "_id"], "left_semi"))
    links.append(_compared(left, full.drop("_home"), (F.col("_id") != F.col("_id2")) & near, within=True))
    linked = checkpoint(reduce(DataFrame.unionByName, links))
    group = components(linked)
    more = checkpoint(_bridges(full, group, crowded, resolved, near))
    if not more.isEmpty():
        group = components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return group.withColumnRenamed("node", key)


def _cover(full: DataFrame, crowded: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(links, resolved): links to representatives, and ``(_leaf, _id, _rest)`` of the representatives and the lines left over."""
    links, heads = [], []
    open_ = full.where("_home").drop("_home")
    n_open = open_.count()
    while n_open:
        spread = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(HEADS))
        one = F.min_by(F.struct("_id", "_line", "_box"), F.xxhash64("_id"))
        chosen = open_.groupBy("_leaf", spread.alias("_slot")).agg(one.alias("_head"))
        chosen = checkpoint(chosen.groupBy("_leaf").agg(F.collect_list("_head").alias("_heads")))  # at most HEADS a leaf
        near = lambda h: _near(F.col("_line"), F.col("_box"), h["_line"], h["_box"], tolerance, True)
        found = join_unique(full, chosen, ["_leaf"], "inner", crowded).select(
            "_leaf", "_home", "_id", F.transform(F.filter("_heads", near), lambda h: h["_id"]).alias("_near")
        )
        found = checkpoint(found.where(F.size("_near") > 0))
        links.append(found.select(F.col("_id").alias("a"), F.explode("_near").alias("b")).where("a <> b"))
        heads.append(chosen.select("_leaf", F.explode(F.transform("_heads", lambda h: h["_id"])).alias("_id")))
        open_ = checkpoint(open_.join(found.where("_home").select("_id"), "_id", "left_anti"))
        before, n_open = n_open, open_.count()
        if before - n_open < 2 * heads[-1].count():
            break
    told = [h.withColumn("_rest", F.lit(False)) for h in heads] + [open_.select("_leaf", "_id", F.lit(True).alias("_rest"))]
    return reduce(DataFrame.unionByName, links), checkpoint(reduce(DataFrame.unionByName, told))


def _bridges(full: DataFrame, group: DataFrame, crowded: DataFrame, resolved: DataFrame, near: Column) -> DataFrame:
    """Near pairs between different groups in crowded leaves, of lines that were not compared with their whole leaf yet."""
    named = join_unique(full, group.select(F.col("node").alias("_id"), "component"), ["_id"], "left")
    named = checkpoint(named.withColumn("_group", F.coalesce("component", "_id")).drop("component"))
    sizes = named.groupBy("_leaf", "_group").agg(F.count(F.lit(1)).alias("_m"))
    largest = sizes.groupBy("_leaf").agg(F.max_by("_group", F.struct("_m", "_group")).alias("_large"), F.count(F.lit(1)).alias("_groups"))
    largest = checkpoint(largest.where("_groups > 1").drop("_groups"))
    placed = join_unique(named, largest, ["_leaf"], "inner", crowded).join(
        resolved.select("_leaf", "_id", F.lit(True).alias("_known")), ["_leaf", "_id"], "left"
    )
    placed = checkpoint(placed.where(~F.col("_home") | F.col("_known").isNull()))
    minor, columns = F.col("_group") != F.col("_large"), ["_leaf", "_id", "_line", "_box", "_group"]
    apart = (F.col("_group") != F.col("_group2")) & near
    home = placed.where("_home")
    first = _compared(home.where(minor).select(columns), placed.select(columns), apart)
    return first.unionByName(_compared(home.where(~minor).select(columns), placed.where(minor).select(columns), apart)).distinct()


def almost_equal(lines: DataFrame, key: str, coords: str = "coords", decimal: int = 4) -> DataFrame:
    """One row per line and nearly equal partner, the line itself included.

    A line without a partner has no row. The list of partners is kept as rows,
    so that no task has to hold a long one.
    """
    pairs = checkpoint(near_pairs(lines, key, coords, decimal))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    selves = both.select("a", F.col("a").alias("b")).distinct()
    return both.unionByName(selves).select(F.col("a").alias(key), F.col("b").alias("almost_equal"))


def almost_equal_num(lines: DataFrame, key: str, coords: str = "coords", decimal: int = 4) -> DataFrame:
    """Lines with the number of nearly equal lines, 0 for a line that stands alone."""
    counts = almost_equal(lines, key, coords, decimal).groupBy(key).agg(F.count(F.lit(1)).alias("almost_equal_num"))
    return lines.join(counts, key, "left").fillna(0, ["almost_equal_num"])
