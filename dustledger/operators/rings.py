"""Sites, neighbours, identity and dissolved features of polygons by their rings, concave ones included.

Ring edges are the index: they are cut into short pieces, listed in the grid cells that they really cross, and joined piece
to piece on the cell. A polygon inside another has no edge near it, so containment is asked separately with one point per
ring. Equal rings are one node throughout. All columns are in metres of a planar projection.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dustledger.functions import geo, overlay, planar
from dustledger.operators.components import connected_components
from dustledger.operators.matching import settle_identity
from dustledger.operators.spatial import BOX, _cell, box_pairs, points_in_polygons, with_cells
from dustledger.session import deal, durable, shuffled, spread

EDGE = overlay.EDGE
RING = "array<struct<x:double,y:double>>"


def boxed(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``df`` with the bounding box of its rings; rows without a ring of area go.

    Rows are dealt by their other columns before the rings are judged: files of a few narrow columns are read by few tasks. The ring
    is then a generated column, since Spark would move a filter on it before the exchange.
    """
    once = deal(df.drop(*BOX), *[c for c in df.columns if c not in (ring, *BOX)]).withColumn(ring, F.explode(F.array(ring)))
    named = once.filter(geo.valid_ring(F.col(ring)))
    return named.withColumns(dict(zip(BOX, geo.ring_bbox(F.col(ring)))))


def _shapes(rings: DataFrame, id_col: str, ring: str) -> DataFrame:
    """(sid, ring, box) of the distinct rings; sid is the smallest id of a ring."""
    return boxed(rings.select(id_col, F.col(ring).alias("ring"))).groupBy("ring", *BOX).agg(F.min(id_col).alias("sid"))


def ring_pieces(df: DataFrame, keys: list[str], longest: float, ring: str = "ring") -> DataFrame:
    """(keys, x0, y0, x1, y1): ring edges, cut into pieces of at most ``longest``."""
    sides = df.select(*keys, F.explode(overlay.edges(F.col(ring))).alias("e")).select(*keys, *[F.col(f"e.{c}").alias(c) for c in EDGE])
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / longest).cast("int"), F.lit(1))
    part = sides.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(axis: str, k: Column) -> Column:
        # the ends stay exact, so that neighbouring pieces meet
        a, b = F.col(f"{axis}0"), F.col(f"{axis}1")
        return F.when(k == 0, a).when(k == F.col("_n"), b).otherwise(a + (b - a) * k / F.col("_n"))

    k = F.col("_k")
    return part.select(*keys, at("x", k).alias("x0"), at("y", k).alias("y0"), at("x", k + 1).alias("x1"), at("y", k + 1).alias("y1"))


def _piece_box(df: DataFrame) -> DataFrame:
    return df.withColumns({"minx": F.least("x0", "x1"), "miny": F.least("y0", "y1"), "maxx": F.greatest("x0", "x1"), "maxy": F.greatest("y0", "y1")})


def crossed_cells(pieces: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Pieces with the cells (cx, cy) of a grid that they cross or come within ``margin`` of (per axis)."""
    listed = with_cells(_piece_box(pieces), size, margin)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    off = F.abs(dx * ((F.col("cy") + 0.5) * size - F.col("y0")) - dy * ((F.col("cx") + 0.5) * size - F.col("x0")))
    return listed.filter(off <= (size / 2.0 + margin) * (F.abs(dx) + F.abs(dy)) + 1e-9).drop(*BOX)


def piece_distance(pairs: DataFrame) -> DataFrame:
    """``pairs`` of edges (e, f) with ``d2``, the least squared distance between the start of either edge and the other edge, or 0.

    Over all edges of two rings the least of these is the squared distance of the rings' outlines. Each step is a column of its
    own, so that it is computed once.
    """
    def foot(p: str, q: str, name: str) -> dict[str, Column]:
        dx, dy = F.col(f"{q}.x1") - F.col(f"{q}.x0"), F.col(f"{q}.y1") - F.col(f"{q}.y0")
        on = ((F.col(f"{p}.x0") - F.col(f"{q}.x0")) * dx + (F.col(f"{p}.y0") - F.col(f"{q}.y0")) * dy) / (dx * dx + dy * dy)
        return {name: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(on, F.lit(0.0))))}

    def square(p: str, q: str, name: str) -> Column:
        x = F.col(f"{p}.x0") - F.col(f"{q}.x0") - F.col(name) * (F.col(f"{q}.x1") - F.col(f"{q}.x0"))
        y = F.col(f"{p}.y0") - F.col(f"{q}.y0") - F.col(name) * (F.col(f"{q}.y1") - F.col(f"{q}.y0"))
        return F.pow(x, 2) + F.pow(y, 2)

    stepped = pairs.withColumns({**foot("e", "f", "_t"), **foot("f", "e", "_u"), "_x": overlay.segments_cross(F.col("e"), F.col("f"))})
    return stepped.withColumn("d2", F.when(F.col("_x"), F.lit(0.0)).otherwise(F.least(square("e", "f", "_t"), square("f", "e", "_u")))).drop("_t", "_u", "_x")


def _in_places(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 1 << 15) -> DataFrame:
    """``kernel`` over tables of whole places: rows of equal ``keys`` meet in one table of about ``rows`` rows.

    Places are dealt and sorted by a hash, so only the rows of the table at hand are in a task's memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                # all rows before the first one of the last place
                last, whole = batch.column("_place")[-1].as_py(), n
                for old in reversed(held):
                    before = int(np.searchsorted(old.column("_place").to_numpy(), last))
                    whole -= old.num_rows - before
                    if before:
                        break
                if whole:
                    table = pa.Table.from_batches(held)
                    yield from kernel(table.slice(0, whole).combine_chunks())
                    held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield from kernel(pa.Table.from_batches(held).combine_chunks())

    return spread(df.withColumn("_place", F.xxhash64(*keys)), "_place").sortWithinPartitions("_place").mapInArrow(run, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _edges_of(table: pa.Table) -> np.ndarray:
    return np.stack([_column(table, c) for c in EDGE])


def _groups_of(table: pa.Table, group: str) -> np.ndarray:
    return table.column(group).combine_chunks().dictionary_encode().indices.to_numpy()


def _tile(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _column(table, "cx"), _column(table, "cy")


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [c.split()[0].strip("`") for c in re.sub(r"<[^>]*>*", "", schema).split(", ")]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names)


#: Edges and rings of a place meet in one task: a square of so many cells a side (a power of two, so that cells never straddle tiles).
TILE = 16


def _finite(df: DataFrame) -> DataFrame:
    return df.filter(reduce(Column.__add__, [F.abs(F.col(c)) for c in EDGE]) < float("inf"))


def ring_clusters(rings: DataFrame, id_col: str, ring: str = "ring", gap_m: float = 2.5, cell: float = 25.0) -> DataFrame:
    """(id, component): polygons linked by chains of gaps of at most ``gap_m``, edge to edge; alone = own id.

    Pieces of edges meet by tiles; a tile yields a forest of its rings, not their pairs (see ``planar.near_links``). The components
    of all forests are then asked whether one holds another. Rings without area are in no cluster and have no row.
    """
    member = durable(boxed(rings.select(id_col, F.col(ring).alias("ring"))).withColumn("_h", F.xxhash64("ring")))
    shape = durable(member.groupBy("_h", "ring", *BOX).agg(F.min(id_col).alias("sid")))
    kind = dict(shape.dtypes)["sid"]
    pieces = _finite(ring_pieces(shape, ["sid"], min(cell, 8.0 * gap_m / math.sqrt(2.0))))

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield _batch(links, list(planar.near_links(_column(table, "sid"), _edges_of(table), _tile(table), cell, TILE, gap_m)))

    links = f"u {kind}, v {kind}"
    near = connected_components(_in_places(crossed_cells(pieces, TILE * cell, gap_m), ["cx", "cy"], linked, links))
    known = durable(shape.join(shuffled(near.withColumnRenamed("node", "sid")), "sid", "left").withColumn("part", F.coalesce("component", "sid")).drop("component"))
    point = known.select(F.col("part").alias("other"), F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y")).withColumns(
        {"cx": _cell(F.col("x"), cell), "cy": _cell(F.col("y"), cell)})
    held = with_cells(known, cell).filter((F.col("maxx") - F.col("minx") > 2 * gap_m) & (F.col("maxy") - F.col("miny") > 2 * gap_m))
    inside = point.join(shuffled(held), ["cx", "cy"]).filter(
        (F.col("part") != F.col("other")) & (F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny"))
        & (F.col("y") <= F.col("maxy")) & geo.point_in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("part", "other")
    joined = connected_components(inside.select(F.col("part").alias("u"), F.col("other").alias("v")))
    labels = known.join(shuffled(joined.withColumnRenamed("node", "part")), "part", "left").select("_h", "ring", F.coalesce("component", "part").alias("component"))
    # the hash comes first, so that rings are compared and sorted where it is equal only
    return member.select(id_col, "_h", "ring").join(shuffled(labels), ["_h", "ring"]).select(id_col, "component")


def assign_ring_sites(rings: DataFrame, parcels: DataFrame, id_col: str, parcel_id: str, ring: str = "ring", parcel_ring: str = "ring",
                      gap_m: float = 2.5, cell: float = 50.0) -> DataFrame:
    """(id, site_id, site_source): the parcel whose ring holds the polygon's interior point, else its proximity cluster.

    The interior point lies inside concave shapes too. Where parcels overlap, the smallest parcel id counts.
    """
    x, y = geo.interior_point(F.col("ring"))
    # dealt before the points are sought, and written once: both joins below start from here
    placed = durable(deal(rings.select(id_col, F.col(ring).alias("ring")), id_col).select(id_col, "ring", x.alias("x"), y.alias("y")))
    points = placed.select(id_col, "x", "y")
    lots = boxed(parcels.select(parcel_id, F.col(parcel_ring).alias("ring")))
    hit = durable(points_in_polygons(points, lots, id_col, parcel_id, cell))
    on = hit.filter(F.col(parcel_id).isNotNull()).select(
        id_col, F.concat(F.lit("apn:"), F.col(parcel_id)).alias("site_id"), F.lit("parcel").alias("site_source"))
    off = placed.join(shuffled(on), id_col, "left_anti")
    return on.unionByName(ring_clusters(off, id_col, "ring", gap_m).select(
        id_col, F.concat(F.lit("prox:"), F.col("component")).alias("site_id"), F.lit("proximity").alias("site_source")))


def ring_neighbours(rings: DataFrame, id_col: str, area: str = "area_m2", ring: str = "ring", near: float = 50.0, far: float = 100.0) -> DataFrame:
    """Per polygon: neighbours within ``near`` and ``far`` (edge to edge, self excluded), nearest distance, mean area within ``far``.

    The nearest distance is over all polygons whose box comes within ``far`` per axis, so it can exceed ``far`` at a corner.
    Equal polygons of equal area are one candidate with a count.
    """
    shape = durable(boxed(rings.select(id_col, F.col(ring).alias("ring"), F.col(area).alias("a"))).groupBy("ring", *BOX, "a").agg(
        F.count(F.lit(1)).alias("m"), F.min(id_col).alias("sid")))
    pairs = box_pairs(shape, shape, "sid", "sid", far, far).filter("l < r").select("l", "r")
    one = shape.select(F.col("sid").alias("l"), F.col("ring").alias("_a"))
    two = shape.select(F.col("sid").alias("r"), F.col("ring").alias("_b"))
    # the edges of a pair are multiplied where the pair is, and the minimum needs no further exchange
    beside = spread(pairs.join(shuffled(one), "l").join(shuffled(two), "r"), "l", "r").withColumn("held", F.coalesce(
        geo.point_in_ring(F.col("_a")[0]["x"], F.col("_a")[0]["y"], F.col("_b")) | geo.point_in_ring(F.col("_b")[0]["x"], F.col("_b")[0]["y"], F.col("_a")), F.lit(False)))
    sided = beside.select("l", "r", "held", "_a", F.explode(overlay.edges(F.col("_b"))).alias("f")).select("l", "r", "held", "f", F.explode(overlay.edges(F.col("_a"))).alias("e"))
    measured = piece_distance(sided).groupBy("l", "r").agg(F.sqrt(F.min(F.when(F.col("held"), F.lit(0.0)).otherwise(F.col("d2")))).alias("gap"))
    # both directions of a pair from one row
    measured = measured.select(F.explode(F.array(F.struct("l", "r"), F.struct(F.col("r").alias("l"), F.col("l").alias("r")))).alias("p"), "gap").select("p.l", "p.r", "gap")
    alike = shape.filter("m > 1").select(F.col("sid").alias("l"), F.col("sid").alias("r"), F.lit(0.0).alias("gap"))
    both = measured.unionByName(alike)
    both = both.join(shuffled(shape.select(F.col("sid").alias("r"), "m", "a")), "r")
    n = F.when(F.col("l") == F.col("r"), F.col("m") - 1).otherwise(F.col("m"))
    within = F.col("gap") <= far
    agg = both.withColumn("w", n).groupBy("l").agg(
        F.sum(F.when(F.col("gap") <= near, F.col("w")).otherwise(0)).alias("n_near"), F.sum(F.when(within, F.col("w")).otherwise(0)).alias("n_far"),
        F.min("gap").alias("nearest_m"), (F.sum(F.when(within, F.col("a") * F.col("w"))) / F.sum(F.when(within, F.col("w")))).alias("mean_area_far"))
    mine = rings.select(id_col, F.col(ring).alias("ring"), F.col(area).alias("a")).join(shuffled(shape.select("ring", "a", F.col("sid").alias("l"))), ["ring", "a"]).select(id_col, "l")
    return mine.join(shuffled(agg), "l", "left").select(
        id_col, F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_far", F.lit(0)).alias("n_far"), "nearest_m", "mean_area_far")


def carry_ring_identity(previous: DataFrame, current: DataFrame, prev_id: str, curr_id: str, ring: str = "ring", cell: float = 50.0,
                        min_iou: float = 0.30, max_shift: float = 5.0) -> DataFrame:
    """(curr_id, prev_id, status matched/new/dropped) between two detection runs, by polygon overlap and then by centroid.

    See ``matching.carry_identity`` for the order in which pairs are settled.
    """
    old, new = boxed(previous.select(prev_id, F.col(ring).alias("ring"))), boxed(current.select(curr_id, F.col(ring).alias("ring")))
    pairs = box_pairs(new, old, curr_id, prev_id, cell).select("l", "r")
    both = (pairs.join(shuffled(new.select(F.col(curr_id).alias("l"), F.col("ring").alias("_a"))), "l")
            .join(shuffled(old.select(F.col(prev_id).alias("r"), F.col("ring").alias("_b"))), "r"))
    # a generated column, so that a later filter on it does not compute it again
    rated = deal(both, "l", "r").select("l", "r", F.explode(F.array(overlay.polygon_iou(F.col("_a"), F.col("_b")))).alias("iou"))

    def centred(df: DataFrame, name: str) -> DataFrame:
        x, y = geo.ring_centroid(F.col("ring"))
        return durable(df.select(name, x.alias("x"), y.alias("y")))

    return settle_identity(rated, centred(old, prev_id), centred(new, curr_id), prev_id, curr_id, cell, min_iou, max_shift)


# ---- dissolve ----------------------------------------------------------------------------------------------------
def _snap(value: Column, digits: int) -> Column:
    return F.round(value, digits) + 0.0


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a generated column, which later filters and steps do not compute again."""
    return df.withColumn(name, F.explode(F.array(value)))


def _subedges(sides: DataFrame, group: str, cell: float, digits: int) -> DataFrame:
    """(group, x0, y0, x1, y1): edges cut wherever an edge of another ring of the group crosses or touches them.

    An edge inside a tile is cut there. Those that leave it are marked in each of their tiles and cut at all marks together.
    """
    kind = dict(sides.dtypes)[group]
    keys = [group, "rid", *EDGE]
    schema = f"`{group}` {kind}, x0 double, y0 double, x1 double, y1 double, rid long, t double, x double, y double"

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rid, e, tile = _column(table, "rid"), _edges_of(table), _tile(table)
        at = np.floor(e / (TILE * cell))
        inner, first = (at[0] == at[2]) & (at[1] == at[3]), (at[0] == tile[0]) & (at[1] == tile[1])
        for part, (row, t, x, y) in planar.cut_marks(_groups_of(table, group), rid, e, tile, cell, TILE, digits):
            # both ends are marks
            own = part.start + np.flatnonzero(first[part])
            row, t = np.concatenate([row, own, own]), np.concatenate([t, np.zeros(len(own)), np.ones(len(own))])
            x, y = np.concatenate([x, e[0][own], e[2][own]]), np.concatenate([y, e[1][own], e[3][own]])
            some = (inner & first)[row]
            of, parts = planar.sub_edges(row[some], t[some], x[some], y[some])
            none = pa.nulls(len(of), pa.float64())
            yield _batch(schema, [table.column(group).take(pa.array(of)), *parts, pa.nulls(len(of), pa.int64()), none, none, none])
            some = ~inner[row]
            row = row[some]
            yield _batch(schema, [table.column(group).take(pa.array(row)), *e[:, row], rid[row], t[some], x[some], y[some]])

    done = durable(_in_places(crossed_cells(sides, TILE * cell, 2 * 10.0**-digits), [group, "cx", "cy"], cut, schema))
    marks = done.filter("rid is not null").groupBy(*keys, "x", "y").agg(F.min("t").alias("t"))
    after = W.partitionBy(*keys).orderBy("t", "x", "y")
    cuts = marks.withColumns({"_x": F.lead("x").over(after), "_y": F.lead("y").over(after)}).filter("_x is not null")
    return done.filter("rid is null").select(group, *EDGE).unionByName(
        cuts.select(group, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("_x").alias("x1"), F.col("_y").alias("y1")))


def _outline(sides: DataFrame, shapes: DataFrame, group: str, cell: float, digits: int) -> DataFrame:
    """(group, x0, y0, x1, y1) of the directed parts of edges with the union on their left and nothing on their right."""
    tile = TILE * cell
    middle = {"cx": _cell((F.col("x0") + F.col("x1")) / 2.0, tile), "cy": _cell((F.col("y0") + F.col("y1")) / 2.0, tile)}
    parts = _subedges(sides, group, cell, digits).withColumns(middle)
    schema = f"`{group}` {dict(sides.dtypes)[group]}, x0 double, y0 double, x1 double, y1 double"

    def kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code, is_ring = _groups_of(table, group), pc.is_valid(table.column("ring")).to_numpy()
        edge, over = np.flatnonzero(~is_ring), np.flatnonzero(is_ring)
        e = np.stack([table.column(c).fill_null(0.0).to_numpy() for c in EDGE])[:, edge]
        row, e = planar.single_parts(code[edge], e)
        edge = edge[row]
        rings = table.column("ring").take(pa.array(over)).combine_chunks()
        corners = rings.flatten()
        size = pc.list_value_length(rings).to_numpy(zero_copy_only=False).astype(np.int64)
        hidden = planar.covered(code[edge], (e[0] + e[2]) / 2.0, (e[1] + e[3]) / 2.0, code[over], np.cumsum(size) - size, size, corners.field("x").to_numpy(),
                                corners.field("y").to_numpy(), [t[over] for t in _tile(table)], cell, TILE, digits)
        yield _batch(schema, [table.column(group).take(pa.array(edge[~hidden])), *e[:, ~hidden]])

    listed = with_cells(shapes.select(group, "ring", *BOX), tile).drop(*BOX)
    return _in_places(parts.unionByName(listed, allowMissingColumns=True), [group, "cx", "cy"], kept, schema)


def _ring_columns(loops: list[list[tuple[float, float]]]) -> list:
    """Rings, signed areas and boxes of loops of three corners or more."""
    size = np.array([len(loop) for loop in loops], np.int64)
    first = np.cumsum(size) - size
    x, y = (np.array([p[k] for loop in loops for p in loop], float) for k in (0, 1))
    at, k = planar.expand(size)
    follow = first[at] + (k + 1) % size[at] if len(at) else at
    # from the first corner, so that far coordinates cost no digits
    u, v = x - x[first[at]], y - y[first[at]]
    twice = np.bincount(at, u * v[follow] - u[follow] * v, len(size))
    ring = pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    box = [f.reduceat(c, first) if len(first) else c for f, c in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
    return [ring, twice / 2.0, *box]


def _loops(parts: DataFrame, group: str, cell: float) -> DataFrame:
    """(group, ring, signed, box): simple loops of the closed walks along parts, each of which goes on with the one around the same corner.

    ``parts`` have an id eid. A walk inside a tile is closed there. Of the others each tile gives its pieces, from the part that enters to
    the part that leaves; the pieces of a walk are components of that relation, and meet in a task.
    """
    kind = dict(parts.dtypes)[group]
    found = f"`{group}` {kind}, ring {RING}, signed double, minx double, miny double, maxx double, maxy double"
    schema = f"{found}, head long, next long"
    tile = TILE * cell
    ends = [F.struct(_cell(F.col(f"x{k}"), tile).alias("cx"), _cell(F.col(f"y{k}"), tile).alias("cy")) for k in (0, 1)]

    def walked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code, eid, e, at = _groups_of(table, group), _column(table, "eid"), _edges_of(table), _tile(table)
        starts, stops = ((np.floor(e[k] / tile) == at[0]) & (np.floor(e[k + 1] / tile) == at[1]) for k in (0, 2))
        closed, opened = planar.walks(planar.successors(code, e, starts, stops), e[0], e[1], starts)
        loops = [(first, loop) for first, points in closed for loop in planar.simple_loops(points)]
        none = pa.nulls(len(loops), pa.int64())
        yield _batch(schema, [table.column(group).take(pa.array([r for r, _ in loops], pa.int64())), *_ring_columns([loop for _, loop in loops]), none, none])
        rings = _ring_columns([points for _, _, points in opened])
        first, last = (np.array([o[k] for o in opened], np.int64) for k in (0, 1))
        yield _batch(schema, [table.column(group).take(pa.array(first)), *rings, eid[first], eid[last]])

    def joined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, dict[int, tuple[int, int]]] = {}
        for row, (walk, head, onward) in enumerate(zip(*(_column(table, c).tolist() for c in ("walk", "head", "next")))):
            pieces.setdefault(walk, {})[head] = (onward, row)
        rings = table.column("ring").combine_chunks()
        corners, first_of = rings.flatten(), np.append(0, np.cumsum(pc.list_value_length(rings).to_numpy(zero_copy_only=False))).tolist()
        x, y = corners.field("x").to_pylist(), corners.field("y").to_pylist()
        loops = []
        for chain in pieces.values():
            at = first = min(chain)
            points, left = [], len(chain)
            while left:
                if at not in chain:
                    raise ValueError("an outline does not close")
                onward, row = chain[at]
                points += zip(x[first_of[row]:first_of[row + 1]], y[first_of[row]:first_of[row + 1]])
                at, left = onward, left - 1
            if at != first:
                raise ValueError("an outline does not close")
            loops += [(row, loop) for loop in planar.simple_loops(points)]
        yield _batch(found, [table.column(group).take(pa.array([r for r, _ in loops], pa.int64())), *_ring_columns([loop for _, loop in loops])])

    placed = parts.select(group, "eid", *EDGE, F.explode(F.array_distinct(F.array(*ends))).alias("_at")).select(group, "eid", *EDGE, "_at.cx", "_at.cy")
    out = durable(_in_places(placed, [group, "cx", "cy"], walked, schema))
    opened = out.filter("head is not null")
    walks = connected_components(opened.select(F.col("head").alias("u"), F.col("next").alias("v"))).select(F.col("node").alias("head"), F.col("component").alias("walk"))
    pieces = opened.select(group, "ring", "head", "next").join(shuffled(walks), "head")
    done = _in_places(pieces, ["walk"], joined, found)
    return out.filter("head is null").drop("head", "next").unionByName(done)


def dissolve(rings: DataFrame, group: str, ring: str = "ring", cell: float = 20.0, digits: int = 6) -> DataFrame:
    """(group, ring, holes, area): the union of a group's polygons as features with holes.

    Edges are cut where they meet edges of other rings (found on the grid by tiles, so a group with a third of all rings spreads over
    tasks), and of the parts those stay that have the union on one side only. At its end each part goes on with the part
    that encloses the same corner of the union; the closed walks are components of that relation. A walk becomes simple loops:
    anti-clockwise ones are shells, clockwise ones holes of the smallest shell around them. Only the parts of one walk meet in
    a task beyond their tile, which is what one output row holds.

    Coordinates are rounded to ``digits`` decimals, crossings too. Polygons that touch in a point stay apart, those that share a
    part of an edge are merged. Equal rings count once; rings without area go, and so do groups of null.
    """
    rounded = deal(rings.filter(F.col(group).isNotNull()).select(group, F.col(ring).alias("ring")), group, "ring")
    rounded = _once(rounded, "ring", F.transform("ring", lambda p: F.struct(_snap(p["x"], digits).alias("x"), _snap(p["y"], digits).alias("y"))))
    signed = _once(rounded.filter(F.size("ring") >= 3), "signed", geo.signed_area(F.col("ring"))).filter((F.col("signed") != 0) & (F.abs("signed") < float("inf")))
    ccw = signed.select(group, F.when(F.col("signed") < 0, F.reverse("ring")).otherwise(F.col("ring")).alias("ring")).distinct()
    shapes = durable(ccw.withColumns(dict(zip(BOX, geo.ring_bbox(F.col("ring"))))).withColumn("rid", F.monotonically_increasing_id()))
    sides = shapes.select(group, "rid", F.explode(overlay.edges(F.col("ring"))).alias("e")).select(group, "rid", *[F.col(f"e.{c}").alias(c) for c in EDGE]).filter("x0 <> x1 or y0 <> y1")
    parts = durable(_outline(sides, shapes, group, cell, digits).withColumn("eid", F.monotonically_increasing_id()))
    loops = durable(_loops(parts, group, cell).filter("signed <> 0").withColumn("loop", F.monotonically_increasing_id()))
    shell, hole = loops.filter("signed > 0"), loops.filter("signed < 0")
    spot = hole.select(group, F.col("ring").alias("hole"), F.col("loop").alias("_hole"), F.col("signed").alias("_less"),
                       ((F.col("ring")[0]["x"] + F.col("ring")[1]["x"]) / 2.0).alias("x"), ((F.col("ring")[0]["y"] + F.col("ring")[1]["y"]) / 2.0).alias("y"))
    spot = spot.withColumns({"cx": _cell(F.col("x"), 8 * cell), "cy": _cell(F.col("y"), 8 * cell)})
    around = spot.join(shuffled(with_cells(shell, 8 * cell)), [group, "cx", "cy"]).filter(geo.point_in_ring(F.col("x"), F.col("y"), F.col("ring")))
    owner = around.groupBy("_hole").agg(F.min_by("loop", "signed").alias("loop"), F.first("hole").alias("hole"), F.first("_less").alias("_less"))
    gathered = owner.groupBy("loop").agg(F.collect_list("hole").alias("holes"), F.sum("_less").alias("_less"))
    none = F.expr(f"cast(array() as array<{RING}>)")
    return shell.join(shuffled(gathered), "loop", "left").select(
        group, "ring", F.coalesce("holes", none).alias("holes"), (F.col("signed") + F.coalesce("_less", F.lit(0.0))).alias("area"))
