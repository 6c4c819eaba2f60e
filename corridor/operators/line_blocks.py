"""Blocks of lines against the polygons near them, in NumPy: what a task does that holds whole lines.

A partition has the lines of a block first and then, by polygon, pieces of polygon
edges and the lines known to start inside. All hits of a line are found in its block,
so they are neither shuffled nor written. A task holds the lines of its block, edges of
``most`` cells and a few comparisons at a time, however many polygons and hits there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of the edges and of the parts of lines held at a time; marks (line and polygon), lines and comparisons at a time.
MOST_CELLS = 1_000_000
MOST_MARKS = 4_000_000
MOST_LINES = 128
MOST_PAIRS = 262_144
#: Degrees by which a path's columns are widened against rounding.
MARGIN = 1e-9
#: Numbers a cell by column and row. Where that overflows two cells share a number, which only costs comparisons.
STRIDE = np.int64(1 << 31)


def ramps(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


@dataclass(frozen=True)
class Segments:
    """Segments from ``a`` to ``b`` and whose they are."""

    owner: np.ndarray
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray

    def at(self, rows) -> Segments:
        return Segments(self.owner[rows], self.ax[rows], self.ay[rows], self.bx[rows], self.by[rows])

    def finite(self) -> Segments:
        """Without segments that miss a number: they touch nothing."""
        return self.at(np.isfinite(self.ax) & np.isfinite(self.ay) & np.isfinite(self.bx) & np.isfinite(self.by))


def cells_of(s: Segments, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """(segment, cell number) of the cells along each path, as ``spatial._bands`` follows it."""
    x0, x1, y0, y1 = np.minimum(s.ax, s.bx), np.maximum(s.ax, s.bx), np.minimum(s.ay, s.by), np.maximum(s.ay, s.by)
    first = np.floor(y0 / cell).astype(np.int64)
    rows = np.floor(y1 / cell).astype(np.int64) - first + 1
    of = np.repeat(np.arange(len(rows)), rows)
    cy = first[of] + ramps(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = ((s.bx - s.ax) / (s.by - s.ay))[of]
        low = s.ax[of] + (np.maximum(y0[of], cy * cell) - s.ay[of]) * slope
        high = s.ax[of] + (np.minimum(y1[of], (cy + 1) * cell) - s.ay[of]) * slope
    flat = ~np.isfinite(low + high)
    left = np.maximum(x0[of], np.where(flat, x0[of], np.minimum(low, high) - MARGIN))
    right = np.minimum(x1[of], np.where(flat, x1[of], np.maximum(low, high) + MARGIN))
    c0 = np.floor(np.minimum(left, right) / cell).astype(np.int64)
    columns = np.floor(np.maximum(left, right) / cell).astype(np.int64) - c0 + 1
    cx = np.repeat(c0, columns) + ramps(columns)
    return np.repeat(of, columns), cx * STRIDE + np.repeat(cy, columns)


def weights(s: Segments, cell: float) -> np.ndarray:
    """About how many cells each segment passes, and not fewer than half of them."""
    return np.nan_to_num(2 + (np.abs(s.bx - s.ax) + np.abs(s.by - s.ay)) / cell, nan=2, posinf=2)


def runs(weight: np.ndarray, most: float) -> Iterator[slice]:
    """Consecutive items that together weigh ``most`` or are one item."""
    ends, low = np.cumsum(weight), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield slice(low, high)
        low = high


def touching(parts: Segments, edges: Segments, of: np.ndarray, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners of parts, owners of edges) that share a point: part ``of[i]`` with ``counts[i]`` edges from ``start[i]`` on.

    The same sums in the same order as ``geometry.segments_touch``, the sign that rules out most pairs first.
    """
    part = np.repeat(of, counts)
    edge = np.repeat(start, counts) + ramps(counts)
    each = lambda values: np.repeat(values[of], counts)
    sx, sy, dx, dy = each(parts.ax), each(parts.ay), each(parts.bx - parts.ax), each(parts.by - parts.ay)
    one = dx * (edges.ay[edge] - sy) - dy * (edges.ax[edge] - sx)
    two = dx * (edges.by[edge] - sy) - dy * (edges.bx[edge] - sx)
    near = np.flatnonzero(one * two <= 0)
    s, e = parts.at(part[near]), edges.at(edge[near])
    wide, high = e.bx - e.ax, e.by - e.ay
    one = wide * (s.ay - e.ay) - high * (s.ax - e.ax)
    two = wide * (s.by - e.ay) - high * (s.bx - e.ax)
    met = (one * two <= 0) & (np.minimum(s.ax, s.bx) <= np.maximum(e.ax, e.bx)) & (np.minimum(e.ax, e.bx) <= np.maximum(s.ax, s.bx))
    met &= (np.minimum(s.ay, s.by) <= np.maximum(e.ay, e.by)) & (np.minimum(e.ay, e.by) <= np.maximum(s.ay, s.by))
    return s.owner[met], e.owner[met]


class Edges:
    """Edges of some polygons by the cells along their paths."""

    def __init__(self, edges: Segments, cell: float) -> None:
        self.cell = cell
        edges = edges.finite()
        of, cells = cells_of(edges, cell)
        order = np.argsort(cells, kind="stable")
        self.edges = edges.at(of[order])  # once per cell, a cell's edges side by side
        self.cells, self.first, self.counts = np.unique(cells[order], return_index=True, return_counts=True)

    def mark(self, parts: Segments, marks: np.ndarray) -> None:
        """Set ``marks[owner of part, owner of edge]`` of all that touch."""
        for run in runs(weights(parts, self.cell), MOST_CELLS) if len(self.cells) else ():
            some = parts.at(run)
            of, cells = cells_of(some, self.cell)
            at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            met = np.flatnonzero(self.cells[at] == cells)
            of, at = of[met], at[met]
            first, counts = self.first[at], self.counts[at]
            for pairs in runs(counts, MOST_PAIRS):
                marks[touching(some, self.edges, of[pairs], first[pairs], counts[pairs])] = True


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles, missing ones as NaN."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def parts_of(coords: pa.Array) -> Segments:
    """Consecutive vertices of list<struct<lon,lat>>, owned by the row."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(coords), 0)).astype(np.int64)
    points = coords.flatten()
    lon, lat = numbers(pc.struct_field(points, "lon")), numbers(pc.struct_field(points, "lat"))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pair = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
    return Segments(owner[pair], lon[pair], lat[pair], lon[pair + 1], lat[pair + 1]).finite()


def edges_of(packs: pa.Array, owner: np.ndarray) -> Segments:
    """Edges from lists of four numbers each, owned by the polygon of the row."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(packs), 0)).astype(np.int64) // 4
    ends = numbers(packs.flatten()).reshape(-1, 4)
    return Segments(np.repeat(owner, sizes), *np.ascontiguousarray(ends.T))


class Block:
    """The lines of a task and which of them met anything so far."""

    def __init__(self, lines: pa.Table, coords: str, cell: float) -> None:
        self.cell = cell
        self.rows = lines["_row"].combine_chunks()
        ids = lines["_line"].to_numpy()
        self.order = np.argsort(ids)
        self.ids = ids[self.order]
        self.parts = parts_of(pc.struct_field(self.rows, [self.rows.type.get_field_index(coords)]))
        self.met = np.zeros(len(ids), bool)
        self.last, self.told = None, np.zeros(len(ids), bool)  # the polygon that may go on in the next rows, and its lines

    def meet(self, rows: pa.Table) -> Iterator[tuple[pa.Array, pa.Array]]:
        """(line rows, labels of the polygons found), every line and polygon once, for rows of consecutive polygons."""
        polygon = rows["_polygon"].to_numpy()
        new = np.append(True, polygon[1:] != polygon[:-1])
        owner, labels = np.cumsum(new) - 1, rows["_label"].combine_chunks().take(pa.array(np.flatnonzero(new)))
        edges = Edges(edges_of(rows["_ends"].combine_chunks(), owner), self.cell)
        known = np.flatnonzero(np.asarray(rows["_line"].is_valid()))
        inside = self.order[np.searchsorted(self.ids, rows["_line"].take(pa.array(known)).to_numpy())] if len(known) else known
        around, told = owner[known], np.zeros(len(self.told), bool)
        if polygon[0] != self.last:
            self.told[:] = False
        step = max(1, min(MOST_LINES, MOST_MARKS // len(labels)))
        for low in range(0, len(self.rows), step):
            high = min(low + step, len(self.rows))
            marks = np.zeros((high - low, len(labels)), bool)
            mine = self.parts.at(slice(*np.searchsorted(self.parts.owner, [low, high])))
            edges.mark(Segments(mine.owner - low, mine.ax, mine.ay, mine.bx, mine.by), marks)
            here = (inside >= low) & (inside < high)
            marks[inside[here] - low, around[here]] = True
            told[low:high] = marks[:, -1]
            if len(labels) == 1:
                told[low:high] |= self.told[low:high]
            marks[:, 0] &= ~self.told[low:high]
            found = np.flatnonzero(marks)
            per_line = np.bincount(found // len(labels), minlength=high - low)
            some = np.flatnonzero(per_line)
            self.met[low + some] = True
            if len(some):
                offsets = np.append(0, np.cumsum(per_line[some])).astype(np.int32)
                yield self.rows.take(pa.array(low + some)), pa.ListArray.from_arrays(offsets, labels.take(pa.array(found % len(labels))))
        self.last, self.told = polygon[-1], told

    def alone(self, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
        """The lines that met nothing, each with an empty list."""
        left = np.flatnonzero(~self.met)
        return self.rows.take(pa.array(left)), pa.ListArray.from_arrays(np.zeros(len(left) + 1, np.int32), pa.array([], kind))


def meet_blocks(coords: str, cell: float, most: int = MOST_CELLS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function of a sorted partition: ``(_row, _found)``, rows of lines with the labels of polygons they meet.

    Rows with a null ``_polygon`` are lines and come first; those with ``_ends`` are edges, the others lines known to start inside.
    """
    def cost(rows: pa.RecordBatch) -> np.ndarray:
        edges = edges_of(rows["_ends"], np.arange(rows.num_rows))
        return 1 + np.bincount(edges.owner, weights(edges, cell), rows.num_rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, rows, held, block, kind = [], [], 0.0, None, None
        told = lambda found: pa.RecordBatch.from_arrays(list(found), ["_row", "_found"])
        for batch in batches:
            kind = batch.schema.field("_label").type
            is_line = batch["_polygon"].is_null()
            if block is None:
                lines.append(batch.filter(is_line))
            others = batch.filter(pc.invert(is_line))
            if not others.num_rows:
                continue
            block = block or Block(pa.Table.from_batches(lines), coords, cell)
            each_cost = cost(others)
            for run in runs(each_cost, most):
                more = each_cost[run].sum()
                if rows and held + more > most:
                    yield from map(told, block.meet(pa.Table.from_batches(rows)))
                    rows, held = [], 0.0
                rows.append(others.slice(run.start, run.stop - run.start))
                held += more
        if lines:
            block = block or Block(pa.Table.from_batches(lines), coords, cell)
            if rows:
                yield from map(told, block.meet(pa.Table.from_batches(rows)))
            yield told(block.alone(kind))

    return each
