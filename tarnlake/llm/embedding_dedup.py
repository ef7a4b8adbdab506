"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on ``PROJECTIONS`` fixed random directions. Two unit vectors at distance d differ by a
normal amount of deviation d on each, independently, so a pair at the least cosine falls within a window
of half width ``w`` around the query on each direction with a known probability. A pair that collides in at
least ``least_collisions`` windows is verified in double precision. ``w`` is calibrated so that a pair at the
threshold passes with probability ``RECALL``; closer pairs pass more often, and none below it is linked.

1. Equal vectors are one class; only its smallest vec_id is compared, the others count as its copies.
2. The first ``grid`` directions cut space into cells as wide as a window, so that partners lie in the same or
   a neighbouring cell. More directions are used when cells would be large; a cell with more than ``BLOCK``
   vectors is cut into chunks. Each pair of neighbouring chunks is one block, and a block is all that a task holds.
3. In a block both sides are sorted on the next direction; each run of queries sees only the rows in its
   window, collisions are counted in numpy, and pairs that can no longer reach the count are left out.
4. A block returns how many links each vector has and a spanning forest of its links, never the pairs.

Random directions in many dimensions cut slowly: the work falls well below all pairs but not to a linear
amount (README.md has figures).

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with
nothing; vectors of different lengths do not link; a null vec_id links with nothing and is not kept; rows
with the same vec_id and equal vectors are one vector; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.graph import components
from tarnlake.sources.scratch import settle

COSINE = 0.95
RECALL = 0.995
PROJECTIONS = 16
MISSES = 1  # windows that a pair may miss
BLOCK = 4096
MOST_GRID = 4
_RUN = 256


def window(cosine: float, recall: float, grid: int, projections: int, misses: int) -> float:
    """The half width with which a pair at ``cosine`` passes with probability ``recall``.

    It has to collide on all grid directions and miss at most ``misses`` of the others.
    """
    rest = projections - grid

    def passes(p: float) -> float:
        return p**grid * sum(math.comb(rest, k) * p ** (rest - k) * (1 - p) ** k for k in range(misses + 1))

    low, high = 0.5, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if passes(math.erf(middle / math.sqrt(2))) >= recall else (middle, high)
    return high * math.sqrt(2 - 2 * cosine)


def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(20_260_000 + dim).standard_normal((dim, projections))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and all(map(math.isfinite, vector)) and any(vector)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2, dims = [], [], []
        for vector in batch["embedding"].to_pylist():
            if not _usable(vector):
                h1.append(None), h2.append(None), dims.append(None)
                continue
            digest = hashlib.blake2b((np.array(vector, np.float64) + 0.0).tobytes(), digest_size=16).digest()
            a, b = np.frombuffer(digest, np.int64).tolist()
            h1.append(a), h2.append(b), dims.append(len(vector))
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(dims, pa.int32())]
            + [batch["embedding"]],
            names=["vec_id", "h1", "h2", "dim", "embedding"],
        )


def _cells(units: np.ndarray, grid: int, width: float) -> np.ndarray:
    return np.floor(units @ directions(units.shape[1], PROJECTIONS)[:, :grid] / width).astype(np.int64)


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _of_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch["dim"].to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part, _units(_matrix(part["embedding"], dim))


def _dealt(grid: int, width: float, chunks: dict[tuple[int, ...], int]):
    """Each vector once for every block it belongs to; a block is a pair of chunks of neighbouring cells."""
    steps = [s for s in product((-1, 0, 1), repeat=grid) if s >= (0,) * grid]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, units in _of_dim(batch):
                cells, ids = _cells(units, grid, width), part["vec_id"].to_numpy()
                take, blocks, second = [], [], []
                for i, (cell, vec) in enumerate(zip(map(tuple, cells.tolist()), ids.tolist())):
                    own = hash((vec, dim)) % chunks[(dim, *cell)]
                    for step in steps:
                        ahead = tuple(c + s for c, s in zip(cell, step))
                        behind = tuple(c - s for c, s in zip(cell, step))
                        if ahead == cell:
                            for other in range(chunks[(dim, *cell)]):
                                low, high = min(own, other), max(own, other)
                                take.append(i)
                                blocks.append(f"{dim}|{cell}|{cell}|{low}|{high}")
                                second.append(own == high and low != high)
                            continue
                        for other in range(chunks.get((dim, *ahead), 0)):
                            take.append(i), second.append(False)
                            blocks.append(f"{dim}|{cell}|{ahead}|{own}|{other}")
                        for other in range(chunks.get((dim, *behind), 0)):
                            take.append(i), second.append(True)
                            blocks.append(f"{dim}|{behind}|{cell}|{other}|{own}")
                chosen = part.select(["vec_id", "copies", "embedding"]).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.string()), pa.array(second, pa.bool_()), *chosen.columns],
                    names=["block", "second", "vec_id", "copies", "embedding"],
                )

    return rows


def colliding(a: np.ndarray, b: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with at least ``least`` collisions; both sides sorted on the first column."""
    projections, first, second = a.shape[1], [], []
    dense = min(6, projections)
    for at in range(0, len(a), _RUN):
        run = a[at : at + _RUN]
        low = np.searchsorted(b[:, 0], run[0, 0] - width, "left")
        high = np.searchsorted(b[:, 0], run[-1, 0] + width, "right")
        if low == high:
            continue
        counts = np.zeros((len(run), high - low), np.int8)
        for j in range(dense):
            counts += np.abs(run[:, j, None] - b[None, low:high, j]) <= width
        x, y = np.nonzero(counts >= least - (projections - dense))
        n = counts[x, y].astype(np.int64)
        for j in range(dense, projections):
            n += np.abs(run[x, j] - b[low + y, j]) <= width
            alive = n >= least - (projections - 1 - j)
            x, y, n = x[alive], y[alive], n[alive]
        first.append(x + at)
        second.append(y + low)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(first or empty), np.concatenate(second or empty)


def _smallest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it hangs together with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return label


def _block_links(cosine: float, width: float, grid: int):
    least = PROJECTIONS - MISSES

    def links(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy()
        ids, copies = table["vec_id"].to_numpy(), table["copies"].to_numpy()
        flat = table["embedding"].combine_chunks()
        units = _units(_matrix(flat, len(flat.flatten()) // len(flat)))
        # The grid's directions come last: within a block most pairs collide there.
        order = np.roll(np.arange(PROJECTIONS), -grid)
        projected = units @ directions(units.shape[1], PROJECTIONS)[:, order]
        ranked = np.argsort(projected[:, 0], kind="stable")
        a = b = ranked
        if second.any():
            a, b = ranked[~second[ranked]], ranked[second[ranked]]
        x, y = colliding(projected[a], projected[b], width, least) if len(a) and len(b) else (a[:0], b[:0])
        x, y = a[x], b[y]
        if not second.any():
            x, y = x[x < y], y[x < y]
        sure = np.empty(len(x), bool)
        for at in range(0, len(x), 65_536):
            part = slice(at, at + 65_536)
            sure[part] = np.einsum("ij,ij->i", units[x[part]], units[y[part]]) >= cosine
        x, y = x[sure], y[sure]
        found = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
        label = _smallest(len(ids), x, y)
        linked = np.flatnonzero(found)
        return pa.table(
            {"vec_id": ids[linked], "links": found[linked].astype(np.int64), "other": ids[label[linked]]},
            schema=pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]),
        )

    return links


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    typed = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    schema = "vec_id long, h1 long, h2 long, dim int, embedding array<double>"
    marked = settle(typed.mapInArrow(_fingerprints, schema), "vectors")
    real = marked.where("dim IS NOT NULL AND vec_id IS NOT NULL")
    classes = real.groupBy("h1", "h2", "dim").agg(
        F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")
    )
    classes = settle(classes, "vector-classes")
    reps = real.join(classes, ["h1", "h2", "dim"]).where("vec_id = rep")
    reps = settle(reps.dropDuplicates(["vec_id", "h1", "h2", "dim"]).select("vec_id", "dim", "copies", "embedding"), "reps")

    total, grid = reps.count(), 2
    while grid < MOST_GRID and total * 0.33**grid > 2 * BLOCK:
        grid += 1
    width = window(cosine, recall, grid, PROJECTIONS, MISSES)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, units in _of_dim(batch):
                found, n = np.unique(_cells(units, grid, width), axis=0, return_counts=True)
                keys = [[dim, *c] for c in found.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(n)], names=["cell", "n"])

    # A projection has deviation 1, so there are a dozen cells in each of at most MOST_GRID directions.
    counted = reps.mapInArrow(cells, "cell array<long>, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    chunks = {tuple(row["cell"]): -(-row["n"] // BLOCK) for row in counted}
    dealt = reps.mapInArrow(
        _dealt(grid, width, chunks), "block string, second boolean, vec_id long, copies long, embedding array<double>"
    )
    links = dealt.groupBy("block").applyInArrow(_block_links(cosine, width, grid), "vec_id long, links long, other long")
    links = settle(links, "vector-links")
    degrees = links.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    of_class = settle(real.select("vec_id", "h1", "h2", "dim").join(classes, ["h1", "h2", "dim"]), "class-members")
    same = of_class.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    edges = links.select(F.col("vec_id").alias("a"), F.col("other").alias("b")).union(same)
    found = components(edges).withColumnRenamed("node", "vec_id")
    linked = of_class.join(degrees, "rep", "left").select(
        "vec_id", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = marked.select("vec_id", "h1", "h2").join(linked.distinct(), ["vec_id", "h1", "h2"], "left").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
