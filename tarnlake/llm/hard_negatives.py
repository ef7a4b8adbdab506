"""Hard negatives of anchor vectors, from exact integer scores.

Vectors become integers (``floor(scale * x)`` of every component) and the score of two rows is their inner
product. Anchors and candidates are dealt to a grid of cells of bounded size; a cell multiplies tiles of its
anchors with tiles of its candidates by Strassen's recursion on 64-bit integers, padded with zeros to even sizes.
Sums may wrap around on the way: additions and products of 64-bit integers are exact modulo 2^64 and the score
itself fits, so the end result is exact.

1. Every cell keeps, for each anchor, a heap of the best rows of its label. Heaps merge: tile by tile inside a
   cell, and over the cells by a ranked window that Spark cuts to the heap's size before it shuffles.
2. With the positives known, every cell keeps one heap for each anchor and positive, of the rows of other labels
   whose score lies in the positive's window. They merge in the same way.

All rows are compared with all anchors, in blocks; nothing is grouped by label or by vector, so neither a hot
label nor a hot vector makes a large group. A cell holds at most some ``CELL_VALUES`` components on either side.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor do those
whose integers' squares sum up to 2^56 or more (their scores do not fit a long). A shorter vector counts as padded
with zeros; an empty one scores 0 with every row. Repeated rows are rows of their own, so a copy of an anchor is
another row of its label, and each copy of an anchor has its own result rows. A null vec_id is no anchor, its label
stays, and among equal scores it comes last. An anchor without a positive, and a positive without a negative in its
window, give no row; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.sources.scratch import settle

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80  # a negative's score is at least this share of the positive's, and at most the positive's
CELL_VALUES = 4 << 20
LEAST_ROWS = 256  # of a cell's side, however long the vectors are
TILE_ROWS = 2048
LEAF = 16
SQUARES = float(1 << 56)
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of 64-bit integers by seven products of quarters; sides of odd length get a row of zeros."""
    (m, k), n = a.shape, len(b)
    if min(m, n, k) <= leaf:
        return a @ b.T
    even = lambda x: np.pad(x, [(0, side % 2) for side in x.shape])
    a, b = even(a), even(b)
    r, c, h = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :h], a[:r, h:], a[r:, :h], a[r:, h:]
    b11, b12, b21, b22 = b[:c, :h], b[:c, h:], b[c:, :h], b[c:, h:]  # b is not transposed: b21 stands for b's 12
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b21 - b22, leaf)
    m4 = strassen(a22, b12 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b21, leaf)
    m7 = strassen(a12 - a22, b12 + b22, leaf)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = m1 + m4 - m5 + m7
    out[:r, c:] = m3 + m5
    out[r:, :c] = m2 + m4
    out[r:, c:] = m1 - m2 + m3 + m6
    return out[:m, :n]


class Heaps:
    """For each of ``m`` queries the best ``k`` offers: higher scores first, then smaller places."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.score = np.full((m, k), NONE, np.int64)
        self.place = np.zeros((m, k), np.int64)

    def offer(self, scores: np.ndarray, first: int) -> None:
        """Scores of the places ``first`` and on for every query; ``NONE`` is no offer."""
        least = self.score[:, -1]
        if scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            least = np.maximum(least, np.partition(scores, at, axis=1)[:, at])
        rows, cols = np.nonzero((scores >= least[:, None]) & (scores != NONE))
        self._take(rows, scores[rows, cols], cols + first)

    def merge(self, other: Heaps) -> None:
        rows, at = np.nonzero(other.score != NONE)
        self._take(rows, other.score[rows, at], other.place[rows, at])

    def _take(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        have, at = np.nonzero(self.score != NONE)
        rows = np.concatenate([have, rows])
        scores = np.concatenate([self.score[have, at], scores])
        places = np.concatenate([self.place[have, at], places])
        order = np.lexsort((places, -scores, rows))
        rows, scores, places = rows[order], scores[order], places[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.k
        self.score[rows[kept], rank[kept]] = scores[kept]
        self.place[rows[kept], rank[kept]] = places[kept]


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of long as rows of a matrix, padded with zeros."""
    lists = vectors.combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label and the integers ``v`` of the rows that take part."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    squares = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(F.floor(c.cast("double") * scale).cast("double"), F.lit(2.0)))
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & finite).where(squares < SQUARES)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", scaled.alias("v"))


def _cells(anchors: DataFrame, rows: DataFrame, groups: tuple[int, int], function, schema: str) -> DataFrame:
    """``function`` over every cell of the grid of anchor groups and row groups."""
    a_groups, r_groups = groups
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # anchors are some of the rows: new column ids
    left = own.withColumn("ca", deal(a_groups, 1)).withColumn("cr", every(r_groups))
    right = rows.withColumn("cr", deal(r_groups, 2)).withColumn("ca", every(a_groups))
    return left.groupBy("ca", "cr").cogroup(right.groupBy("ca", "cr")).applyInArrow(function, schema)


def _tiles(anchors: pa.Table, rows: pa.Table, width: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(numbers of anchors, first place, scores, whether labels agree) for all tiles of a cell, scores by Strassen."""
    a, b = matrix(anchors["v"], width), matrix(rows["v"], width)
    own, labels = anchors["label"].to_numpy(), rows["label"].to_numpy()
    step = TILE_ROWS // 4
    for i in range(0, len(a), step):
        for j in range(0, len(b), TILE_ROWS):
            scores = strassen(a[i : i + step], b[j : j + TILE_ROWS])
            yield np.arange(i, min(i + step, len(a))), j, scores, own[i : i + step, None] == labels[None, j : j + TILE_ROWS]


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """Both tables as ``usable`` makes them, ``anchors`` some of ``rows``: for every anchor and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of other labels in the positive's window.
    """
    facts = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n_rows, width = facts[0], max(facts[1] or 0, 1)
    n_anchors = anchors.count()
    cell = max(CELL_VALUES // width, LEAST_ROWS)
    groups = max(-(-n_anchors // max(cell // 8, LEAST_ROWS)), 1), max(-(-n_rows // cell), 1)

    def by_place(table: pa.Table) -> pa.Table:
        return table.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls come last

    def chosen(heaps: Heaps, left: pa.Table, right: pa.Table, slots: int = 1) -> pa.Table:
        at, rank = np.nonzero(heaps.score != NONE)
        place = pa.array(heaps.place[at, rank])
        return pa.table(
            {
                "anchor": left["row"].take(pa.array(at // slots)),
                "anchor_id": left["vec_id"].take(pa.array(at // slots)),
                "slot": pa.array((at % slots + 1).astype(np.int32)),
                "score": pa.array(heaps.score[at, rank]),
                "vec_id": right["vec_id"].take(place),
            }
        )

    def best_of_label(left: pa.Table, right: pa.Table) -> pa.Table:
        right = by_place(right)
        heaps = Heaps(len(left), positives)
        mine, theirs = left["row"].to_numpy(), right["row"].to_numpy()
        for numbers, first, scores, same in _tiles(left, right, width):
            other = mine[numbers, None] != theirs[None, first : first + scores.shape[1]]
            part = Heaps(len(numbers), positives)
            part.offer(np.where(same & other, scores, NONE), first)
            _merge_at(heaps, numbers, part)
        return chosen(heaps, left, right)

    def best_in_window(left: pa.Table, right: pa.Table) -> pa.Table:
        right = by_place(right)
        tops = np.full((len(left), positives), NONE, np.int64)
        for i, found in enumerate(left["tops"].to_pylist()):
            tops[i, : len(found)] = found
        heaps = Heaps(len(left) * positives, negatives)
        for numbers, first, scores, same in _tiles(left, right, width):
            for slot in range(positives):
                top = tops[numbers, slot][:, None]
                fits = ~same & (top != NONE) & (scores <= top) & (100 * scores >= least_percent * top)
                part = Heaps(len(numbers), negatives)
                part.offer(np.where(fits, scores, NONE), first)
                _merge_at(heaps, numbers * positives + slot, part)
        return chosen(heaps, left, right, positives)

    schema = "anchor long, anchor_id long, slot int, score long, vec_id long"
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]

    def first_over_cells(found: DataFrame, keys: list[str], most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return found.withColumn("rank", rank).where(F.col("rank") <= most)

    best = _cells(anchors, rows, groups, best_of_label, schema)
    best = settle(first_over_cells(best, ["anchor"], positives), "positives")
    listed = F.sort_array(F.collect_list(F.struct("rank", "score")))  # at most ``positives`` of them
    tops = best.groupBy(F.col("anchor").alias("row")).agg(F.transform(listed, lambda s: s["score"]).alias("tops"))
    within = _cells(anchors.join(tops, "row"), rows, groups, best_in_window, schema)
    within = first_over_cells(within, ["anchor", "slot"], negatives)
    pairs = best.select(
        "anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return within.join(pairs, ["anchor", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _merge_at(heaps: Heaps, numbers: np.ndarray, part: Heaps) -> None:
    """Merge the heaps of some queries into theirs among all."""
    held = Heaps(0, heaps.k)
    held.score, held.place = heaps.score[numbers], heaps.place[numbers]
    held.merge(part)
    heaps.score[numbers], heaps.place[numbers] = held.score, held.place


def mined(embeddings: DataFrame, moved_every: int = 7, anchor_every: int = 100, labels: int = 10) -> DataFrame:
    """``hard_negatives`` of the rows whose vec_id ``anchor_every`` divides; where ``moved_every`` divides it, the
    label is first moved on by one of ``labels``."""
    moved = F.coalesce(F.col("vec_id") % moved_every == 0, F.lit(False))
    rows = usable(embeddings)
    rows = settle(rows.withColumn("label", F.when(moved, (F.col("label") + 1) % labels).otherwise(F.col("label"))), "vectors")
    return hard_negatives(rows, rows.where(F.col("vec_id") % anchor_every == 0))
