"""Mixing sources to target weights by apportioning equal blocks of tokens.

Every source has a target: its share, by weight, of all words, but at most ``most`` times its own words; what that
cuts off is shared out again by weight until no target is above its limit. A target is met in two parts. As many
whole passes over the source as fit are certain. The rest is taken in blocks of ``block`` words:

1. Sainte-Lague over the sources: the blocks that all rests make together go, one after the other, to the source
   with the highest quotient rest / (2 k + 1), k being what it has. Rounding rest / block to the nearest
   number is where that method stands at a divisor of one block; the few blocks too many or too few are then given or
   taken by the same quotients, so sources need no heap and never travel to one place.
2. The source's documents stand in a line in a seeded order, cut into blocks and into ``SHARDS`` shards by ranges of
   the order's hash. The source's blocks are apportioned to its shards by the same method, with the number of blocks
   that begin in a shard as weight; every quota is a whole number and none exceeds the shard's blocks.
3. A shard takes its quota evenly spaced from its blocks, from a seeded start. How many of the first k blocks that
   takes has a closed form, so a document gets its words from where it begins and ends in the line.

A block belongs to the shard it begins in; only a source's last block may be short. So what a source takes differs
from its target by less than two blocks, and a document is taken at most (whole passes + 1) times, which is
within ``most``: a source with ``most`` passes has no rest.

Distribution: words are counted where the texts are; after that only (document, source, size) travel. A source with a
third of all documents is ``SHARDS`` groups. The seeded order depends on the document alone, so reruns agree under
any partitioning.

Defined results: null and blank texts have no words, are taken 0 times and need no source; a null source is one source,
the last in order. Documents with equal doc_id stand together in the line, the shorter first; equal rows are
interchangeable. A null doc_id is an id like any other. A table without words has targets of 0; an empty one gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm import words
from tarnlake.llm.common import filled, slices
from tarnlake.sources.scratch import settle

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 8
SHARDS = 4096
SEED = 17
KEY = ["src", "nil"]  # a source without null: its name or nothing, and whether it was null


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source (as src and nil), size in words, and its place in the seeded order: shard and rank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, counts = words.word_spans(*words.buffers(filled(batch["text"])))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], pa.array(counts.astype(np.int64))], names=["doc_id", "source", "size"]
            )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    counted = columns.mapInArrow(rows, "doc_id long, source string, size long")
    rank = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull())
    return counted.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("src"),
        F.col("source").isNull().alias("nil"),
        "size",
        rank.alias("rank"),
        # the upper bits of the hash, from 0 on, so that shards are ranges of the order
        F.floor((F.shiftright(rank, 32) + (1 << 31)) * SHARDS / (1 << 32)).cast("int").alias("shard"),
    )


def ranked_sources(documents: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Each source with its words and, by its number in order of code points, its weight."""
    order = [F.asc("nil"), F.asc("src")]
    totals = documents.groupBy(*KEY).agg(F.sum("size").alias("words"))
    held = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    held = settle(held, "sources")
    parts = held.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("ahead")
    listed = held.join(parts.select("part", ahead.alias("ahead")), "part")
    every = F.array(*[F.lit(w) for w in weights])
    return settle(listed.select(*KEY, "words", F.get(every, (number % len(weights)).cast("int")).alias("weight")), "weighted-sources")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with ``target``. Every round shares what the full sources leave among the others by weight and finds
    those that become full; rounds end when none does."""
    limit = F.col("words") * most
    total = sources.agg(F.sum("words")).first()[0] or 0
    full: Column = F.lit(False)
    share, n_full = 0.0, -1
    while True:
        left, weight, n = sources.agg(
            F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if n == n_full or not weight:
            break
        n_full, share = n, (total - left) / weight
        full = F.lit(share) * F.col("weight") > limit  # shares only grow, so who is full stays so
    return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(F.lit(share) * F.col("weight")))


def source_blocks(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sainte-Lague over the sources: ``passes`` over each and its number of blocks beyond them, ``blocks``."""
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    held = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
    held = settle(held.withColumn("blocks", F.floor(F.col("rest") / block + 0.5)), "apportioned")
    rests, given = held.agg(F.sum(F.col("rest").cast("decimal(38,6)")), F.sum("blocks")).first()
    seats = int(float(rests or 0) / block + 0.5)
    while (open_seats := seats - (given or 0)) != 0:
        moved, listed = None, 4
        while moved is None or not moved.where(F.abs("moved") == listed // 4).isEmpty():
            # The next quotients of every source, or the last ones it was given for: more if one uses up what is listed.
            step = F.explode(F.sequence(F.lit(0), F.lit(listed - 1)))
            k = F.col("blocks") + F.col("step") if open_seats > 0 else F.col("blocks") - 1 - F.col("step")
            quotients = held.where("rest > 0").withColumn("step", step).withColumn("k", k).where("k >= 0")
            quotients = quotients.withColumn("quotient", F.col("rest") / (2 * F.col("k") + 1))
            order = [F.desc("quotient"), "nil", "src"] if open_seats > 0 else [F.asc("quotient"), F.desc("nil"), F.desc("src")]
            first = quotients.orderBy(*order, "step").limit(abs(open_seats))
            moved = settle(first.groupBy(*KEY).agg((F.count("*") * (1 if open_seats > 0 else -1)).alias("moved")), "moved-blocks")
            listed *= 4
        held = held.join(moved, KEY, "left").withColumn("blocks", F.col("blocks") + F.coalesce("moved", F.lit(0))).drop("moved")
        held = settle(held, "apportioned")
        before, given = given, held.agg(F.sum("blocks")).first()[0]
        if given == before:
            break  # no source has a rest
    return held


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Whole numbers that sum up to ``seats``, by highest quotients weight / (2 k + 1); ties to the earlier one."""
    weights = np.asarray(weights, np.float64)
    given = np.zeros(len(weights), np.int64)
    if not weights.sum():
        return given
    given = np.floor(weights * (seats / weights.sum()) + 0.5).astype(np.int64)
    while (open_seats := seats - int(given.sum())) > 0:
        given[np.argmax(weights / (2 * given + 1))] += 1
    while open_seats < 0:
        last = np.where(given > 0, weights / np.maximum(2 * given - 1, 1), np.inf)
        given[len(last) - 1 - np.argmin(last[::-1])] -= 1
        open_seats += 1
    return given


def shard_quotas(documents: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Every shard with the words before it in its source's line, the block that begins first in it, its number of
    blocks, its quota and start, and how often the block that reaches into it is taken."""
    shards = documents.groupBy(*KEY, "shard").agg(F.sum("size").alias("held"))
    line = Window.partitionBy(*KEY).orderBy("shard")
    before = F.coalesce(F.sum("held").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.withColumn("before", before)
    first = lambda words_before: F.ceil(words_before / block)
    shards = shards.withColumn("first", first(F.col("before"))).withColumn("n", first(F.col("before") + F.col("held")) - F.col("first"))
    wanted = sources.select(*KEY, "blocks")
    shards = settle(shards.join(wanted, KEY), "shards")  # the sources' side is the smaller one of two tables of sums

    def apportion(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")  # at most SHARDS rows
        weights = table["n"].to_numpy()
        seats = min(int(table["blocks"][0].as_py()), int(weights.sum()))
        return table.append_column("quota", pa.array(sainte_lague(weights, seats)))

    schema = "src string, nil boolean, shard int, held long, before long, first long, n long, blocks long, quota long"
    found = shards.select("src", "nil", "shard", "held", "before", "first", "n", "blocks").groupBy(*KEY).applyInArrow(apportion, schema)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "src", "nil", "shard"), F.greatest("n", F.lit(1)))
    found = found.withColumn("start", start)
    last = F.when(F.col("n") > 0, _times(F.col("n") - 1))
    reaching = F.last(last, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return settle(found.withColumn("reaching", F.coalesce(reaching, F.lit(0))).drop("held", "blocks"), "shard-quotas")


def _evenly(k: Column) -> Column:
    """How many of k blocks are taken, counted from the shard's start: floor(k * quota / n), in whole numbers."""
    return F.when(F.col("n") > 0, F.call_function("div", k * F.col("quota"), F.col("n"))).otherwise(0)


def _taken_before(k: Column) -> Column:
    """How many of the shard's first k blocks are taken; numbers run on past the last block to the first."""
    n, start = F.col("n"), F.col("start")
    round_the_end = F.col("quota") - _evenly(start) + _evenly(k + start - n)
    return F.when(k + start <= n, _evenly(k + start) - _evenly(start)).otherwise(round_the_end)


def _times(k: Column) -> Column:
    return _taken_before(k + 1) - _taken_before(k)


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    documents = settle(sized(docs, seed), "sized-documents")
    sources = source_blocks(targets(ranked_sources(documents, weights), most), block)
    quotas = shard_quotas(documents, sources, block, seed)
    line = Window.partitionBy(*KEY, "shard").orderBy("rank", "doc_id", "size")
    within = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = documents.withColumn("within", within).join(quotas, [*KEY, "shard"])
    begin = F.col("before") + F.col("within")
    end = begin + F.col("size")
    own = F.col("first") * block  # where the shard's own blocks begin

    def words_before(at: Column) -> Column:
        passed = F.greatest(at - own, F.lit(0))
        k = F.call_function("div", passed, F.lit(block))
        part = passed % block
        return _taken_before(k) * block + F.when(part > 0, _times(k) * part).otherwise(0)

    lead = F.greatest(F.least(end, own) - begin, F.lit(0)) * F.col("reaching")
    chosen = lead + words_before(end) - words_before(begin)
    totals = sources.select(*KEY, F.col("words").alias("source_size"), "target", "passes")
    return placed.join(totals, KEY).select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + chosen).cast("long").alias("taken")
    )
