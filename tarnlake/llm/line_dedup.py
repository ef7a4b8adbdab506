"""Duplicate lines across documents: range-partitioned hashes, first occurrences, keep bitmaps.

A line's key is the line without white space at both ends and with A-Z in lower case. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, except those in
the largest doc_id that holds the key.

1. Every long line becomes a row of two 64-bit hashes, the document and the line's position.
2. The rows are range-partitioned by hash *and document* and sorted by hash, falling document, position.
   A line that a third of all documents share is spread over many ranges. Each range is streamed once:
   the first rows of a key are its largest documents, and ``min_docs`` of them say all there is to say.
3. What the ranges say of a key is merged (a few rows a key) and written, and a join names the lines that go.
   Both sides of it are plain shuffles, so adaptive execution splits a hot key.
4. A document gets one compressed bitmap of the lines that stay; texts are only read again to apply it.

Defined results: a null or empty text is one empty line; a document without doc_id takes no part and
keeps its lines; rows with the same doc_id count as one document; an empty table gives no rows; columns
other than doc_id and text are not looked at, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import SPACE, carried, filled, slices, text_key, with_texts
from tarnlake.sources.scratch import settle

MIN_CHARS = 20
MIN_DOCS = 3


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys, positions, digests = [], [], [], []
            texts = filled(batch.column("text")).to_pylist()
            for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), texts):
                for position, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(line := line.strip(SPACE)) >= min_chars:
                        ids.append(doc)
                        keys.append(key)
                        positions.append(position)
                        digests.append(xxhash.xxh3_128_digest(line.encode().lower()))
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array(ids, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(positions, pa.int32()),
                ],
                names=["h1", "h2", "doc_id", "text_key", "position"],
            )

    return rows


def _first_documents(min_docs: int):
    """Of each key in a sorted range: its first ``min_docs`` different documents, as they stream by."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, seen = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, docs = (batch[c].to_numpy() for c in ("h1", "h2", "doc_id"))
            new_key = np.ones(len(docs), bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_key[0] = (h1[0], h2[0]) != key
            new_doc = new_key.copy()
            new_doc[1:] |= docs[1:] != docs[:-1]
            new_doc[0] |= docs[0] != doc
            count = np.cumsum(new_doc)
            starts = np.flatnonzero(new_key)
            before = np.zeros(len(docs), np.int64)  # documents counted before the key of this row began
            if len(starts):
                spans = np.diff(np.append(starts, len(docs)))
                before[starts[0] :] = np.repeat(count[starts] - 1, spans)
            head = starts[0] if len(starts) else len(docs)
            before[:head] = -seen
            rank = count - before
            key, doc, seen = (h1[-1], h2[-1]), docs[-1], int(rank[-1])
            take = new_doc & (rank <= min_docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[take]), pa.array(h2[take]), pa.array(docs[take])], names=["h1", "h2", "doc_id"]
            )

    return rows


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_key, position of every line that goes."""
    known = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key")).where("doc_id IS NOT NULL")
    schema = "h1 long, h2 long, doc_id long, text_key long, position int"
    # Written once: range partitioning samples its input, which would run the splitting twice.
    lines = settle(known.mapInArrow(_line_rows(min_chars), schema), "line-hashes")
    ranged = lines.select("h1", "h2", "doc_id").repartitionByRange("h1", "h2", F.desc("doc_id"))
    ranged = ranged.sortWithinPartitions("h1", "h2", F.desc("doc_id"))
    firsts = ranged.mapInArrow(_first_documents(min_docs), "h1 long, h2 long, doc_id long")
    # A key that spans ranges is seen in each; at most min_docs rows of each are merged.
    shared = (
        firsts.groupBy("h1", "h2", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    # Both sides of the join are written tables, so adaptive execution can split the rows of a hot line.
    shared = settle(shared.select("h1", "h2", "keeper"), "shared-lines")
    return lines.join(shared, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "text_key", "position")


def packed(positions: list[int]) -> bytes:
    """A compressed bitmap of the lines that stay, up to the last one that goes."""
    keep = np.ones((max(positions) // 8 + 1) * 8, bool)  # whole bytes, so that no bit is padding
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(lines: list[str], bitmap: bytes | None) -> list[str]:
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(keep) or keep[i]]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_key, n_dropped and the bitmap of every document that loses lines.

    Bits beyond the bitmap's end are lines that stay. A group is the lines of one document.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["positions"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array([len(x) for x in lists], pa.int64())]
                + [pa.array([packed(x) for x in lists], pa.binary())],
                names=["doc_id", "text_key", "n_dropped", "bitmap"],
            )

    by_doc = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_key")
    lists = by_doc.agg(F.collect_set("position").alias("positions"))
    return lists.mapInArrow(rows, "doc_id long, text_key long, n_dropped long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``docs``, ``carried``, with the bitmap of each; documents that lose nothing have none."""
    rows = carried(docs)
    found = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("text_key").alias("b_key"), "bitmap")
    match = (F.col("doc_id") == F.col("b_doc")) & (F.col("text_key") == F.col("b_key"))
    return rows.join(found, match, "left").select("row", "doc_id", "text", "bitmap")


def without_dropped_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents, all their columns as they are, with the shortened text (and n_chars, if there is one)."""
    columns = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                text if bitmap is None else "\n".join(kept_lines((text or "").split("\n"), bitmap))
                for text, bitmap in zip(batch["text"].to_pylist(), batch["bitmap"].to_pylist())
            ]
            yield with_texts(batch, texts, columns)

    return apply_bitmaps(docs, bitmaps).mapInArrow(rows, docs.schema)


def line_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, a row for every row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, drops, digests = [], [], []
            for text, bitmap in zip(filled(batch["text"]).to_pylist(), batch["bitmap"].to_pylist()):
                lines = text.split("\n")
                kept = kept_lines(lines, bitmap)
                totals.append(len(lines))
                drops.append(len(lines) - len(kept))
                digests.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(totals, pa.int64()), pa.array(drops, pa.int64()), pa.array(digests)],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    held = apply_bitmaps(docs.select(F.col("doc_id").cast("long"), "text"), bitmaps)
    return held.mapInArrow(rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
