"""What the operators share: reading tables, and walking Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that the word and line rules name, as characters and as a regular expression.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: pa.Array) -> pa.Array:
    """Large strings without nulls; a null text is an empty one."""
    return text.cast(pa.large_string()).fill_null("")


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, a longer text alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = filled(batch.column("text"))
        sizes = pa.compute.binary_length(offsets).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += int(size)
        yield batch.slice(first)


def text_key(text: str = "text") -> Column:
    """With the document's id this names a row: rows that agree in both have the same result."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def carried(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and text_key: all columns but the text as one struct, so that no name of theirs can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))


def with_texts(batch: pa.RecordBatch, texts: list[str | None], columns: list[str]) -> pa.RecordBatch:
    """The rows of ``carried`` as they were, with other texts (and n_chars, if there is one)."""
    row = batch["row"]
    made = dict(zip([field.name for field in row.type], row.flatten()))
    made["text"] = pa.array(texts, batch["text"].type)
    if "n_chars" in made:
        counts = [None if text is None else len(text) for text in texts]
        made["n_chars"] = pa.array(counts, pa.int64()).cast(made["n_chars"].type)
    return pa.RecordBatch.from_arrays([made[c] for c in columns], names=columns)


def known_bits(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A packed bit map with the bit ``value mod bits`` set for every value of a long column.

    However many values there are, at most ``bits`` / 32768 rows of 4 KiB reach the driver. Tasks use it to
    skip most of what a later, exact join would not match; it never decides a result.
    """
    bit = F.pmod(F.col(column), F.lit(bits)) + 1  # the functions below count from 1
    maps = values.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
    known = np.zeros(bits // 8, np.uint8)
    for row in maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("held")).collect():
        held = np.frombuffer(bytes(row["held"]), np.uint8)
        at = (row["bucket"] - 1) * len(held)
        known[at : at + len(held)] = held
    return known


def unpacked(known: np.ndarray) -> np.ndarray:
    return np.unpackbits(known, bitorder="little").astype(bool)


def hashed_sample(ids: DataFrame, column: str, most: int, total: int) -> DataFrame:
    """At most ``most`` of the ids, about ``total`` in number and each once: those with the smallest hashes.

    A threshold on the hash leaves somewhat more than ``most`` rows before they are sorted, so no task and no
    driver gets all of them.
    """
    steps = 1 << 30
    rank = F.pmod(F.xxhash64(F.col(column)), F.lit(steps))
    if total > most:
        ids = ids.where(rank < int(steps * min(1.0, 1.25 * (most + 100) / total)))
    return ids.orderBy(rank, column).limit(most)
