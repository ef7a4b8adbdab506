"""Rewriting many small files as fewer large ones."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.counts import row_count
from tarnlake.functions.fingerprint import row_hash, spread_hash
from tarnlake.operators.compare import compare_groups
from tarnlake.operators.files import FOLDERS_AT_ONCE, folder_facts
from tarnlake.session import ADAPTIVE, under
from tarnlake.sources.catalog import partition_columns, partition_folders, table_facts
from tarnlake.sources.notes import notes_in, read_note, write_note
from tarnlake.sources.partitions import Values, change_partitions, finish_pending, in_partitions, written_partitions
from tarnlake.sources.scratch import remove_folder
from tarnlake.sources.tables import read_files, write_files

TARGET_BYTES = 512 << 20
# A task keeps a file open for each of its pieces, eight at most, instead of sorting its rows by them.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.optimizer.plannedWrite.enabled": "false"}


def file_inventory(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """files, bytes and rows per partition of a stored table, from file names and footers; no column is read.

    One aggregate: rows per file first, then files per partition. Files without rows are not seen.
    """
    keys = [F.col(f"`{c}`") for c in by]
    files = df.groupBy(*keys, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    measures = [F.count("*").alias("files"), F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes")]
    counted = files.agg(row_count().alias("_rows"))
    return counted.groupBy(*keys).agg(*measures, F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"))


def compact(df: DataFrame, path: str, by: Sequence[str] = (), target_bytes: int = TARGET_BYTES) -> None:
    """Write the rows of ``df`` to a new path in files of about ``target_bytes`` of shuffled data.

    A partition above the target is split over several tasks, so no task holds a whole hot one.
    """
    sizing = ADAPTIVE | {"spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_bytes}b"}
    with under(df, sizing) as own:
        write_files(own if by else own.hint("rebalance"), path, partition_by=by)


def compact_partitions(
    spark: SparkSession, table: str, target_bytes: int = TARGET_BYTES, at_once: int = FOLDERS_AT_ONCE
) -> DataFrame:
    """Compact the partitions of a Parquet table that have more files than their bytes need.

    Partitions come from the catalog and are worked through ``at_once`` at a time: their folders are listed, those to
    compact are written anew in as many files as their bytes make targets, one at least, to a new folder, compared
    with the old rows, and then pointed at their new files, so readers see either the old files or the new. Old
    files stay. Nothing may write to the table meanwhile. Files that one compaction to the same target wrote are
    never rewritten, whatever they compressed to; once something is added, the partition is looked at again.

    After each batch but the last a note in the table's folder says which partitions are done. A run that is
    stopped is continued by the next one to the same target: it finishes the changes of partitions that were under way,
    passes over what is noted, and returns the whole. Returns folder, partition columns, files, bytes of
    the partitions that were rewritten, as they were before.
    """
    keys = partition_columns(spark, table)
    if not keys:
        raise ValueError(f"{table} is not partitioned; use compact")
    finish_pending(spark, table)
    ledger = f"{table_facts(spark, table)['Location']}/_compaction-{target_bytes}"
    finished = [read_note(spark, path) for path in notes_in(spark, ledger)]
    seen = {tuple(texts) for note in finished for texts in note["seen"]}
    done = [row for note in finished for row in note["rewritten"]]
    texts_of = lambda values: [values[k] for k in keys]
    left = [(v, f) for v, f in partition_folders(spark, table) if tuple(texts_of(v)) not in seen]
    for at in range(0, len(left), at_once):
        batch = left[at : at + at_once]
        rewritten = _compact_batch(spark, table, keys, batch, target_bytes)
        done += rewritten
        if at + at_once < len(left):
            note = {"seen": [texts_of(values) for values, _ in batch], "rewritten": rewritten}
            write_note(spark, f"{ledger}/batch-{len(finished):06}.json", note)
            finished.append(note)
    if finished:
        remove_folder(spark, ledger)
    schema = spark.table(table).schema
    texts = T.StructType([T.StructField(c, T.StringType()) for c in ("folder", *keys)])
    found = spark.createDataFrame(done, texts.add("files", T.LongType()).add("bytes", T.LongType()))
    typed = [F.col(f"`{k}`").cast(schema[k].dataType).alias(k) for k in keys]
    return found.select("folder", *typed, "files", "bytes")


def _compact_batch(
    spark: SparkSession, table: str, keys: list[str], batch: Sequence[tuple[Values, str]], target_bytes: int
) -> list[list]:
    """Compact those of a few partitions that need it; folder, values, files and bytes of each before."""
    mark = f"-compact-{target_bytes}-"
    facts = {"files": F.count("*"), "bytes": F.sum("length"), "jobs": F.count_distinct("job")}
    small = []
    for values, folder, found in folder_facts(spark, batch, facts, len(batch)):
        pieces = max(found["bytes"] // target_bytes, 1)
        made_here = mark in folder and found["jobs"] == 1
        if found["files"] > pieces and not made_here:
            small.append((values, folder, pieces, found["files"], found["bytes"]))
    if not small:
        return []
    data = spark.table(table)
    folder = f"{table_facts(spark, table)['Location']}{mark}{uuid4().hex[:12]}"
    specs = [values for values, *_ in small]
    old = in_partitions(data, specs, keys)
    sizes = spark.createDataFrame(
        [(*(values[k] for k in keys), pieces) for values, _, pieces, *_ in small],
        T.StructType([T.StructField(f"_k{i}", T.StringType()) for i in range(len(keys))]).add("_pieces", T.LongType()),
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}").cast(data.schema[k].dataType))

    def prints(df: DataFrame) -> list:
        parts = spread_hash(row_hash(df, data.columns))
        return [row_count().alias("rows"), *[F.sum(p).alias(f"h{i}") for i, p in enumerate(parts)]]

    with under(old, ADAPTIVE | OPEN_FILES) as own:
        # The old rows are fingerprinted as they are read for the new files, and dealt to the pieces of their
        # partition; a task writes one file for each piece it gets. ``sizes`` has a row a partition of the batch.
        read = Observation()
        observed = own.observe(read, *prints(own))
        sizes = own.sparkSession.createDataFrame(sizes.collect(), sizes.schema)
        dealt = observed.join(F.broadcast(sizes), same).withColumn("_piece", F.monotonically_increasing_id() % F.col("_pieces"))
        spread = dealt.repartition(*[F.col(f"`{k}`") for k in keys], "_piece").select(*[f"`{c}`" for c in data.columns])
        spread.write.option("compression", "snappy").partitionBy(*keys).parquet(folder)
        before = read.get
    new = read_files(spark, folder, data.schema)
    if new.agg(*prints(new)).first().asDict() != before:
        # A task that ran again is observed twice, so only a comparison partition by partition decides.
        rest = [c for c in data.columns if c not in keys]
        if not compare_groups(old, new, keys, rest).filter(~F.col("same")).isEmpty():
            raise RuntimeError(f"compacted files in {folder} differ from {table}; the table is unchanged")
    moved = written_partitions(spark, folder, len(keys))
    change_partitions(spark, table, moved)
    names = {frozenset(values.items()): place.removeprefix(f"{folder}/") for values, place in moved}
    # A partition whose files hold no rows has nothing to be written anew and stays as it is.
    kept = [(names.get(frozenset(v.items())), v, files, size) for v, _, _, files, size in small]
    return [[name, *[v[k] for k in keys], files, size] for name, v, files, size in kept if name is not None]
