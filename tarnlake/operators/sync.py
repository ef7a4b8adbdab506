"""Copying only the partitions that differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.counts import row_count
from tarnlake.functions.fingerprint import row_hash, spread_hash
from tarnlake.operators.files import marks
from tarnlake.sources.catalog import drop_partitions, partition_columns, partition_folders, table_facts
from tarnlake.sources.notes import read_note, write_note
from tarnlake.sources.partitions import finish_pending, in_partitions, rows_of_partitions
from tarnlake.sources.scratch import remove_folder
from tarnlake.sources.tables import replace_partitions, stored_as

__all__ = ["rows_of_partitions", "sync_partitions"]

LEDGER = "_sync.json"
Key = frozenset  # the (column, text) pairs of a partition
Print = list[int]  # rows, then the sums of the parts of their hashes


def sync_partitions(
    src: DataFrame | str,
    table: str,
    by: str | Sequence[str] | None = None,
    contents: bool = True,
    clustered: bool = False,
    drop_extra: bool = False,
    ledger: bool = True,
) -> DataFrame:
    """Bring ``table`` up to ``src``: copy missing and changed partitions, return the plan it followed.

    Whole partitions are compared and replaced, so ``by`` can only be the partition columns of the table, and
    may be left out. Partitions are compared by fingerprints: rows and sums of row hashes, of which
    ``contents=False`` takes the rows alone, counted from footers.

    A ledger in the table's folder keeps the fingerprint of each partition with a mark of the files it was taken from
    (number, names, sizes, times). The next sync lists the folders and reads only partitions whose files
    no longer fit. That goes for ``table``, and for ``src`` if it is the name of a table with the same partition columns;
    rows of another DataFrame are read each time. A ledger of other columns or another source is not used, and
    ``ledger=False`` neither reads nor writes one.

    An interrupted copy is finished by running it again. Extra partitions are reported; ``drop_extra`` removes them,
    with their files.
    """
    named = src if isinstance(src, str) else None
    spark = SparkSession.active() if named else src.sparkSession
    keys = partition_columns(spark, table)
    if by is not None and keys != ([by] if isinstance(by, str) else list(by)):
        raise ValueError(f"{table} is partitioned by {keys}; sync it by these")
    finish_pending(spark, table)
    dst = spark.table(table)
    rows = stored_as(spark.table(named) if named else src, table)
    if named and partition_columns(spark, named) != keys:
        named = None
    sides = _Ledger(spark, table, named, keys, dst.schema, contents, ledger)
    src_prints, dst_prints = sides.fingerprints(rows, dst)
    statuses = {}
    for key in src_prints.keys() | dst_prints.keys():
        here, there = src_prints.get(key), dst_prints.get(key)
        if here != there:
            status = "missing" if there is None else "extra" if here is None else "changed"
            statuses[key] = (here[0] if here else 0, there[0] if there else 0, status)
    stale = [dict(key) for key, (_, _, status) in statuses.items() if status != "extra"]
    extra = [dict(key) for key, (_, _, status) in statuses.items() if status == "extra"]
    if stale:
        replace_partitions(in_partitions(rows, stale, keys), table, clustered)
    if drop_extra and extra:
        _drop(spark, table, extra)
        dst_prints = {key: p for key, p in dst_prints.items() if key in src_prints}
    sides.note(src_prints, dst_prints | {frozenset(v.items()): src_prints[frozenset(v.items())] for v in stale}, stale)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    schema = schema.add("src_rows", T.LongType()).add("dst_rows", T.LongType()).add("status", T.StringType())
    plan = spark.createDataFrame([(*(dict(key)[k] for k in keys), *status) for key, status in statuses.items()], schema)
    typed = [F.col(f"`{k}`").cast(dst.schema[k].dataType).alias(k) for k in keys]
    return plan.select(*typed, "src_rows", "dst_rows", "status")


class _Ledger:
    """The fingerprints of both sides: those still known from the ledger, and those read anew."""

    def __init__(self, spark, table: str, named: str | None, keys: list[str], schema: T.StructType, contents: bool, used: bool):
        self.spark, self.table, self.named, self.keys = spark, table, named, keys
        self.contents, self.used = contents, contents and used
        self.values = [f.name for f in schema.fields if f.name not in keys]
        self.head = {"columns": schema.simpleString(), "source": named}
        self.marks: list[dict[Key, str] | None] = [None, None]
        self.known: list[dict[Key, Print]] = [{}, {}]
        if self.used:
            self._load()

    def _path(self) -> str:
        return f"{table_facts(self.spark, self.table)['Location']}/{LEDGER}"

    def _load(self) -> None:
        ledger = read_note(self.spark, self._path())
        fits = isinstance(ledger, dict) and ledger.get("columns") == self.head["columns"]
        for side, name in enumerate((self.named, self.table)):
            if name is None or (side and not fits):
                continue  # the table itself, which nobody else writes to, is listed once it is up to date
            held = self.marks[side] = marks(self.spark, partition_folders(self.spark, name))
            if fits and (side or ledger["source"] == name):
                of = {frozenset(zip(self.keys, texts)): (mark, found) for texts, mark, *found in ledger["partitions"][side]}
                self.known[side] = {key: of[key][1] for key, mark in held.items() if key in of and of[key][0] == mark}

    def fingerprints(self, src: DataFrame, dst: DataFrame) -> tuple[dict[Key, Print], dict[Key, Print]]:
        """Of all partitions on both sides; what has to be read is read in one job."""
        stacked = None
        for side, df in enumerate((src, dst)):
            if self.marks[side] is not None and self.known[side]:
                unread = [dict(key) for key in self.marks[side] if key not in self.known[side]]
                if not unread:
                    continue
                df = in_partitions(df, unread, self.keys)
            texts = [F.col(f"`{k}`").cast("string").alias(f"_k{i}") for i, k in enumerate(self.keys)]
            parts = spread_hash(row_hash(df, self.values)) if self.contents else []
            rows = df.select(F.lit(side).alias("_side"), *texts, *[p.alias(f"_h{i}") for i, p in enumerate(parts)])
            stacked = rows if stacked is None else stacked.union(rows)
        found: list[dict[Key, Print]] = [dict(self.known[0]), dict(self.known[1])]
        if stacked is not None:
            names = [f"_k{i}" for i in range(len(self.keys))]
            sums = [F.sum(c).alias(c) for c in stacked.columns if c.startswith("_h")]
            for row in stacked.groupBy("_side", *names).agg(row_count().alias("rows"), *sums).collect():
                key = frozenset((k, row[n]) for k, n in zip(self.keys, names))
                found[row["_side"]][key] = [row["rows"], *[row[f"_h{i}"] for i in range(len(sums))]]
        return found[0], found[1]

    def note(self, src: Mapping[Key, Print], dst: Mapping[Key, Print], copied: Sequence[Mapping]) -> None:
        """Write the ledger for the next sync; copied partitions have the source's fingerprint and new files."""
        if not self.used:
            return
        new = {frozenset(v.items()) for v in copied}
        if new or self.marks[1] is None:
            folders = partition_folders(self.spark, self.table)
            if self.marks[1] is not None:
                folders = [(v, f) for v, f in folders if frozenset(v.items()) in new]
            self.marks[1] = (self.marks[1] or {}) | marks(self.spark, folders)
        sides = []
        for held, prints in zip(self.marks, (src, dst)):
            texts = lambda key: [dict(key)[k] for k in self.keys]
            sides.append([[texts(key), held[key], *prints[key]] for key in prints if key in (held or {})])
        write_note(self.spark, self._path(), self.head | {"partitions": sides})


def _drop(spark: SparkSession, table: str, extra: Sequence[Mapping[str, str | None]]) -> None:
    """Drop the listed partitions; of an external table their files as well."""
    gone = {frozenset(v.items()) for v in extra}
    folders = [folder for values, folder in partition_folders(spark, table) if frozenset(values.items()) in gone]
    external = table_facts(spark, table)["Type"] == "EXTERNAL"
    drop_partitions(spark, table, extra)
    if external:
        for folder in folders:
            remove_folder(spark, folder)
