"""What files a table has, from listings of folders; no file is opened."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.sources.notes import file_system, hadoop_path
from tarnlake.sources.partitions import Values

FOLDERS_AT_ONCE = 500


def plain(path: str) -> str:
    """A folder without scheme and closing slash, so that names from the catalog and from listings agree."""
    return re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/")


def _listed(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """folder, name, length, modificationTime and the writer's job of every file in the folders."""
    reader = spark.read.format("binaryFile")
    try:
        found = reader.load(list(folders))
    except AnalysisException:  # one of them is gone
        there = [f for f in folders if file_system(spark, f).exists(hadoop_path(spark, f))]
        if not there:
            return spark.createDataFrame([], "folder string, name string, length long, modificationTime timestamp, job string")
        found = reader.load(there)
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    name = F.element_at(F.split(path, "/"), -1)
    job = F.regexp_extract(name, r"([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1)
    return found.select(
        F.regexp_replace(path, "/[^/]*$", "").alias("folder"), name.alias("name"), "length", "modificationTime", job.alias("job")
    )


def folder_facts(
    spark: SparkSession, partitions: Sequence[tuple[Values, str]], facts: dict[str, Column], at_once: int = FOLDERS_AT_ONCE
) -> Iterator[tuple[Values, str, dict]]:
    """``facts`` (aggregates over a folder's files: name, length, modificationTime, job) of every partition with files.

    A bounded number of folders is listed at a time, and of their files only the aggregates reach the driver.
    """
    for at in range(0, len(partitions), at_once):
        part = {plain(folder): (values, folder) for values, folder in partitions[at : at + at_once]}
        listed = _listed(spark, [folder for _, folder in part.values()])
        for row in listed.groupBy("folder").agg(*[c.alias(name) for name, c in facts.items()]).collect():
            yield *part[row["folder"]], row.asDict()


def marks(spark: SparkSession, partitions: Sequence[tuple[Values, str]]) -> dict[frozenset, str]:
    """For every partition with files a text that changes with their number, names, sizes and times."""
    whole = F.bit_xor(F.xxhash64("name", "length", "modificationTime"))
    mark = F.concat_ws("-", F.count("*"), F.sum("length"), F.hex(whole))
    return {
        frozenset(values.items()): f"{plain(folder)}#{facts['mark']}"
        for values, folder, facts in folder_facts(spark, partitions, {"mark": mark})
    }
