"""Small JSON notes next to the data, each replaced in one rename: what is pending, what is current, what is done.

A note's name begins with an underscore, so readers of the folder it lies in do not take it for data.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path; the local one without its checksum files, which a rename could not replace as well."""
    files = hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getRawFileSystem() if files.getUri().getScheme() == "file" else files


def write_note(spark: SparkSession, path: str, value: object) -> None:
    """Readers see the old note or the new one, never none and never a part of one."""
    files = file_system(spark, path)
    fresh = files.makeQualified(hadoop_path(spark, f"{path}.{uuid4().hex[:12]}"))
    target = files.makeQualified(hadoop_path(spark, path))
    out = files.create(fresh)
    out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    out.close()
    if (files.getUri().getScheme() == "file" or not files.exists(target)) and files.rename(fresh, target):
        return  # a local rename replaces the old file in one step
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark._sc._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, target, overwrite)


def read_note(spark: SparkSession, path: str) -> object | None:
    """The note's value, or None where there is no note."""
    files, place = file_system(spark, path), hadoop_path(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def notes_in(spark: SparkSession, folder: str) -> list[str]:
    """The paths of the notes in a folder, in order of their names."""
    files, place = file_system(spark, folder), hadoop_path(spark, folder)
    if not files.exists(place):
        return []
    return sorted(f"{folder}/{s.getPath().getName()}" for s in files.listStatus(place) if s.getPath().getName().endswith(".json"))


def remove_note(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(hadoop_path(spark, path), False)
