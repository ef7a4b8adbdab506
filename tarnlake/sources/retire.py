"""Deleting the folders of old loads and compactions that nothing points at any more."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import SparkSession

from tarnlake.sources.catalog import partition_columns, partition_folders, table_facts
from tarnlake.sources.notes import read_note
from tarnlake.sources.tables import MANIFEST

DAY = 24 * 3600
_MADE_HERE = re.compile(r"^(_?load-[0-9a-f]{12}|.+-compact-\d+-[0-9a-f]{12})$")


def _plain(path: str) -> str:
    return re.sub(r"^[a-z0-9]+:/*", "/", unquote(path)).rstrip("/")


def retire_folders(spark: SparkSession, root: str, tables: Sequence[str], older_than: float = 7 * DAY) -> list[str]:
    """Delete folders directly under ``root`` that a load or a compaction made and no table uses; returns them.

    ``tables`` are all tables with files under ``root``. A folder stays if it holds the location of one of them or of
    one of its partitions, if a published set's manifest in ``root`` names it, or if it was changed within the last
    ``older_than`` seconds, which have to cover the longest reader. Only the catalog is asked and only ``root``
    itself is listed.
    """
    used = set()
    for table in tables:
        used.add(_plain(table_facts(spark, table)["Location"]))
        if partition_columns(spark, table):
            used |= {_plain(folder) for _, folder in partition_folders(spark, table)}
    if (manifest := read_note(spark, f"{root}/{MANIFEST}")) is not None:
        used.add(_plain(f"{root}/{manifest['current']}"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    retired = []
    for status in files.listStatus(path):
        folder = status.getPath()
        place = _plain(folder.toString())
        young = status.getModificationTime() / 1000 > time.time() - older_than
        held = any(f"{name}/".startswith(f"{place}/") for name in used)
        if status.isDirectory() and _MADE_HERE.match(folder.getName()) and not young and not held:
            files.delete(folder, True)
            retired.append(place)
    return retired
