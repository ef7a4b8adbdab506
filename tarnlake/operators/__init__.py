"""Audits, comparison, sync and compaction: DataFrame in, DataFrame out."""

from tarnlake.operators.audit import (
    domain_audit,
    duplicate_keys,
    formula_audit,
    orphan_keys,
    orphan_rows,
    partition_inventory,
    partition_key_audit,
    row_count_audit,
    table_counts,
)
from tarnlake.operators.compaction import compact, compact_partitions, file_inventory
from tarnlake.operators.compare import sync_plan, table_diff
from tarnlake.operators.sync import sync_partitions

__all__ = [
    "compact",
    "compact_partitions",
    "domain_audit",
    "duplicate_keys",
    "file_inventory",
    "formula_audit",
    "orphan_keys",
    "orphan_rows",
    "partition_inventory",
    "partition_key_audit",
    "row_count_audit",
    "sync_partitions",
    "sync_plan",
    "table_counts",
    "table_diff",
]
