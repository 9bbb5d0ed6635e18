"""How much of a cluster a feature program's tables ask for, from their row counts and declared types."""

from __future__ import annotations

from dataclasses import dataclass

from .schema import Schema

#: Bytes of a value of each storage type in a Spark row; texts count with an average length.
WIDTHS = {"boolean": 8, "smallint": 8, "int": 8, "bigint": 8, "long": 8, "float": 8, "double": 8, "timestamp": 8, "date": 8, "string": 32}
#: Fixed bytes of a row.
ROW = 16


@dataclass(frozen=True)
class Resources:
    shuffle_bytes: int
    shuffle_partitions: int
    executors: int
    executor_mb: int


def row_bytes(schema: Schema, table: str) -> int:
    return ROW + sum(WIDTHS[c.feature_type] for c in schema.tables[table] if not c.skip)


def estimate(schema: Schema, rows: dict[str, int], scopes: int = 1, sliced: bool = False, cores: int = 4, partition_mb: int = 128, waves: int = 4, most_executors: int | None = 1000) -> Resources:
    """Shuffle bytes (the main table once for each scope, every side once, twice where keys are sliced), partitions of about
    partition_mb, executors that work them off in so many waves (most_executors at most; None: no limit), and memory for three partitions a core
    besides 1 GB."""
    side = sum(n * row_bytes(schema, t) for t, n in rows.items() if t != schema.target)
    main = rows.get(schema.target, 0) * row_bytes(schema, schema.target) * scopes
    total = (main + side) * (2 if sliced else 1)
    partitions = max(1, -(-total // (partition_mb << 20)))
    executors = max(1, -(-partitions // (cores * waves)))
    if most_executors is not None:
        executors = min(most_executors, executors)
    return Resources(total, partitions, executors, 1024 + 3 * cores * min(partition_mb, max(1, -(-total // (partitions << 20)))))
