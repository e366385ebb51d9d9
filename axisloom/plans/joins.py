"""Joins of many cells with a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .budget import MAX_BROADCAST_BYTES

PARTITIONS_PER_SALT = 4

def join_small(cells: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``cells`` joined with an aggregate of them (unique ``keys``), without running anything.

    The engine measures the aggregate when it runs: it broadcasts it below its threshold,
    and else splits the partitions of hot keys.
    """
    return cells.join(table, keys, how)


def join_lookup(
    cells: DataFrame,
    table: DataFrame,
    keys: list[str],
    row_bytes: int = 32,
    n_rows: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """``cells`` joined with ``table`` (unique ``keys``), safe against hot keys.

    The table is broadcast when its size is known to be small: from ``n_rows``,
    or by counting it (so it should be cheap to read).  Otherwise
    both sides are shuffled with a salt: cells take theirs from the hash of
    the whole row, the table is repeated once per salt, and a key that holds
    much of the data is shared by that many tasks.  There is a salt for every
    ``PARTITIONS_PER_SALT`` partitions of the cells, as a hot key's share grows with them.
    """
    if (table.count() if n_rows is None else n_rows) * row_bytes <= MAX_BROADCAST_BYTES:
        return cells.join(F.broadcast(table), keys, how)
    n_salts = max(2, -(-cells.rdd.getNumPartitions() // PARTITIONS_PER_SALT))
    salted = cells.withColumn("_salt", F.pmod(F.xxhash64(*cells.columns), F.lit(n_salts)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1)))
    return salted.join(table.withColumn("_salt", salts), [*keys, "_salt"], how).drop("_salt")
