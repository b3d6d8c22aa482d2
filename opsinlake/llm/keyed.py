"""Joins and groups that stay bounded when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 1000  # a key with more than 1/SHARES of the rows is frequent; fewer than SHARES keys can be


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and in ``n`` how many of ``rows`` hold it.

    A key of more than 1/SHARES of the counted rows joins by broadcast, and there are fewer than SHARES such keys,
    whatever the size. All other keys join by shuffle, with at most that share of the rows in one place. Keys are not null.
    """
    total = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = F.col("n") * SHARES > F.lit(total)
    hot = F.broadcast(table.where(often))
    common = rows.join(hot, keys)
    return common.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~often), keys))


def borders(columns: list[np.ndarray]) -> np.ndarray:
    """Places where a row differs from the one before it; 0 is one of them."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a group (equal integer ``keys``) ends."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts = borders([table.column(k).to_numpy() for k in keys])
        if held and all(held[-1].column(k)[-1] == table.column(k)[0] for k in keys):
            starts = starts[1:]  # the first rows still belong to the held group
        if len(starts):
            ready = pa.concat_tables([*held, table.slice(0, starts[-1])])
            if ready.num_rows:
                yield ready
            held, table = [], table.slice(starts[-1])
        held.append(table)
    if held:
        yield pa.concat_tables(held)
