"""Weighted means and covariances of vectors in one scan, from states that merge.

A state is the count, the weight, a reference vector and the weighted sums of deviations from it and of their products. Taking the
reference from the data keeps the sums small, so a large common mean does not cancel; a state is moved to another
reference by algebra alone, without a division, so weights may be zero or sum to zero on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64  # states of one key are merged in so many places first
GROUPS = 10_000  # keys whose states a task holds at once

State = tuple  # (n, w, ref, s, ss)


def state_of(x: np.ndarray, w: np.ndarray) -> State:
    """State of the rows of ``x``."""
    ref = x.mean(axis=0)
    d = x - ref
    return len(x), float(w.sum()), ref, w @ d, (d * w[:, None]).T @ d


def merged(a: State, b: State) -> State:
    """``b`` moved to the reference of ``a``, and added."""
    d = b[2] - a[2]
    moved = b[4] + np.outer(b[3], d) + np.outer(d, b[3]) + b[1] * np.outer(d, d)
    return a[0] + b[0], a[1] + b[1], a[2], a[3] + b[3] + b[1] * d, a[4] + moved


def finished(state: State) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, population covariance); None with fewer than two rows or no positive weight."""
    n, w, ref, s, ss = state
    if n < 2 or not w > 0:
        return None
    return ref + s / w, (ss - np.outer(s, s) / w) / w


def _groups(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows of a batch by the values of its first ``keys`` columns."""
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(keys))) if keys else [()] * batch.num_rows):
        rows.setdefault(key, []).append(i)
    return ((key, np.array(at)) for key, at in rows.items())


def _emit(states: dict[tuple, State], types: list[pa.DataType]) -> pa.RecordBatch:
    found = list(states)
    doubles = pa.list_(pa.float64())
    columns = [pa.array([key[k] for key in found], t) for k, t in enumerate(types)]
    columns += [pa.array([states[k][0] for k in found], pa.int64()), pa.array([states[k][1] for k in found], pa.float64())]
    columns += [pa.array([np.ravel(states[k][f]).tolist() for k in found], doubles) for f in (2, 3, 4)]
    return pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(len(types))), "n", "w", "ref", "s", "ss"])


def _partial(keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, State] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in range(keys)]
            weight = batch.column(keys).to_numpy(zero_copy_only=False)
            for key, at in _groups(batch, keys):
                x = np.array(batch.column(keys + 1).take(pa.array(at)).to_pylist(), float)
                one = state_of(x, weight[at])
                states[key] = merged(states[key], one) if key in states else one
            if len(states) > GROUPS:
                yield _emit(states, types)
                states = {}
        if states:
            yield _emit(states, types)

    return run


def _merge(keys: int):
    def run(table: pa.Table) -> pa.Table:
        key = tuple(table.column(k)[0].as_py() for k in range(keys))
        total = None
        for r in table.select(["n", "w", "ref", "s", "ss"]).to_pylist():
            one = r["n"], r["w"], *(np.array(r[f]) for f in ("ref", "s")), np.array(r["ss"]).reshape(len(r["s"]), -1)
            total = one if total is None else merged(total, one)
        return pa.Table.from_batches([_emit({key: total}, [table.schema.field(k).type for k in range(keys)])])

    return run


def co_moments(rows: DataFrame, values: str, weight: str, keys=()) -> DataFrame:
    """(keys.., n, weight, mean, cov): weighted mean and population covariance of the vectors ``values`` of each group;
    ``cov`` holds the upper triangle by rows. Both are null with fewer than two rows or no positive weight.

    One scan: a task sends one state a group, and states of a group are merged in up to ``BUCKETS`` places and then in one. Rows without
    a vector do not count; a null weight is 0. Vectors of a group have one length. Without rows there are no groups.
    """
    keys = list(keys)
    source = rows.where(F.col(values).isNotNull()).select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), F.col(values).cast("array<double>").alias("v"))
    names = [f"k{i}" for i in range(len(keys))]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(source.schema[k] for k in names), T.StructField("n", T.LongType()), T.StructField("w", T.DoubleType()), *(T.StructField(f, doubles) for f in ("ref", "s", "ss"))])
    states = source.mapInArrow(_partial(len(keys)), schema).withColumn("_b", F.pmod(F.spark_partition_id(), F.lit(BUCKETS)))
    for by in ([*names, "_b"], names):
        states = states.groupBy(*by).applyInArrow(_merge(len(keys)), schema)
        if by is not names:
            states = states.withColumn("_b", F.lit(0))
    usable = (F.col("n") >= 2) & (F.col("w") > 0)
    mean = F.zip_with("ref", "s", lambda r, s: r + s / F.col("w"))
    size = F.size("s")
    cov = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 1, size), lambda b, j: (F.get("ss", i * size + i + j) - a * b / F.col("w")) / F.col("w"))))
    return states.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "n", F.col("w").alias("weight"), F.when(usable, mean).alias("mean"), F.when(usable, cov).alias("cov"))
