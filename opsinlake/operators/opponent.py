"""Opponent axes from scene statistics."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsinlake import constants as C
from opsinlake.functions.arrays import ragged
from opsinlake.operators import curves
from opsinlake.operators.compare import coordinate_rows, panel_rows
from opsinlake.operators.moments import co_moments
from opsinlake.plans.adaptation import common_grid, sharpen
from opsinlake.plans.kernel import CurveKernel
from opsinlake.plans.observers import Panel

NEAR = 256  # receptors of a system that a receptor meets where it lies


def contrasts_from_covariance(cov) -> list[tuple[str, list[float], float]]:
    """Principal axes by falling variance, each with its largest component positive: (name, weights, variance)."""
    cov = np.asarray(cov, dtype=float)
    n = len(cov)
    if n == 0:
        return []
    if n == 1:
        return [("Natural-scene PC1", [1.0], float(cov[0, 0]))]
    values, vectors = np.linalg.eigh(cov)
    out = []
    for k, j in enumerate(np.argsort(-values, kind="stable")):
        w = vectors[:, j]
        w = -w if w[np.abs(w).argmax()] < 0 else w
        out.append((f"Natural-scene PC{k + 1} (λ={values[j]:.4f})", [float(x) for x in w], float(values[j])))
    return out


def weighted_moments(rows: DataFrame, values: list[Column], weight: Column) -> DataFrame:
    """Weighted mean and population covariance of a few columns: the means in a first aggregate, the centred products in
    a second, so large means do not cancel.

    Only 1 + n + n(n+1)/2 partial sums per task are shuffled. Null with fewer than two rows or no positive total weight.
    """
    n = len(values)
    total = F.sum(weight)
    usable = (F.count(F.lit(1)) >= 2) & (total > 0)
    first = rows.agg(F.array(*[F.when(usable, F.sum(weight * v) / total) for v in values]).alias("m")).scalar()
    placed = rows.select(weight.alias("_w"), *[v.alias(f"_v{i}") for i, v in enumerate(values)], first.alias("_m"))
    x = [F.col(f"_v{i}") - F.col("_m")[i] for i in range(n)]
    sums = [F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.first("_m").alias("m")]
    sums += [F.sum(F.col("_w") * x[i] * x[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
    w = F.when((F.col("n") >= 2) & (F.col("w") > 0), F.col("w"))
    means = [F.when(w.isNotNull(), F.col("m")[i]).alias(f"mean{i}") for i in range(n)]
    covs = [(F.col(f"s{i}_{j}") / w).alias(f"cov{i}_{j}") for i in range(n) for j in range(i, n)]
    return placed.agg(*sums).select("n", w.alias("weight"), *means, *covs)


def corpus_covariance(corpus: DataFrame, kernel: CurveKernel, weight: Column, spectrum="spectrum") -> DataFrame:
    """Covariance of the ungated, capped receptor responses to a weighted corpus on one axis.

    ``kernel`` must be a pool-style kernel (no adaptation) with unit gains; see ``ungated``.
    """
    rows = corpus.select(weight.cast("double").alias("_w"), coordinate_rows(F.col(spectrum), [kernel]).alias("_r"))
    values = [F.col("_r")[i] for i in range(len(kernel.gains))]
    return weighted_moments(rows, values, F.col("_w"))


def ungated(kernel: CurveKernel) -> CurveKernel:
    """The same receptors without gains, adaptation and opponent rows."""
    return replace(kernel, regime=None, gains=np.ones(len(kernel.gains)), adaptation=None, opponent=None, noise=None, regime_gain=1.0)


def panel_covariance(corpus: DataFrame, panel: Panel, weight: Column, points="points", kind="quantity.kind") -> DataFrame:
    """(system, n, weight, mean, cov): covariance of the ungated, capped responses of every observer of a panel to a weighted corpus
    of curves with points of their own, reflectances lit first. One scan for all systems; ``cov`` is the upper triangle by
    rows, in the order of the observer's receptors."""
    bare = Panel(tuple(replace(o, regime=None, gains=np.ones(len(o.gains)), adaptation=None, opponent=None) for o in panel.observers), panel.light, panel.step)
    seen = corpus.select(weight.alias("_w"), panel_rows(F.col(points), F.col(kind).eqNullSafe("Reflectance"), bare).alias("_r"))
    cells, at = [], 1
    for o in bare.observers:
        cells.append(F.struct(F.lit(o.system).alias("system"), F.slice("_r", at, len(o.gains)).alias("v")))
        at += len(o.gains)
    return co_moments(seen.select("_w", F.explode(F.array(*cells)).alias("_c")).select("_w", "_c.*"), "v", "_w", ["system"])


def corpus_contrasts(corpus: DataFrame, kernel: CurveKernel, weight: Column, spectrum="spectrum") -> DataFrame:
    """Opponent contrasts of a corpus: ``name, weights, variance`` per principal axis, no row when it is too small. Lazy:
    the axes are found in a task, on the one row of the covariance aggregate."""
    n = len(kernel.gains)
    cov = corpus_covariance(corpus, kernel, weight, spectrum)
    cells = F.array(*[F.col(f"cov{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)])
    axes = T.StructType([T.StructField("name", T.StringType()), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("variance", T.DoubleType())])

    @F.arrow_udf(T.ArrayType(axes))
    def find(matrices: pa.Array) -> pa.Array:
        found = [contrasts_from_covariance(np.reshape(m, (n, n))) for m in matrices.to_pylist()]
        rows = [[{"name": a, "weights": w, "variance": v} for a, w, v in one] for one in found]
        return pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("weights", pa.list_(pa.float64())), ("variance", pa.float64())])))

    return cov.where("cov0_0 is not null").select(F.inline(find(cells)))


def smooth_covariance(receptor_curves, light, length_nm: Column, step: float) -> Column:
    """Response covariance when reflectances are smooth with correlation ``exp(-|d|/length)``, per row of lengths: a
    struct with a field ``cov<i>_<j>`` per receptor pair.

    The exponential kernel is separable, so a row needs one forward pass over the wavelength grid instead of a product
    over all wavelength pairs; the rows of a batch take that pass together.
    """
    grid = common_grid([*receptor_curves, light], step)
    t = grid[:-1] * grid[-1]
    n = len(t)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    names = [f"cov{i}_{j}" for i, j in pairs]

    @F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in names]))
    def covariance(lengths: pa.Array) -> pa.Array:
        decay = np.exp(-step / lengths.to_numpy(zero_copy_only=False).astype(float))[:, None]
        carry, total = np.zeros((len(decay), n)), np.zeros((len(decay), len(pairs)))
        for cell in t.T:
            # carry_j holds sum_{b<a} decay^(a-b) t_j[b]; a pair gains both orders of it and the diagonal term
            carry = carry * decay
            for p, (i, j) in enumerate(pairs):
                total[:, p] += cell[i] * carry[:, j] + cell[j] * carry[:, i] + cell[i] * cell[j]
            carry = carry + cell
        columns = [pa.array(step * step * total[:, p]) for p in range(len(pairs))]
        return pa.StructArray.from_arrays(columns, names=names)

    return covariance(length_nm)


def gram_pairs(samples: DataFrame, step: float, keys=("system",)) -> DataFrame:
    """Overlap of receptors on a shared grid from ``system, receptor, values`` rows: one row per pair, each receptor
    with itself included; receptors that repeat pair as often. A system that is null has no pairs.

    Rows are shuffled once, by system, and meet the next ``NEAR`` receptors of their system by order there. Only what is further
    apart, in larger systems, is dealt out by pairs of blocks, so a system may have any number of receptors: its rows are in one task,
    the pairs that grow with the square of their number are not."""
    keys = list(keys)
    known = samples.where(reduce(and_, [F.col(c).isNotNull() for c in keys]))
    # one column that is carried, sorted by and listed; a receptor without a name comes last
    one = F.struct(F.isnull("receptor").alias("unnamed"), "receptor", "values").alias("x")
    placed = known.select(*keys, one).repartition(*keys)
    in_order = Window.partitionBy(*keys).orderBy("x")
    near = placed.select(*keys, "x", F.collect_list("x").over(in_order.rowsBetween(0, NEAR - 1)).alias("_y"))
    crowded = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > NEAR)
    met = near.select(*keys, "x", F.explode("_y").alias("y")).unionByName(_far_pairs(placed, crowded, keys, in_order))
    overlap = _product(F.col("x.values"), F.col("y.values")) * step
    return met.select(*keys, F.col("x.receptor").alias("k"), F.col("y.receptor").alias("l"), overlap.alias("overlap"))


def _far_pairs(placed: DataFrame, crowded: DataFrame, keys: list[str], in_order) -> DataFrame:
    """Pairs (``x``, ``y``) of the keys in ``crowded`` (with their number of rows ``_n``) whose places in the order are ``NEAR`` or more apart:
    every row of such a key goes to each pair of blocks that its own block is in, and only there do lists of two blocks meet."""
    # the keys are a step of their own: its size is known before the join is chosen, and where it is empty nothing is left to do
    numbered = placed.join(crowded.repartition("_n"), keys).withColumn("_at", F.row_number().over(in_order) - 1)
    blocks = F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {NEAR} as int)"))
    dealt = numbered.select(*keys, F.struct("_at", "x").alias("_s"), F.expr(f"cast(_at div {NEAR} as int)").alias("_own"), F.explode(blocks).alias("_other"))
    own, other = F.col("_own"), F.col("_other")
    placed_in = dealt.where(own != other).withColumns({"_i": F.least(own, other), "_j": F.greatest(own, other)}).repartition(*keys, "_i", "_j")
    lists = placed_in.groupBy(*keys, "_i", "_j").agg(
        F.collect_list(F.when(own < other, F.col("_s"))).alias("_x"), F.collect_list(F.when(own > other, F.col("_s"))).alias("_y"))
    pairs = lists.select(*keys, F.explode("_x").alias("x"), "_y").select(*keys, "x", F.explode("_y").alias("y"))
    return pairs.where(F.col("y._at") - F.col("x._at") >= NEAR).select(*keys, F.col("x.x").alias("x"), F.col("y.x").alias("y"))


def _product(x: Column, y: Column) -> Column:
    """Scalar product of two equally long lists per row."""

    @F.arrow_udf("double")
    def product(x: pa.Array, y: pa.Array) -> pa.Array:
        size = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cells = x.flatten().to_numpy(zero_copy_only=False) * y.flatten().to_numpy(zero_copy_only=False)
        out, some = np.zeros(len(size)), np.nonzero(size)[0]
        if len(some):
            out[some] = np.add.reduceat(cells, (np.cumsum(size) - size)[some])
        return pa.array(out)

    return product(x, y)


def gram_column(values: Column, step: float) -> Column:
    """Row-major overlap matrix of a few equally sampled curves per row (``array<array<double>>``).

    The curves of a row share one grid; rows of a batch with equal counts and grids are multiplied together.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def products(rows: pa.Array) -> pa.Array:
        members = rows.flatten()
        count = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        samples = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = members.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(count) - count
        width = np.where(count > 0, samples[np.minimum(first, len(samples) - 1)], 0) if len(samples) else count * 0
        start = (np.cumsum(samples) - samples)[np.minimum(first, len(samples) - 1)] if len(samples) else count * 0
        out = np.empty(int((count**2).sum()))
        at = np.cumsum(count**2) - count**2
        for n, w in {(int(n), int(w)) for n, w in zip(count, width) if n}:
            same = np.nonzero((count == n) & (width == w))[0]
            stack = flat[start[same][:, None] + np.arange(n * w)].reshape(len(same), n, w)
            cells = step * (stack @ np.swapaxes(stack, 1, 2)).reshape(len(same), -1)
            out[at[same][:, None] + np.arange(n * n)] = cells
        return ragged(out, count**2, np.ones(len(count), dtype=bool))

    return products(values)


def sample_members(members: DataFrame, step: float = C.STEP_NM) -> DataFrame:
    """Receptors of every regime on their regime's common grid: ``system, regime, slot, values``.

    The grid runs from the lowest to the highest wavelength of the regime in fixed steps; a receptor is zero outside
    its own domain.
    """
    lo, hi = curves.domain(F.col("points"))
    span = members.groupBy("system", "regime").agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"))
    grid = curves.steps_grid(F.col("_lo"), F.col("_hi"), step)
    placed = members.select("system", "regime", "slot", "points").join(span, ["system", "regime"]).withColumn("_x", grid)
    values = curves.values_at(F.col("points"), F.col("_x"))
    return placed.select(
        "system", "regime", "slot", F.transform(values, lambda v: F.coalesce(v, F.lit(0.0))).alias("values")
    )


def sharpen_systems(members: DataFrame, step: float = C.STEP_NM) -> DataFrame:
    """Sharpening matrix of every regime of a library: ``system, regime, matrix, inverse, lambda, dominant``.

    ``members`` are the rows of ``validate.member_rows``. A regime of any size is solved; its matrix is one row.
    """
    keys = ["system", "regime"]
    packed = sample_members(members, step).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("slot", "values"))).alias("_m")
    )
    grams = packed.withColumn("_g", gram_column(F.transform("_m", lambda m: m["values"]), step))
    return grams.withColumn("_s", sharpen_column(F.col("_g"))).select(*keys, "_s.*")


def sharpen_column(grams: Column) -> Column:
    """Sharpening matrix per row of row-major Gram arrays: ``matrix, inverse, lambda, dominant``.

    Rows of one batch that have the same size are solved together.
    """

    out_type = "struct<matrix:array<double>,inverse:array<double>,lambda:double,dominant:boolean>"

    @F.arrow_udf(out_type)
    def solve(rows: pa.Array) -> pa.Array:
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        result = [None] * len(sizes)
        for size in np.unique(sizes):
            n = int(round(size**0.5))
            idx = np.nonzero(sizes == size)[0]
            stack = np.stack([flat[at[i]:at[i + 1]].reshape(n, n) for i in idx])
            for i, m, inv, lam, ok in zip(idx, *sharpen(stack)):
                result[i] = {"matrix": m.ravel().tolist(), "inverse": inv.ravel().tolist(), "lambda": float(lam),
                             "dominant": bool(ok)}
        return pa.array(result, type=pa.struct([
            ("matrix", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("lambda", pa.float64()),
            ("dominant", pa.bool_()),
        ]))

    return solve(grams)
