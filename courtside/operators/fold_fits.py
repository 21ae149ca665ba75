"""Logistic fits of many folds side by side: leave-one-out for any number of matches, in work that grows with the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators import joins as jn
from courtside.shared import forget, stored

#: Folds whose weights are sent to every task at once; more folds make more blocks.
FOLD_BLOCK = 4096
#: Rows that meet all folds of a block in one go.
ROW_BLOCK = 1024
#: Newton's rounds at most, and the largest step at which they end.
ROUNDS, SMALL_STEP = 60, 1e-10
#: The loss near one point is a polynomial of this degree; its gradient is off by the next derivative, which is a quarter at most.
DEGREE, NEXT_DERIVATIVE = 5, 0.25


def _sums(folds: np.ndarray, weights: np.ndarray, features: int):
    """Rows (fold number, label, features) to each fold's gradient and curvature over the rows of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, bend = np.zeros((len(folds), features + 1)), np.zeros((len(folds), (features + 1) ** 2))
        for batch in batches:
            own, label, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            x = np.column_stack([np.ones(len(own)), *columns]).astype(float)
            for at in range(0, len(own), ROW_BLOCK):
                rows = slice(at, at + ROW_BLOCK)
                p = 1 / (1 + np.exp(-(x[rows] @ weights.T)))
                taught = own[rows, None] != folds[None, :]
                slope += ((p - label[rows, None]) * taught).T @ x[rows]
                bend += (p * (1 - p) * taught).T @ (x[rows, :, None] * x[rows, None, :]).reshape(-1, bend.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(folds), *(pa.array(list(v), pa.list_(pa.float64())) for v in (slope, bend))], ["fold", "slope", "bend"])

    return run


def _powers(width: int) -> np.ndarray:
    """Exponents of all terms of degree 1 to DEGREE in ``width`` variables, one row each."""
    return np.array([[picked.count(j) for j in range(width)] for degree in range(1, DEGREE + 1) for picked in combinations_with_replacement(range(width), degree)])


def _terms(at: np.ndarray, powers: np.ndarray):
    """Rows (fold, label, features) to the terms of their loss around the weights ``at``, and the sixth power of their length last."""
    several = np.array([math.factorial(sum(p)) / math.prod(map(math.factorial, p)) for p in powers.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns))
            x = np.column_stack([np.ones(len(label)), *columns]).astype(float)
            p = 1 / (1 + np.exp(-(x @ at)))
            bend = p * (1 - p)
            series = np.column_stack([p - label, bend / 2, bend * (1 - 2 * p) / 6, bend * (1 - 6 * bend) / 24, bend * (1 - 2 * p) * (1 - 12 * bend) / 120])
            out = series[:, powers.sum(1) - 1] * several * np.prod(x[:, None, :] ** powers[None], axis=2)
            out = np.column_stack([out, (x**2).sum(1) ** 3])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["fold", "terms"])

    return run


def _solved(at: np.ndarray, whole: np.ndarray, powers: np.ndarray, ridge: np.ndarray):
    """Folds with their own terms to their weights, and whether these are within SMALL_STEP of the exact ones for sure.

    What the polynomial leaves out of the gradient is NEXT_DERIVATIVE / DEGREE! times the sum of the rows' length to the sixth
    times the distance to the fifth at most; over the least curvature, doubled, it bounds the weights' error.
    """
    width = len(at)

    def derived(terms: np.ndarray, moved: np.ndarray, by: tuple[int, ...]) -> np.ndarray:
        left, times = powers.copy(), np.ones(len(powers))
        for j in by:
            times, left = times * left[:, j], left - np.eye(width, dtype=int)[j]
        return (terms * times * np.prod(moved[:, None, :] ** np.maximum(left, 0)[None], axis=2)).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = whole[None] - np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            terms, moved = rest[:, :-1], np.zeros((batch.num_rows, width))
            with np.errstate(all="ignore"):
                for _ in range(20):
                    slope = np.stack([derived(terms, moved, (j,)) for j in range(width)], 1) + (at + moved) @ ridge
                    bend = np.stack([derived(terms, moved, (i, j)) for i in range(width) for j in range(width)], 1).reshape(-1, width, width) + ridge
                    least = np.linalg.eigvalsh(np.nan_to_num(bend))[:, 0]
                    safe = np.where((least > 0)[:, None, None], bend, np.eye(width))
                    step = np.linalg.solve(safe, slope[:, :, None])[:, :, 0]
                    moved = moved - step
                    if np.abs(step).max() < SMALL_STEP / 100:
                        break
                error = 2 * NEXT_DERIVATIVE / math.factorial(DEGREE) * rest[:, -1] * (moved**2).sum(1) ** 2.5 / least
                sure = (least > 0) & (np.abs(step).max(1) < SMALL_STEP) & (error < SMALL_STEP)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(at + moved), pa.list_(pa.float64())), pa.array(sure, pa.bool_())], ["fold", "weights", "sure"])

    return run


def _added(df: DataFrame, size_of: dict[str, int]) -> DataFrame:
    return df.groupBy("fold").agg(*(F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))).alias(c) for c, n in size_of.items()))


def fitted_folds(rows: DataFrame, fold: str, features: Sequence[str], label: str, penalty: float = 1.0, block: int = FOLD_BLOCK) -> DataFrame:
    """fold, intercept and weights: for every fold, logistic regression on the rows of all other folds.

    The loss is the sum of the rows' losses and half of ``penalty`` times the squared weights, the intercept apart. A fold whose
    other rows have one class only has no fit and no row. Rows with a null label, fold or feature take no part.

    All rows are fitted first, by Newton's method. Near that point a fold's loss is a polynomial: the sum of all rows' terms less
    those of its own, so each fold is solved in its own row, and the work grows with the rows. Folds whose error may exceed
    SMALL_STEP (large ones, or those of few rows in all, so their number is bounded) go through exact rounds over the rows, in
    blocks: each task adds up every fold's gradient and curvature, and the driver solves a small system per fold.
    """
    width, names = len(features) + 1, [f"w_{i}" for i in range(len(features))]
    known = stored(rows.select(F.col(fold).alias("f_fold"), F.col(label).cast("double").alias("f_label"), *(F.col(c).cast("double").alias(f"f_{i}") for i, c in enumerate(features))).dropna())
    counts = known.groupBy("f_fold").agg(F.count_if(F.col("f_label") == 1).alias("p"), F.count("*").alias("n"))
    whole = counts.agg(F.sum("p"), F.sum("n")).first()
    if not whole[1] or not 0 < whole[0] < whole[1]:
        kind = known.schema["f_fold"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{fold} {kind}, intercept double, weights array<double>")
    usable = counts.filter((F.lit(whole[0]) - F.col("p")).between(1, F.lit(whole[1]) - F.col("n") - 1)).select("f_fold")
    ridge, columns = np.diag([0.0] + [penalty] * (width - 1)), ["f_label", *(f"f_{i}" for i in range(width - 1))]
    at = _rounds(known.select(F.lit(1).cast("long").alias("f_no"), *columns), np.zeros(1, np.int64), ridge)[0]  # no row is of fold 0
    powers = _powers(width)
    kind = known.schema["f_fold"].dataType.simpleString()
    size = {"terms": len(powers) + 1}
    own = stored(_added(known.mapInArrow(_terms(at, powers), f"fold {kind}, terms array<double>"), size))
    total = _added(own.withColumn("fold", F.lit(1)), size).first()["terms"]
    solved = own.join(usable, F.col("fold") == F.col("f_fold"), "left_semi").mapInArrow(_solved(at, np.array(total), powers, ridge), f"fold {kind}, weights array<double>, sure boolean")
    near = stored(solved)
    forget(own)
    out = near.filter("sure").select(F.col("fold").alias(fold), F.get("weights", F.lit(0)).alias("intercept"), F.slice("weights", 2, width).alias("weights"))
    far = near.filter("NOT sure").select(F.col("fold").alias("f_fold"), F.xxhash64("fold").alias("f_no"))
    blocks = -(-far.count() // block)
    for b in range(blocks):
        held = far.filter(F.pmod("f_no", F.lit(blocks)) == b).collect()
        weights = _rounds(known.select(F.xxhash64("f_fold").alias("f_no"), *columns), np.array([r["f_no"] for r in held], np.int64), ridge) if held else []
        made = rows.sparkSession.createDataFrame([(r["f_fold"], *map(float, w)) for r, w in zip(held, weights, strict=True)], f"{fold} {kind}, intercept double, " + ", ".join(f"{n} double" for n in names))
        out = out.unionByName(made.select(fold, "intercept", F.array(*names).alias("weights")))
    forget(known)
    return out


def _rounds(numbered: DataFrame, folds: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Each fold's weights by Newton's method over the rows (f_no, f_label, features) of all others."""
    width = len(ridge)
    weights = np.zeros((len(folds), width))
    for _ in range(ROUNDS):
        sums = _added(numbered.mapInArrow(_sums(folds, weights, width - 1), "fold long, slope array<double>, bend array<double>"), {"slope": width, "bend": width**2})
        got = {r["fold"]: r for r in sums.collect()}
        slope, bend = (np.array([got[f][c] for f in folds.tolist()]) for c in ("slope", "bend"))
        step = np.linalg.solve(bend.reshape(-1, width, width) + ridge, (slope + weights @ ridge)[:, :, None])[:, :, 0]
        weights = weights - step
        if np.abs(step).max() < SMALL_STEP:
            break
    return weights


def held_out(rows: DataFrame, fold: str, features: Sequence[str], label: str, penalty: float = 1.0, block: int = FOLD_BLOCK) -> DataFrame:
    """The rows with the probability that the fit of all other folds gives them, and the class it predicts; see ``fitted_folds``.

    With one match per fold this leaves one out. Rows of folds without a fit are left out.
    """
    fits = fitted_folds(rows, fold, features, label, penalty, block)
    score = F.col("intercept")
    for i, c in enumerate(features):
        score = score + F.get("weights", F.lit(i)) * F.col(c)
    both = jn.pair_join(rows, fits, [fold]).withColumn("probability", 1 / (1 + F.exp(-score))).drop("intercept", "weights")
    return both.filter("probability is not null").withColumn("predicted", (F.col("probability") > 0.5).cast("int"))
