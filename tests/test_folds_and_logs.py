"""Fits of many folds against one fit after the other, stratified folds against the usual rule, and logs that a replay can't double."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import fold_fits as ff
from courtside.operators import ranking as rk
from courtside.shipping import ship
from courtside.sources import files


def one_fit(x, y, penalty):
    """Newton's method on one set of rows."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + ridge @ w).max() < 1e-8
    return w


@pytest.mark.parametrize("block", [ff.FOLD_BLOCK, 4])
def test_leave_one_out_equals_the_loop(spark, block):
    ship(spark)
    r = random.Random(3)
    rows = [(f"m{i}", r.random(), r.random(), int(r.random() < 0.5)) for i in range(10)]
    df = spark.createDataFrame([*rows, ("null", None, 0.5, 1), (None, 0.1, 0.2, 0)], "match string, live double, career double, label int").repartition(3)
    got = {x.match: x for x in ff.held_out(df, "match", ["live", "career"], "label", block=block).collect()}
    assert got.keys() == {m for m, *_ in rows}
    for i, (m, live, career, label) in enumerate(rows):
        others = rows[:i] + rows[i + 1 :]
        w = one_fit(np.array([x[1:3] for x in others]), np.array([x[3] for x in others]), 1.0)
        p = 1 / (1 + np.exp(-(w[0] + w[1] * live + w[2] * career)))
        assert got[m].probability == pytest.approx(p, abs=1e-9) and got[m].predicted == int(p > 0.5) and got[m].label == label


def test_folds_without_two_classes_have_no_fit(spark):
    ship(spark)
    df = spark.createDataFrame([(1, 0.1, 1), (1, 0.2, 0), (2, 0.3, 1), (3, 0.4, 1)], "fold int, x double, label int")
    assert {r.fold for r in ff.fitted_folds(df, "fold", ["x"], "label").collect()} == {2, 3}  # without fold 1 only one class is left
    assert ff.held_out(df.limit(0), "fold", ["x"], "label").count() == 0


def usual_rule(groups, folds):
    """Groups one by one, in falling deviation of their class counts, to the fold that keeps the shares' mean deviation least."""
    total = [sum(g[c] for g in groups.values()) for c in (0, 1)]
    held, out = [[0, 0] for _ in range(folds)], {}
    for name, counts in sorted(groups.items(), key=lambda g: -statistics.pstdev(g[1])):
        best = None
        for i in range(folds):
            trial = [[h[c] + (counts[c] if j == i else 0) for c in (0, 1)] for j, h in enumerate(held)]
            score = (round(statistics.fmean(statistics.pstdev(t[c] / total[c] for t in trial) for c in (0, 1)), 12), sum(held[i]))
            best = min(best or (score, i), (score, i))
        out[name] = best[1]
        held[best[1]] = [held[best[1]][c] + counts[c] for c in (0, 1)]
    return out


def deviation(groups, fold_of, folds):
    total = [sum(g[c] for g in groups.values()) for c in (0, 1)]
    held = [[sum(g[c] for n, g in groups.items() if fold_of[n] == i) for c in (0, 1)] for i in range(folds)]
    return max(abs(h[c] / total[c] - 1 / folds) for h in held for c in (0, 1))


@pytest.mark.parametrize("seed", range(3))
def test_stratified_folds(spark, seed):
    """Whole groups, classes as even as by the usual rule, also with groups of very different sizes."""
    r = random.Random(seed)
    groups = {g: (r.choice([0, 1, 2, 5, 30 if seed == 2 else 6]), r.choice([1, 2, 3])) for g in range(80)}
    rows = [(g, label) for g, counts in groups.items() for label in (0, 1) for _ in range(counts[label])]
    out = rk.stratified_folds(spark.createDataFrame(rows, "g int, label int"), "g", "label", 4).collect()
    assert {x.g: (x.n_rows - x.n_positive, x.n_positive) for x in out} == groups and len(out) == len(groups)
    fold_of = {x.g: x.fold for x in out}
    assert set(fold_of.values()) == {0, 1, 2, 3}
    assert deviation(groups, fold_of, 4) <= deviation(groups, usual_rule(groups, 4), 4) + 1e-9


def test_large_kinds_are_dealt_alike():
    """Many equal groups cost no more than a few, and come out even."""
    quotas = rk.dealt([(3, 3, 1), (2, 1, 10_000_001), (1, 0, 5)], 3)
    assert sum(quotas[1]) == 10_000_001 and max(quotas[1]) - min(quotas[1]) <= 3 and [sum(q) for q in quotas] == [1, 10_000_001, 5]


def test_logs_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 3, "a"), (2, 0.5, 3, "b")], "match_id long, timestamp_sec double, frame long, score string")
    shape = "match_id long, timestamp_sec double, frame long, score string"
    for kind in ("parquet", "csv"):
        path = f"{tmp_path}/{kind}"
        assert files.write_once(df, 0, path, kind) and files.write_once(df.filter("match_id = 2"), 1, path, kind)
        assert not files.write_once(df, 1, path, kind)  # a replay, also with other rows
        got = Counter((r.match_id, r.score) for r in files.read_once(spark, path, shape, kind).collect())
        assert got == {(1, "a"): 1, (2, "b"): 2}
    files.write_logs(df, f"{tmp_path}/run", run="r1")
    files.write_logs(df, f"{tmp_path}/run", run="r1")
    files.write_score_log(df, f"{tmp_path}/scores", run="r1")
    files.write_score_log(df, f"{tmp_path}/scores", run="r1")
    assert files.read_once(spark, f"{tmp_path}/run", shape).count() == files.read_once(spark, f"{tmp_path}/scores", shape, "csv").count() == 2


def test_a_stream_that_fails_after_its_commit(spark, tmp_path, monkeypatch):
    """The sink commits a batch and the query dies before Spark notes it: the batch runs again and adds nothing."""
    schema = "match_id long, frame long"
    for i in range(3):
        spark.range(10).select(F.lit(i).cast("long").alias("match_id"), F.col("id").alias("frame")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    write, came = files.write_once, []

    def dies(batch, batch_id, path, kind="parquet"):
        new = write(batch, batch_id, path, kind)
        came.append((batch_id, new))
        if came == [(0, True), (1, True)]:
            raise RuntimeError("lost after the commit")
        return new

    monkeypatch.setattr(files, "write_once", dies)
    with pytest.raises(Exception, match="lost after the commit"):
        files.stream_logs(stream(), f"{tmp_path}/log", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    files.stream_logs(stream(), f"{tmp_path}/log", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert came == [(0, True), (1, True), (1, False), (2, True)]
    assert files.read_once(spark, f"{tmp_path}/log", schema).count() == 30
