"""The live win model against its batch form, a fitted pipeline, late rows, resets and silence."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import features as ft
from courtside.operators import learning as ml
from courtside.shipping import ship
from courtside.streaming import win_model as wm

ROWS = "match_id long, rally_id long, frame int, player_id int, hand double, com double, torso double, elbow double, visible double, flies boolean, speed double, p1_score int, p2_score int, p1_sets int, p2_sets int, reset boolean"


def match(m, r, frames=60):
    rows, rally, score = [], 0, [0, 0]
    for f in range(1, frames):
        if r.random() < 0.12:
            rally, score[r.randrange(2)] = rally + 1, r.randrange(12)
        none = lambda v: None if r.random() < 0.1 else v
        rows.append((m, rally, f, 1 + r.randrange(2), none(r.random()), none(r.random()), none(r.uniform(-1, 1)), none(90 * r.random()), none(r.random()), r.random() < 0.7, none(20 * r.random()), *score, r.randrange(3), 1, False))
    return [*rows, (m, None, frames, *[None] * 8, *[None] * 4, False)]


def steps(rows, model):
    memory, out = wm.START, []
    for row in rows:
        memory, made = wm.win_step(memory, (row[1], *row[2:]), model)
        out.append(made)
    return out


def streamed(spark, tmp_path, batches, **more):
    """What a stream gives whose micro-batches are ``batches`` of rows, with a last one far ahead."""
    ship(spark)
    folder = tmp_path / "in"
    for i, rows in enumerate([*batches, [(-1, None, 10_000_000, *[None] * 12, False)]]):
        df = spark.createDataFrame(rows, ROWS).withColumn("ts", F.timestamp_seconds("frame"))
        df.coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    run = wm.predicted(stream, keep=["frame", "rally_id"], **more).writeStream.format("memory").queryName(f"q{random.randrange(10**9)}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(run.name)


class Mean(wm.WinModel):
    def on_point(self, vector):
        return 1 / (1 + abs(vector[0] + vector[16] / 100))


def test_vectors(spark):
    """The step's vectors are those of the batch operators, from rally features to the score."""
    r = random.Random(3)
    rows = [x for m in range(4) for x in match(m, r)]
    df = spark.createDataFrame([x for x in rows if x[1] is not None], ROWS)
    pose = df.select("match_id", "rally_id", "player_id", F.col("hand").alias("v_hand_speed"), F.col("com").alias("com_height"), F.col("torso").alias("v_torso_x"), F.col("elbow").alias("angle_elbow_dom"), F.col("visible").alias("visibility_mean"))
    eight = ft.rally_features(pose, df.filter("flies").select("match_id", "rally_id", "frame", F.col("speed").alias("speed_mps")), ["match_id", "rally_id"])
    ends = {}
    for m in range(4):
        own = [x for x in rows if x[0] == m]
        for x, after in zip(own, own[1:], strict=False):
            if after[1] != x[1]:
                ends[m, x[1]] = after[11:15] if after[1] is not None else x[11:15]
    scores = spark.createDataFrame([(*k, *v) for k, v in ends.items()], "match_id long, rally_id long, p1 int, p2 int, s1 int, s2 int")
    batch = ft.model_features(eight.join(scores, ["match_id", "rally_id"]), ["match_id"], "rally_id", ("p1", "p2"), ("s1", "s2")).orderBy("match_id", "rally_id").collect()
    live = [(m, o[0], o[1]) for m in range(4) for o in steps([x for x in rows if x[0] == m], wm.WinModel()) if o[0] is not None]
    assert [x[:2] for x in live] == [(b.match_id, b.rally_id) for b in batch]
    for (_, _, vector), b in zip(live, batch, strict=True):
        assert vector == pytest.approx([b[c] for c in ft.MODEL_FEATURES], abs=1e-9)
    assert len(ft.MODEL_FEATURES) == 19


def test_cached_chance_and_reset():
    r = random.Random(5)
    rows = match(1, r)
    out = steps(rows, Mean())
    held, ready = 0.5, False
    for o in out:
        if o[0] is not None:
            held, ready = Mean().on_point(o[1]), True
        assert o[2:] == (pytest.approx(held), pytest.approx(1 - held), pytest.approx(abs(held - 0.5) * 2), ready)
    anew = [*rows[:-1], (*match(1, random.Random(6))[0][:-1], True)]
    assert steps(anew, Mean())[-1] == (None, None, 0.5, 0.5, 0.0, False)
    assert steps(rows, wm.WinModel())[-1][2:] == (0.5, 0.5, 0.0, False)  # a model without an opinion


def test_late_rows_come_in_order(spark, tmp_path):
    """Frames that come an odd batch late give what they give in order."""
    r = random.Random(7)
    matches = {m: match(m, r, 40 + m) for m in range(5)}
    rows = [x for own in matches.values() for x in own]
    late = [x for x in rows if x[2] % 7 == 0 or x[1] is None]
    out = streamed(spark, tmp_path, [[x for x in rows if x not in late], late], model=Mean(), delay="1 hour")
    got = {(x.match_id, x.frame): tuple(x)[3:] for x in out.collect()}
    assert len(got) == len(rows)
    for m, own in matches.items():
        for x, want in zip(own, steps(own, Mean()), strict=True):
            ended, vector, *rest = got[m, x[2]]
            assert ended == want[0] and rest == pytest.approx(list(want[2:])) and (vector is None) == (want[1] is None)


def test_rows_behind_the_watermark_go(spark, tmp_path):
    r = random.Random(9)
    own = match(1, r, 300)
    early, late = own[:200], [(1, 99, 5, *own[0][3:])]
    out = streamed(spark, tmp_path, [early, own[200:250], late, own[250:]], model=Mean(), delay="20 seconds")
    frames = [x.frame for x in out.filter("match_id = 1").collect()]
    assert sorted(frames) == [x[2] for x in own]  # each frame once: the late row for frame 5 is not taken


class Handle:
    """The parts of Spark's state that a processor uses, in memory."""

    class State:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: iter(self.value) if isinstance(self.value, list) else self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

    def __init__(self):
        self.states, self.timers, self.mark = {}, [], 0

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Handle.State())

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.mark

    def getExpiryTimeInMs(self):
        return self.mark


def test_silence_forgets_a_match(spark):
    """Rows wait for the watermark; when a match has been silent, no state is left; a later row begins anew."""
    import pandas as pd

    names = [c.split()[0] for c in ROWS.split(", ")]
    run = wm.WinPredictor("match_id", "ts", ["frame"], wm.COLUMNS, ["frame"], wm.START, wm._step(Mean(), 11), [c.split()[0] for c in wm.OUTPUTS.split(", ")], silence=60_000)
    handle = Handle()
    run.init(handle)
    rows = pd.DataFrame(match(1, random.Random(2), 30), columns=names).assign(ts=lambda x: pd.to_datetime(x["frame"], unit="s"))
    assert len(next(run.handleInputRows((1,), iter([rows]), handle))) == 0 and handle.timers == [30_000]
    handle.mark = 12_000
    assert next(run.handleExpiredTimer((1,), handle, handle))["frame"].tolist() == list(range(1, 13))
    handle.mark = 30_000
    out = next(run.handleExpiredTimer((1,), handle, handle))
    assert out["frame"].tolist() == list(range(13, 31)) and out["model_ready"].iloc[-1] and 90_000 in handle.timers
    handle.mark = 80_000
    next(run.handleExpiredTimer((1,), handle, handle))
    assert handle.states["result"].exists()
    handle.mark = 90_000
    next(run.handleExpiredTimer((1,), handle, handle))
    assert not any(s.exists() for s in handle.states.values())
    again = rows.head(1).assign(ts=pd.Timestamp(85, unit="s"))
    assert not next(run.handleInputRows((1,), iter([again]), handle))["model_ready"].iloc[0]


def test_rows_that_wait_are_few_values_of_state(spark):
    """Each value is a call to another process, so waiting rows go together; a later batch's row takes its place among them."""
    import pandas as pd

    names = [c.split()[0] for c in ROWS.split(", ")]
    run = wm.WinPredictor("match_id", "ts", ["frame"], wm.COLUMNS, ["frame"], wm.START, wm._step(Mean(), 11), [c.split()[0] for c in wm.OUTPUTS.split(", ")])
    handle = Handle()
    run.init(handle)
    rows = pd.DataFrame(match(1, random.Random(3), 30), columns=names).assign(ts=lambda x: pd.to_datetime(x["frame"], unit="s"))
    assert len(next(run.handleInputRows((1,), iter([rows[rows["frame"] % 2 == 1]]), handle))) == 0
    assert len(handle.states["waiting"].value) == 1
    handle.mark = 30_000
    out = next(run.handleInputRows((1,), iter([rows[rows["frame"] % 2 == 0]]), handle))
    assert out["frame"].tolist() == list(range(1, 31)) and not handle.states["waiting"].exists()
    want = steps([tuple(r) for r in match(1, random.Random(3), 30)], Mean())
    assert out["player1_win_prob"].tolist() == pytest.approx([w[2] for w in want])


def test_fitted_pipeline(spark):
    """The numbers of a fitted pipeline give its probabilities."""
    r = random.Random(1)
    vectors = [[r.uniform(-5, 5) for _ in range(18)] + [3.0] for _ in range(80)]
    df = spark.createDataFrame([(*v, int(v[0] + v[1] + r.uniform(-4, 4) > 0)) for v in vectors], ", ".join(f"{c} double" for c in ft.MODEL_FEATURES) + ", label int")
    model = ml.logistic(ft.MODEL_FEATURES, rows=80).fit(df)
    want = [x.probability_of for x in ml.scored(model, df).collect()]
    live = wm.Linear.of(model)
    assert [live.on_point(v) for v in vectors] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        wm.Linear.of(ml.logistic(["hand_speed_diff"]).fit(df))

