"""The live win model: every point extends a match's history, is scored once, and its chance holds until the next point."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from courtside.operators.features import MODEL_FEATURES, RALLY_FEATURES
from courtside.operators.learning import WinModel
from courtside.streaming import ordered
from courtside.streaming import tracks as live

#: Rallies that the recent means look back on.
RECENT = 3
#: Points that a set counts for in the score features.
SET_POINTS = 11
#: What a row of the live stream holds, beside its key and time.
COLUMNS = ["rally_id", "frame", "player_id", "hand", "com", "torso", "elbow", "visible", "flies", "speed", "p1_score", "p2_score", "p1_sets", "p2_sets", "reset"]
OUTPUTS = "ended long, vector array<double>, player1_win_prob double, player2_win_prob double, confidence double, model_ready boolean"

_OPEN = live.PREDICTOR[:4]
#: Memory: the open rally's sums, rallies and sums of their features so far, the last rallies' features, the last score, the chance.
START = [_OPEN, [0, [0.0] * len(RALLY_FEATURES)], [], [0, 0, 0, 0], None]


def vector_of(history: list, recent: list, score: list, set_points: float = SET_POINTS) -> list[float]:
    """The nineteen values of MODEL_FEATURES: means over all rallies, over the last ones, the score, and the rally's number."""
    n, sums = history
    p1, p2, s1, s2 = score
    last = [sum(r[i] for r in recent) / len(recent) for i in range(len(RALLY_FEATURES))]
    return [*(s / n for s in sums), *last, float(p1 - p2 + set_points * (s1 - s2)), float(p1 + p2 + set_points * (s1 + s2)), float(n)]


def win_step(memory: list, row: tuple, model: WinModel, set_points: float = SET_POINTS) -> tuple[list, tuple]:
    """(memory, a row of COLUMNS) to (memory, a row of OUTPUTS).

    The first row of another rally, or one without a rally, ends the one that ran: its eight features join the history, the
    vector is built with that row's score (what is null there holds from before), and the model gives the chance. ``reset``
    starts a new match before its row. Null measures are skipped, as in batch.
    """
    if row[-1]:
        memory = START
    sums, history, recent, score, chance = memory
    measures, score = row[:10], [old if new is None else int(new) for old, new in zip(score, row[10:14], strict=True)]
    # a constant chance: this step only tells when a rally ends, and what it was like
    state, (ended, *values, _) = live.predict_step([*sums, 0.5], measures, lambda _: 0.5)
    vector = None
    if ended is not None:
        n, totals = history
        history, recent = [n + 1, [a + b for a, b in zip(totals, values, strict=True)]], [*recent, values][-RECENT:]
        vector = vector_of(history, recent, score, set_points)
        said = model.on_point(vector)
        chance = chance if said is None else float(said)
    p1 = 0.5 if chance is None else chance
    return [state[:4], history, recent, score, chance], (ended, vector, p1, 1 - p1, abs(p1 - 0.5) * 2, chance is not None)


class WinPredictor(ordered.InOrder):
    """``win_step`` with typed state: the open rally, the history's sums, the last rallies as a list, and the chance in force."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.rally = handle.getValueState("rally", "sums string")
        self.history = handle.getValueState("history", "n long, sums array<double>")
        self.recent = handle.getListState("recent", "features array<double>")
        self.result = handle.getValueState("result", "score array<int>, chance double")

    def recall(self) -> Any:
        import json

        result = self.result.get()
        if result is None:
            return START
        n, sums = self.history.get()
        score, chance = result
        recent = [list(r[0]) for r in self.recent.get() or []]
        return [json.loads(self.rally.get()[0]), [n, list(sums)], recent, list(score), chance]

    def remember(self, memory: list) -> None:
        import json

        rally, (n, sums), recent, score, chance = memory
        self.rally.update((json.dumps(rally),))
        self.history.update((n, sums))
        self.result.update((score, chance))
        if recent:
            self.recent.put([(r,) for r in recent])
        elif self.recent.exists():
            self.recent.clear()

    def forget(self) -> None:
        for state in (self.rally, self.history, self.recent, self.result):
            state.clear()


def predicted(stream: DataFrame, model: WinModel, *, key: str = "match_id", time: str = "ts", order: Sequence[str] = ("frame",), keep: Sequence[str] = ("frame",), set_points: float = SET_POINTS, delay: str = "10 seconds", silence: int | None = None) -> DataFrame:
    """Every row of the stream with the rally it ends, the vector scored for it, and the chance in force."""
    step = _step(model, set_points)
    return ordered.in_order(stream, key, time, order, COLUMNS, START, step, OUTPUTS, keep, delay=delay, silence=silence, processor=WinPredictor)


def _step(model: WinModel, set_points: float) -> Callable:
    return lambda memory, row: win_step(memory, row, model, set_points)


class Linear(WinModel):
    """A fitted pipeline of scaling and logistic regression, as numbers that travel to the workers."""

    def __init__(self, mean: Sequence[float], scale: Sequence[float], weights: Sequence[float], intercept: float):
        self.mean, self.scale, self.weights, self.intercept = map(np.asarray, (mean, scale, weights, intercept))

    @classmethod
    def of(cls, model: PipelineModel) -> Linear:
        """Of ``learning.logistic``, fitted on MODEL_FEATURES in their order."""
        assembler, scaler, regression = model.stages
        if list(assembler.getInputCols()) != list(MODEL_FEATURES):
            raise ValueError("the pipeline was fitted on other features")
        return cls(scaler.mean.toArray(), scaler.std.toArray(), regression.coefficients.toArray(), regression.intercept)

    def on_point(self, vector: Sequence[float]) -> float:
        from_mean = np.nan_to_num(np.asarray(vector, float)) - self.mean
        scaled = np.divide(from_mean, self.scale, out=np.zeros_like(from_mean), where=self.scale != 0)
        return float(1 / (1 + np.exp(-(scaled @ self.weights + self.intercept))))
