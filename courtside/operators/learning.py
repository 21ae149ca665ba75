"""Model pipelines on Spark ML: training, scoring, evaluation, comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators import metrics as mt
from courtside.shared import shared_dir, stored


def logistic(features: Sequence[str], label: str = "label", rows: int | None = None) -> Pipeline:
    """Scaled logistic regression; ``rows`` sets the penalty of one over the number of training rows."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, maxIter=1000, regParam=1 / rows if rows else 0.0, standardization=False),
    ])


def boosted(features: Sequence[str], label: str = "label", *, trees: int = 200, depth: int = 5, step: float = 0.05, seed: int = 42) -> Pipeline:
    """Gradient-boosted trees on 0.8 of the rows per tree and 0.8 of the columns per node."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
    ])


def scored(model: PipelineModel, df: DataFrame, state: int = 1, name: str = "probability_of") -> DataFrame:
    """Adds the probability of a class, and the predicted class."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[state])
    return out.withColumn("predicted", F.col("prediction").cast("int")).select(*df.columns, name, "predicted")


def evaluate(df: DataFrame, label: str, model: str) -> DataFrame:
    return mt.binary_metrics(df.withColumn("model", F.lit(model)), ["model"], label, "predicted")


def compare(train: DataFrame, test: DataFrame, pipelines: dict[str, Pipeline], label: str = "label") -> DataFrame:
    """One row of metrics per model. Fits and metrics pass over the rows many times, so both sides are stored first."""
    return _compared(stored(train), stored(test), pipelines, label)


def _compared(train: DataFrame, test: DataFrame, pipelines: dict[str, Pipeline], label: str) -> DataFrame:
    out, context = None, train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # boosting cuts its lineage there; that of 200 trees overflows the stack
        context.setCheckpointDir(shared_dir(train.sparkSession))
    for name, pipeline in pipelines.items():
        row = evaluate(scored(pipeline.fit(train), test), label, name)
        out = row if out is None else out.unionByName(row)
    return out


def folds(df: DataFrame, fold: str, pipelines: dict[str, Pipeline], label: str = "label") -> DataFrame:
    """Metrics per fold and model; a fold is skipped if either side of it has one class only. Folds are few, by design."""
    df = stored(df)
    counts = df.groupBy(fold).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).collect()
    whole_p, whole_n, out = sum(c["p"] for c in counts), sum(c["n"] for c in counts), None
    for c in counts:
        if not (c["p"] and c["n"] and whole_p - c["p"] and whole_n - c["n"]):
            continue
        rows = _compared(df.filter(F.col(fold) != c[fold]), df.filter(F.col(fold) == c[fold]), pipelines, label).withColumn(fold, F.lit(c[fold]))
        out = rows if out is None else out.unionByName(rows)
    return out


def meta(live: str, career: str, label: str = "label") -> Pipeline:
    """The meta model: logistic regression on a live and a career probability. ``folds`` by match leaves one out."""
    return logistic([live, career], label)


def save(model: PipelineModel, path: str) -> None:
    """A fitted model as an artefact in a shared folder, over one that is there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def even_chances(df: DataFrame) -> DataFrame:
    """What the default model says of every row: even chances, not reliable."""
    return df.withColumns({"p1": F.lit(0.5), "p2": F.lit(0.5), "confidence": F.lit(0.0), "reliable": F.lit(False)})


class WinModel:
    """What a user supplies for live prediction. ``predict`` sees packets, a batch of frames at a time, without memory; ``on_point``
    sees the features of a match after each of its points, and its chance holds until the next one.

    A match is reset by a row of the live stream that says so, or by silence (``streaming.win_model``).
    """

    def predict(self, packets):
        """p1, p2, confidence and reliable beside the packets. Default: even chances, not reliable."""
        return packets.assign(p1=0.5, p2=0.5, confidence=0.0, reliable=False)

    def on_point(self, vector: Sequence[float]) -> float | None:
        """The first player's chance after a point, None to leave things as they are (the default)."""
        return None


def apply_model(df: DataFrame, model: WinModel, outputs: str = "p1 double, p2 double, confidence double, reliable boolean") -> DataFrame:
    """Run a model over Arrow batches of packets."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield model.predict(frame)

    return df.mapInPandas(run, f"{kinds}, {outputs}")
