"""Readers and writers of the file formats: match folders, logs, history tables, labels, annotations, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from courtside.functions import text as tx
from courtside.operators.ranking import global_rank

TRAJECTORIES = "frame long, track_id int, x double, y double, speed_pps double, x_m double, y_m double, speed_mps double"
SCORES = "frame long, timestamp_sec double, " + ", ".join(f"player{p}_{c} int" for c in ("score", "sets", "obscured", "sets_obscured") for p in (1, 2))
RALLIES = (
    "rally_id int, rally_start_frame long, rally_end_frame long, rally_start_time double, rally_end_time double, p1_score_start int, p2_score_start int, p1_sets_start int, p2_sets_start int, "
    "mean_speed_mps double, max_speed_mps double, speed_std_mps double, " + ", ".join(f"landing_zone_{z} int" for z in range(9)) + ", point_winner string, skipped int"
)
POSES = "frame long, timestamp_sec double, player_id int, " + ", ".join(
    f"{c} double" for c in (
        "visibility_mean", "visibility_min", "visibility_left_arm", "visibility_right_arm", "angle_trunk_lean", "angle_elbow_dom", "angle_elbow_left", "angle_elbow_right", "angle_knee_front",
        "angle_knee_back", "com_height", "hand_height", "hand_height_left", "hand_height_right", "stance_length", "v_hand_speed", "v_hand_speed_left", "v_hand_speed_right", "v_torso_x", "v_com_y",
    )
)
KINDS = {"trajectories": TRAJECTORIES, "scores": SCORES, "rallies": RALLIES, "pose_frames": POSES}
SESSION = "player_names array<string>, sets_to_win int, best_of int, score_mode string"


#: Folders are numbered side by side for each beginning of so many letters of their names.
FOLDER_LETTERS = 12


def read_logs(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All match folders' logs of one kind, by an explicit schema; short rows have nulls at their end.

    match is the folder's name, match_id its rank by name. One read serves all folders.
    """
    rows = spark.read.csv(f"{root}/*/{kind}_*.csv", schema=KINDS[kind], header=True, mode="PERMISSIVE", enforceSchema=True)
    rows = rows.withColumn("match", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    ranked = global_rank(rows.select("match").distinct(), F.substring("match", 1, FOLDER_LETTERS), ["match"], "match_id")
    return rows.join(ranked, "match")


def write_logs(df: DataFrame, path: str, kind: str = "parquet", run: str | None = None) -> None:
    """One directory per match, appended; with the name of a run, once for that run (``write_once``)."""
    if run is not None:
        write_once(df, run, path, kind)
        return
    df.write.partitionBy("match_id").format(kind).option("header", True).mode("append").save(path)


def write_once(batch: DataFrame, batch_id: int | str, path: str, kind: str = "parquet") -> bool:
    """Commit a batch under its id: what is there already stays, so a batch that comes again adds nothing. Whether it was new.

    Rows go to a folder that readers pass over and get their name, ``batch_id=...``, by a rename as the last step. That is
    atomic on HDFS and local file systems; on an object store without renames a reader may see a batch in parts.
    """
    spark = batch.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done, part = folder(f"{path}/batch_id={batch_id}"), folder(f"{path}/_parts/{batch_id}-{uuid.uuid4().hex}")
    store = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(done):
        return False
    batch.write.partitionBy("match_id").format(kind).option("header", True).save(part.toString())
    if store.exists(done) or not store.rename(part, done):
        store.delete(part, True)
        return False
    return True


def read_once(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """All rows of the batches that were committed; ``schema`` includes match_id."""
    return spark.read.schema(f"{schema}, batch_id string").option("header", True).format(kind).load(path).drop("batch_id")


def stream_logs(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> DataStreamWriter:
    """A log written from a stream, every micro-batch once: a batch that is run again after a failure finds itself committed."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: write_once(batch, batch_id, path, kind) and None).option("checkpointLocation", checkpoint)


def write_csv(df: DataFrame, path: str) -> None:
    """Datasets, histories and metrics: CSV parts with a header, over what is there."""
    df.write.option("header", True).mode("overwrite").csv(path)


def write_score_log(df: DataFrame, path: str, run: str | None = None) -> None:
    """timestamp_sec, frame, score of the scoreboard reader, appended; with the name of a run, once for that run, by match."""
    if run is not None:
        write_once(df.select("match_id", "timestamp_sec", "frame", "score"), run, path, "csv")
        return
    df.select("timestamp_sec", "frame", "score").write.option("header", True).mode("append").csv(path)


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """match, player1_name, player2_name, sets_to_win, best_of of the newest session of each folder, with defaults."""
    rows = spark.read.json(f"{root}/*/broadcast_session*.json", schema=SESSION, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.withColumn("match", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    last = rows.groupBy("match").agg(F.max_by(F.struct("player_names", "sets_to_win", "best_of"), "file").alias("s"))
    name = lambda i, default: F.coalesce(F.get("s.player_names", F.lit(i)), F.lit(default))
    sets = F.coalesce("s.sets_to_win", F.lit(3))
    return last.select("match", name(0, "Player 1").alias("player1_name"), name(1, "Player 2").alias("player2_name"), sets.alias("sets_to_win"), F.coalesce("s.best_of", 2 * sets - 1).alias("best_of"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """fps, regions by name, and corners of a calibration file; regions may be null."""
    return spark.read.json(path, schema="video_path string, fps double, rois map<string,array<int>>, table_corners array<array<double>>, ball_model string, digit_model string", multiLine=True)


#: Column names of match history that differ between exports.
RENAMED = {"Head-To-Head": "h2h", "Best of 3/5": "best_of", "Match Score": "score", "Player A": "a", "Player B": "b"}


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A history CSV with names trimmed, unquoted, single-spaced and renamed, and ids trimmed."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(RENAMED.get(n := " ".join(c.replace('"', "").split()), n) for c in rows.columns))
    return rows.withColumns({c: F.trim(c) for c in rows.columns if c.startswith("ID_")})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, cls, cx, cy, w, h of each label line of five parts or more."""
    rows = spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.select("path", *(c.alias(n) for n, c in tx.label_parts(F.col("value")).items())).filter("cls is not null")


def write_labels(df: DataFrame, path: str) -> None:
    """One folder per name, one line per box."""
    df.select("name", tx.label_line(F.col("cls"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("value")).write.partitionBy("name").text(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """frame, x, y of a JSON object of frames; frames without x or y go."""
    whole = spark.read.text(path, wholetext=True)
    points = whole.select(F.explode(F.from_json("value", "map<string,struct<x:double,y:double>>")).alias("frame", "p"))
    return points.select(F.col("frame").try_cast("long").alias("frame"), "p.x", "p.y").filter("x is not null and y is not null")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """split and name of each non-empty line of train.txt, val.txt, ..."""
    rows = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("split"), F.trim("value").alias("name"))
    return rows.filter("name <> ''")


def find_exports(spark: SparkSession, root: str) -> DataFrame:
    """export, split and stem of every image below the exports, without reading one; valid counts as val."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,png}").load(root).select("path")
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/(train|valid|val|test)/images/([^/]+)\.(jpg|png)$", i)
    out = rows.select(part(1).alias("export"), part(2).alias("split"), part(3).alias("stem")).filter("export <> ''")
    return out.withColumn("split", F.when(F.col("split") == "valid", "val").otherwise(F.col("split")))


def live_rows(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Detection rows as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_weights(df: DataFrame, path: str) -> None:
    """The fusion's JSON in two parts: ``summary``, one line of weights and the number of matches, and ``matches``, one line each.

    Matches aren't put into one document, so that their number doesn't matter.
    """
    df.groupBy("weight_cv", "weight_profile").agg(F.count("*").alias("matches")).write.mode("overwrite").json(f"{path}/summary")
    df.select("match_id", "cv", "profile", "fused").write.mode("overwrite").json(f"{path}/matches")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Each match's probabilities beside the weights that fused them."""
    summary = spark.read.json(f"{path}/summary", schema="weight_cv double, weight_profile double, matches long").drop("matches")
    return spark.read.json(f"{path}/matches", schema="match_id long, cv double, profile double, fused double").join(F.broadcast(summary.limit(1)))  # one row
