"""Tables of the engine: specs, snapshots, results, baselines, episodes and the last good run of a site.

All are Parquet (episodes: JSON lines) below one root, partitioned by site; writes append and go
through Spark's commit protocol.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.memory import EPISODE


_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a new one of our own where that is unset and all runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if (spark.sparkContext.master or "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: operators store tables there")
        known = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def _sweep() -> None:
    """Deletes what ``stored`` wrote, when the driver ends."""
    for spark, path in _scratch:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the context is gone already: the folder belongs to the cluster
            break


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives executors; it goes when the driver ends."""
    if not _scratch:
        atexit.register(_sweep)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    _scratch.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Append-only tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").partitionBy("site").parquet(f"{self.root}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def save_specs(self, specs: DataFrame) -> None:
        """site, version, parent, created_by, note, spec (JSON)."""
        self._append(specs, "specs")

    def latest_specs(self) -> DataFrame:
        return self._read("specs").groupBy("site").agg(F.max("version").alias("version"), F.max_by("spec", "version").alias("spec"))

    def lineage(self) -> DataFrame:
        return self._read("specs").select("site", "version", "parent", "created_by", "note").orderBy("site", "version")

    def save_snapshots(self, pages: DataFrame) -> None:
        """site, run_id, html."""
        self._append(pages, "snapshots")

    def has_snapshots(self, runs: DataFrame) -> DataFrame:
        """site, run_id, found: whether each run has a snapshot."""
        known = self.snapshots().select("site", "run_id").distinct().withColumn("found", F.lit(True))
        return runs.select("site", "run_id").join(known, ["site", "run_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def snapshots(self) -> DataFrame:
        return self._read("snapshots")

    def save_results(self, results: DataFrame) -> None:
        self._append(results, "results")

    def results(self) -> DataFrame:
        return self._read("results")

    def save_baselines(self, baselines: DataFrame) -> None:
        """site, run_id and the columns of a baseline; the newest run of a site counts."""
        self._append(baselines, "baselines")

    def baselines(self) -> DataFrame:
        rows = self._read("baselines")
        return rows.join(rows.groupBy("site").agg(F.max("run_id").alias("run_id")), ["site", "run_id"], "left_semi")

    def mark_good(self, runs: DataFrame) -> None:
        """site, run_id, marked_at."""
        self._append(runs, "good")

    def last_good(self) -> DataFrame:
        return self._read("good").groupBy("site").agg(F.max_by("run_id", "marked_at").alias("run_id"))

    def append_episodes(self, episodes: DataFrame) -> None:
        episodes.write.mode("append").json(f"{self.root}/episodes")

    def episodes(self) -> DataFrame:
        return self.spark.read.schema(EPISODE).json(f"{self.root}/episodes")

    def known_episodes(self) -> DataFrame:
        """``episodes``, empty where none was written yet."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/episodes")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.episodes() if there else self.spark.createDataFrame([], EPISODE)
