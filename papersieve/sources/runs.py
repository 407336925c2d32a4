"""Runs that count as a whole: tables are written aside, and one small commit makes them valid.

Below a folder, each table keeps the rows of a run under ``run_id=<id>``. A commit
is a numbered table of one file, ``commits/version=<n>``, that lists the runs
that are valid from then on. Its file appears in one step when Spark's writer moves it into place, so
a reader sees the former runs or the new ones, never a mixture, and a run
that breaks off is never seen.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_ID = "run_id"
COMMITS = "commits"
COMMIT = "commit_id string, run_ts string, run_id string"


class Snapshot(NamedTuple):
    """A version and its runs: their times by their ids."""

    version: int
    runs: dict[str, str]


def new_run_id() -> str:
    return uuid.uuid4().hex


def snapshot(spark: SparkSession, folder: str) -> Snapshot:
    """The runs that count now; version 0, without runs, where nothing was ever committed.

    One row for each run comes to the driver.
    """
    path = f"{folder.rstrip('/')}/{COMMITS}"
    try:
        commits = spark.read.schema(f"{COMMIT}, version long").parquet(path)
        version = commits.agg(F.max("version")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Snapshot(0, {})
    rows = commits.where(F.col("version") == version).collect()
    if len({row["commit_id"] for row in rows}) > 1:
        raise RuntimeError(f"two runs have committed version {version} of {folder} at once; repeat one of them")
    return Snapshot(version, {row["run_id"]: row["run_ts"] for row in rows})


def commit(spark: SparkSession, folder: str, before: Snapshot, runs: dict[str, str]) -> Snapshot:
    """Make ``runs`` (times by ids) the ones that count, after ``before``.

    Fails if another run has committed since ``before`` was read.
    """
    version, name = before.version + 1, new_run_id()
    rows = [(name, run_ts, run_id) for run_id, run_ts in runs.items()]
    table = spark.createDataFrame(rows, COMMIT).coalesce(1)
    table.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{COMMITS}/version={version}")
    now = snapshot(spark, folder)
    if now.version == version and set(now.runs) != set(runs):
        raise RuntimeError(f"another run has committed version {version} of {folder}")
    return now


def clear(spark: SparkSession, path: str) -> None:
    """Remove all files of a table or a part of it; an empty folder stays.

    Overwriting is the one way of Spark's own writers to delete, on any storage.
    """
    nothing = spark.createDataFrame([], "part int, value int")
    nothing.write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("part").parquet(path)


def written_runs(spark: SparkSession, folder: str) -> set[tuple[str, str]]:
    """Table and id of all runs that have files below ``folder``, by the paths of its files alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        paths = files.load(folder).select("path")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    part = f"/([^/]*)/{RUN_ID}=([^/]*)/"
    found = paths.select(F.regexp_extract("path", part, 1).alias("table"), F.regexp_extract("path", part, 2).alias("run"))
    return {(row["table"], row["run"]) for row in found.where("run <> ''").distinct().collect()}


def vacuum(spark: SparkSession, folder: str, versions: int = 1) -> set[str]:
    """Remove the rows of runs that no longer count, and all but the last ``versions`` commits.

    Readers that opened a former version lose it, and so do runs that are being
    written now: clean up when there are none. Returns the ids of removed runs.
    """
    now = snapshot(spark, folder)
    removed: set[str] = set()
    for table, run_id in sorted(written_runs(spark, folder)):
        if run_id not in now.runs:
            clear(spark, f"{folder.rstrip('/')}/{table}/{RUN_ID}={run_id}")
            removed.add(run_id)
    path = f"{folder.rstrip('/')}/{COMMITS}"
    if now.version > versions:
        commits = spark.read.schema(f"{COMMIT}, version long").parquet(path)
        old = commits.where(F.col("version") <= now.version - versions).select("version").distinct()
        for row in old.collect():
            clear(spark, f"{path}/version={row['version']}")
    return removed


def valid_rows(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (with ``run_id``) of the runs that count; rows of tables that no run has written have none and all count."""
    runs = snapshot(rows.sparkSession, folder).runs
    return rows.where(F.col(RUN_ID).isin(list(runs)) if runs else F.col(RUN_ID).isNull())
