"""Sinks (A3, A4, A44): new-state tables written as one committed run.

Plain parquet has no UPDATE/MERGE, so table-changing jobs produce full
new-state frames.  :func:`write_state` writes every frame of a job to a
folder of its own attempt and appends one commit record last, which names the
run and each table's folder and schema.  Readers follow the log's newest
record of a run, so a run that fails midway is never visible, a retried run
replaces what its earlier attempt wrote (also by nothing), and an empty frame
reads back with its columns: the BEGIN/COMMIT of the reference becomes
"commit record written last".  The log's versions (:mod:`tipflow.sources.commits`)
order the attempts; no clock is involved.

Runs of one table are read in one scan over their folders.  :func:`merge_runs`
rewrites the folders of many runs as one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tipflow.sources.commits import Log


def _fold(state: dict, record: dict) -> dict:
    """{table: [[first run, last run, path, schema], ...]} in run order."""
    for name, (first, last, path, schema) in record.items():
        parts = state.setdefault(name, [])
        inside = [p for p in parts if p[0] <= first <= p[1] and p[0] != p[1]]
        if inside and first == last:
            raise ValueError(f"run {first} of {name} was merged and cannot be written again")
        parts[:] = sorted([p for p in parts if p[0] < first or p[1] > last] + [[first, last, path, schema]])
    return state


def _log(spark: SparkSession, root: str) -> Log:
    return Log(spark, f"{root}/_commits", _fold)


def write_attempts(frames: dict[str, DataFrame], root: str, run_id: int) -> None:
    """Write each frame to a new folder, then one commit record for all."""
    spark = next(iter(frames.values())).sparkSession
    record = {}
    for name, df in frames.items():
        path = f"{root}/{name}/{run_id:012d}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        record[name] = [run_id, run_id, path, df.schema.json()]
    log = _log(spark, root)
    _fold(log.state()[1], record)  # raises before the commit
    log.commit(lambda state: record)


def committed(spark: SparkSession, root: str, name: str, before: int | None = None, since: int | None = None) -> list:
    """[first run, last run, path, schema] of the table's folders in run order; only whole folders of runs in the range."""
    parts = _log(spark, root).state()[1].get(name, [])
    return [p for p in parts if (before is None or p[1] < before) and (since is None or p[0] >= since)]


def read_runs(spark: SparkSession, parts: list) -> DataFrame | None:
    """All rows of the folders, in one scan for each schema (a later schema may add columns)."""
    schemas: dict[str, list[str]] = {}
    for _, _, path, schema in parts:
        schemas.setdefault(schema, []).append(path)
    out = None
    for schema, paths in schemas.items():
        df = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merge_runs(spark: SparkSession, root: str, name: str, before: int) -> None:
    """Rewrite the folders of single runs before ``before`` as one folder (their rows as they are)."""
    log = _log(spark, root)
    single = [p for p in log.state()[1].get(name, []) if p[0] == p[1] and p[1] < before]
    if len(single) < 2:
        return
    merged = read_runs(spark, single)
    first, last = single[0][0], single[-1][1]
    path = f"{root}/{name}/{first:012d}-{last:012d}-{uuid.uuid4().hex}"
    merged.write.parquet(path)
    version, state = log.state()
    if [p for p in state[name] if first <= p[0] and p[1] <= last] == single:  # else another writer was here
        log.append(version + 1, {name: [first, last, path, merged.schema.json()]})


def write_state(frames: dict[str, DataFrame], root: str, run_id: int) -> None:
    write_attempts(frames, root, run_id)


def read_state(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as of the newest committed run that wrote it."""
    parts = committed(spark, root, name)
    if not parts:
        raise ValueError(f"no committed run of {name} under {root}")
    return read_runs(spark, parts[-1:])


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A4: header CSV export, one folder per partition value when asked."""
    w = df.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
