"""F2 as a stream: collaborator values follow their tenant's limit down as limit changes arrive.

The state store (``transformWithState``) keeps, for each tenant, its last limit, the time and
sequence of the record that set it, and the least limit that any change lowered it to.  A record acts
if it lowers a limit that was set to one that is set, and it changes a collaborator only if it goes
below that least limit, because all values are at most that already.  Such a record is joined with
the tenant's collaborators and gives their values after the change.

Records not newer than the tenant's state change nothing, so a replayed feed adds no row.  Output goes
through the parquet file sink, whose log makes it exactly-once.  ``pix_limit_trigger`` in
:mod:`tipflow.operators.changes` is the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tipflow.streaming.ratelimit import ROCKSDB

FEED_SCHEMA = "cli_id BIGINT, new_limit DECIMAL(18,2), changed_at TIMESTAMP, seq BIGINT"

_STATE = "cents long, at_us long, seq long, least_cents long"
_OUT = "cli_id long, cents long, before_cents long, at_us long, seq long"


class Limits(StatefulProcessor):
    """Records of one tenant -> those that lower its limit below every limit before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limit", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        known = self.state.get() if self.state.exists() else None
        frames, start = [], None
        for pdf in rows:
            if known is None and not frames:
                start = None if pd.isna(pdf["start_cents"].iloc[0]) else int(pdf["start_cents"].iloc[0])
            frames.append(pdf[["at_us", "seq", "cents"]])
        cents, at, seq, least = known if known is not None else (start, None, None, None)
        out = []
        for row in pd.concat(frames).sort_values(["at_us", "seq"]).itertuples(index=False):
            if at is not None and (row.at_us, row.seq) <= (at, seq):
                continue
            new = None if pd.isna(row.cents) else int(row.cents)
            if new is not None and cents is not None and new < cents and (least is None or new < least):
                out.append((key[0], new, least, int(row.at_us), int(row.seq)))
                least = new
            cents, at, seq = new, int(row.at_us), int(row.seq)
        self.state.update((cents, at, seq, least))
        yield pd.DataFrame({name: pd.Series([r[i] for r in out], dtype="Int64")
                            for i, name in enumerate(("cli_id", "cents", "before_cents", "at_us", "seq"))})

    def close(self) -> None:
        pass


def _cents(col: str):
    return (F.col(col) * 100).cast("long")


def limit_stream(feed: DataFrame, tenant: DataFrame, collaborator: DataFrame) -> DataFrame:
    """(usr_id, cli_id, day_value, night_value, changed_at, seq): a row for each collaborator that a record changes."""
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = (feed.join(tenant.select("cli_id", _cents("pix_limit").alias("start_cents")), "cli_id")
            .select("cli_id", _cents("new_limit").alias("cents"), F.unix_micros("changed_at").alias("at_us"), "seq", "start_cents"))
    lowered = rows.groupBy("cli_id").transformWithStateInPandas(Limits(), _OUT, outputMode="Append", timeMode="None")
    people = collaborator.select("usr_id", "cli_id", _cents("day_value").alias("day"), _cents("night_value").alias("night"))
    before = F.col("before_cents")
    # what the limits before this one have left of a value
    left = {c: F.when(F.col(c) > before, before).otherwise(F.col(c)) for c in ("day", "night")}
    changed = lowered.join(people, "cli_id").select(
        "usr_id", "cli_id", *[x.alias(c) for c, x in left.items()], "cents", F.timestamp_micros("at_us").alias("changed_at"), "seq")
    after = [F.least(c, "cents") for c in ("day", "night")]  # null values stay null
    return changed.where("day > cents or night > cents").select(
        "usr_id", "cli_id", *[(F.when(F.col(c).isNotNull(), x).cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias(f"{c}_value")
                              for c, x in zip(("day", "night"), after)], "changed_at", "seq")


def start_limit_stream(spark: SparkSession, feed_dir: str, tenant: DataFrame, collaborator: DataFrame, out_dir: str,
                       checkpoint: str, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the trigger over parquet files of limit changes."""
    reader = spark.readStream.schema(FEED_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (limit_stream(reader.parquet(feed_dir), tenant, collaborator).writeStream.format("parquet").outputMode("append")
         .option("path", out_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_limited(spark: SparkSession, out_dir: str) -> DataFrame:
    """Changed collaborators with their values after all changes so far."""
    out = spark.read.parquet(out_dir)
    return out.groupBy("usr_id", "cli_id").agg(F.min("day_value").alias("day_value"), F.min("night_value").alias("night_value"))
