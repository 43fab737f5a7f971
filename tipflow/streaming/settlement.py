"""F1 streaming forms: settle invoices as charge-status records arrive.

Two implementations, both equal to the batch job on the same feed
(tests/test_streaming.py):

``start_stateful_settlement`` -- ``transformWithState``.  The feed is joined to
the invoice (start status, last status time) and grouped by invoice; Spark's
state store keeps four values per invoice (last status, its time and sequence,
time of the first payment).  A micro-batch's records of an invoice are read chunk
by chunk, each reduced to 20 bytes a record at once, so an invoice that sends a third
of the feed needs no frame of all its rows.  State expires: when the watermark is
``keep`` past an invoice's last record, its state moves to the ``closed`` table.
Records further back than that go to the ``late`` table, whether their invoice still
has state or not, so a replayed old record never pays; a newer record
of a closed invoice takes up its closed state again.

``start_settlement_stream`` -- ``foreachBatch`` running the batch job's
transition logic (:func:`tipflow.operators.changes.settlement_fires`) per
micro-batch.  It suits feeds where one invoice holds a very large share of
the records (the work per invoice is spread over tasks).  Epoch ``e`` reads only
states committed by epochs ``< e``, so a replayed epoch replaces its own
output.  Every ``COMPACT``-th epoch writes the state of all invoices, so a
reader needs at most that many epochs' deltas.

Both write each epoch's tables to folders of their own attempt and commit them last
(:mod:`tipflow.sources.sinks`); the folders of any number of epochs are read in one scan,
and every ``COMPACT`` epochs they are merged.  In both, records not newer than an invoice's state are
dropped, so a replayed record cannot pay twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tipflow.operators.changes import first_fires, movements_of, settlement_fires
from tipflow.sources.sinks import committed, merge_runs, read_runs, write_attempts
from tipflow.streaming.ratelimit import ROCKSDB, width_us

FEED_SCHEMA = "not_id BIGINT, new_status STRING, changed_at TIMESTAMP, seq BIGINT"
COMPACT = 50


def _state_before(spark: SparkSession, out_root: str, epoch: int) -> DataFrame | None:
    """The state of every touched invoice as of the epochs committed before ``epoch``."""
    runs = committed(spark, out_root, "state", before=epoch)
    full = max((r[0] for r in runs if r[0] % COMPACT == 0), default=None)
    every = read_runs(spark, [r for r in runs if full is None or r[0] >= full])
    if every is None:
        return None
    rest = [c for c in every.columns if c not in ("not_id", "epoch")]
    newest = every.groupBy("not_id").agg(F.max(F.struct("epoch", *rest)).alias("s"))
    return newest.select("not_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def process_batch(spark: SparkSession, batch: DataFrame, epoch: int, invoice: DataFrame, out_root: str,
                  once: bool = False) -> None:
    """Apply one micro-batch of feed records (see module doc)."""
    prev = _state_before(spark, out_root, epoch)
    start = invoice.select("not_id", "charge_status", "status_updated_at")
    if prev is not None:
        start = start.join(prev, "not_id", "left")
    else:
        start = start.withColumns({"last_status": F.lit(None).cast("string"), "last_at": F.lit(None).cast("timestamp"),
                                   "last_seq": F.lit(None).cast("long"), "settled_at": F.lit(None).cast("timestamp")})
    known = F.col("last_at").isNotNull()
    start = start.withColumn("start_status", F.when(known, F.col("last_status")).otherwise(F.col("charge_status")))
    newer = F.when(known, F.struct("changed_at", "seq") > F.struct(F.col("last_at").alias("changed_at"),
                                                                  F.col("last_seq").alias("seq")))
    newer = newer.otherwise(F.col("status_updated_at").isNull() | (F.col("changed_at") > F.col("status_updated_at")))
    recs = (batch.join(start.select("not_id", "status_updated_at", "last_at", "last_seq"), "not_id")
            .filter(newer).select("not_id", "new_status", "changed_at", "seq")).persist()
    fires = settlement_fires(recs, start.select("not_id", "start_status"), once)
    if once:
        fires = fires.join(start.filter("settled_at is not null").select("not_id"), "not_id", "left_anti")
    fires = fires.persist()
    settled = (start.select("not_id", "settled_at").join(
        first_fires(fires).select("not_id", F.col("fire_at").alias("_first")), "not_id", "left")
        .select("not_id", F.coalesce("settled_at", "_first").alias("settled_at")))
    movements = movements_of(fires.join(settled, "not_id"), invoice.select(
        "not_id", "paid_value", "invoice_value", "settled_on", "ctb_id"))
    last = (recs.groupBy("not_id").agg(F.max(F.struct("changed_at", "seq", "new_status")).alias("r"))
            .select("not_id", F.col("r.new_status").alias("last_status"), F.col("r.changed_at").alias("last_at"),
                    F.col("r.seq").alias("last_seq")))
    state = last.join(settled, "not_id")
    if epoch % COMPACT == 0 and prev is not None:
        state = state.unionByName(prev.join(last.select("not_id"), "not_id", "left_anti"))
    write_attempts({"movements": movements, "state": state.withColumn("epoch", F.lit(epoch).cast("long"))}, out_root, epoch)
    if epoch % COMPACT == COMPACT - 1:  # the newest epochs stay apart: a restart may write them again
        merge_runs(spark, out_root, "movements", before=epoch)
    fires.unpersist()
    recs.unpersist()


def start_settlement_stream(spark: SparkSession, feed_dir: str, invoice: DataFrame, out_root: str,
                            checkpoint: str, max_files_per_trigger: int | None = None, available_now: bool = True,
                            once: bool = False):
    """Start the streaming settlement over parquet files of status records."""
    feed = _feed(spark, feed_dir, max_files_per_trigger)
    w = (feed.writeStream.foreachBatch(lambda df, e: process_batch(spark, df, e, invoice, out_root, once))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _feed(spark: SparkSession, feed_dir: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(FEED_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(feed_dir)


def read_movements(spark: SparkSession, out_root: str) -> DataFrame:
    """Movements of all committed epochs, one attempt of each, in one scan."""
    out = read_runs(spark, committed(spark, out_root, "movements"))
    if out is None:
        raise ValueError(f"no committed epoch under {out_root}")
    return out


# --- stateful form: transformWithState over Spark's state store --------------------------------

_STATE = "last_status string, last_us long, last_seq long, settled_us long"
_OUT = "kind string, not_id long, status string, at_us long, seq long, settled_us long, start_status string"


class Settlement(StatefulProcessor):
    """One invoice: changes of the raw status into 'paid' (any case).

    Emits ``fire`` rows; ``first`` instead, if the invoice has no state and its first record is a payment
    (whether it fires depends on a closed state, which the sink knows); ``late`` for records more than
    ``keep_us`` behind the watermark; ``closed`` when the state expires.
    """

    def __init__(self, keep_us: int, once: bool):
        self.keep_us, self.once = keep_us, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("invoice", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        horizon = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep_us
        known = self.state.get() if self.state.exists() else None
        last_status, last_us, last_seq, settled_us = known if known is not None else (None, None, None, None)
        codes: dict = {}
        chunks, late, start, cutoff = [], [], None, None
        for pdf in rows:
            if start is None:  # the same in all rows of the invoice
                start, cutoff = (pdf["start_status"].iloc[0], pdf["cutoff_us"].iloc[0])
            us, seq = pdf["k_us"].to_numpy(np.int64), pdf["seq"].to_numpy(np.int64)
            code = np.array([codes.setdefault(s if isinstance(s, str) else None, len(codes)) for s in pdf["new_status"]], np.int32)
            old = us <= horizon
            for i in np.flatnonzero(old):
                late.append((pdf["new_status"].iloc[i], us[i], seq[i]))
            if known is not None:
                use = (us > last_us) | ((us == last_us) & (seq > last_seq))
            else:
                use = us > cutoff if cutoff == cutoff and cutoff is not None else np.ones(len(us), bool)
            use &= ~old
            chunks.append((us[use], seq[use], code[use]))
        out = [("late", s if isinstance(s, str) else None, int(u), int(q), None, None) for s, u, q in late]
        us, seq, code = (np.concatenate([c[i] for c in chunks]) for i in range(3))
        if len(us):
            order = np.lexsort((seq, us))
            us, seq, code = us[order], seq[order], code[order]
            names = list(codes)
            start = start if isinstance(start, str) else None
            before = last_status if known is not None else start
            # the code before the first record; one of its own if the status does not occur here
            changed = np.concatenate([[names[code[0]] != before], code[1:] != code[:-1]])
            paid = np.array([n is not None and n.lower() == "paid" for n in names])[code]
            fires = np.flatnonzero(paid & changed)
            first = known is None and bool(paid[0])
            if self.once:  # one more where the sink may turn the first one down
                fires = fires[:0 if settled_us is not None else 1 + first]
            if settled_us is None and len(fires):
                settled_us = int(us[fires[0]])
            if first and 0 not in fires:  # a closed state may still make it one
                fires = np.concatenate([[0], fires])
            for i in fires:
                kind = "first" if first and i == 0 else "fire"
                out.append((kind, names[code[i]], int(us[i]), int(seq[i]), settled_us, start if kind == "first" else None))
            self.state.update((names[code[-1]], int(us[-1]), int(seq[-1]), settled_us))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((int(us[-1]) + self.keep_us) // 1000 + 1)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.state.exists():
            status, us, seq, settled = self.state.get()
            out = [("closed", status, us, seq, settled, None)]
            self.state.clear()
        yield self._frame(key, out)

    @staticmethod
    def _frame(key, rows):
        import pandas as pd
        kind, status, at, seq, settled, start = zip(*rows) if rows else ((),) * 6
        return pd.DataFrame({
            "kind": pd.Series(kind, dtype=object), "not_id": pd.Series([key[0]] * len(rows), dtype="int64"),
            "status": pd.Series(status, dtype=object), "at_us": pd.Series(at, dtype="int64"), "seq": pd.Series(seq, dtype="int64"),
            "settled_us": pd.Series(settled, dtype="Int64"), "start_status": pd.Series(start, dtype=object)})

    def close(self) -> None:
        pass


def _write_epoch(spark: SparkSession, rows: DataFrame, epoch: int, invoice: DataFrame, out_root: str, once: bool) -> None:
    """Movements, closed states and late records of one epoch; closed states of earlier epochs decide ``first`` rows."""
    rows = rows.persist()
    before = read_runs(spark, committed(spark, out_root, "closed", before=epoch))
    if before is None:
        before = spark.createDataFrame([], "not_id long, last_status string, last_us long, last_seq long, settled_us long")
    was = before.groupBy("not_id").agg(F.max(F.struct("last_us", "last_seq", "last_status", "settled_us")).alias("was"))
    joined = rows.where("kind <> 'late'").join(was, "not_id", "left")
    old = F.when(F.col("was").isNotNull(), F.col("was.last_status")).otherwise(F.col("start_status"))
    fires = (F.col("kind") == "fire") | ((F.col("kind") == "first") & ~F.col("status").eqNullSafe(old))
    settled = F.coalesce("was.settled_us", "settled_us")
    fired = joined.where(fires).select("not_id", "at_us", "seq", settled.alias("settled_us"), "was")
    if once:
        fired = (fired.where("was.settled_us is null").groupBy("not_id")
                 .agg(F.min(F.struct("at_us", "seq", "settled_us")).alias("f")).select("not_id", "f.*"))
    movements = movements_of(fired.select(
        "not_id", F.timestamp_micros(F.coalesce("settled_us", "at_us")).alias("settled_at")), invoice.select(
        "not_id", "paid_value", "invoice_value", "settled_on", "ctb_id"))
    closed = joined.where("kind = 'closed'").select(
        "not_id", F.col("status").alias("last_status"), F.col("at_us").alias("last_us"), F.col("seq").alias("last_seq"),
        settled.alias("settled_us"))
    late = rows.where("kind = 'late'").select("not_id", F.col("status").alias("new_status"),
                                              F.timestamp_micros("at_us").alias("changed_at"), "seq")
    write_attempts({"movements": movements, "closed": closed, "late": late}, out_root, epoch)
    if epoch % COMPACT == COMPACT - 1:
        for name in ("movements", "closed", "late"):
            merge_runs(spark, out_root, name, before=epoch)
    rows.unpersist()


def start_stateful_settlement(spark: SparkSession, feed_dir: str, invoice: DataFrame, out_root: str,
                              checkpoint: str, keep: str = "3650 days", max_files_per_trigger: int | None = None,
                              available_now: bool = True, once: bool = False):
    """F1 with ``transformWithState`` (see the module doc).

    ``keep`` is how far the newest record of the feed may run ahead of an invoice's last one before
    the invoice's state is closed, and the most that a record may come late.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    feed = _feed(spark, feed_dir, max_files_per_trigger).withWatermark("changed_at", "0 seconds")
    inv = invoice.select("not_id", F.col("charge_status").alias("start_status"),
                         F.unix_micros(F.col("status_updated_at").cast("timestamp")).alias("cutoff_us"))
    # the event time itself does not reach the state, so Spark drops no late record before it
    rows = (feed.join(inv, "not_id")
            .select("not_id", "new_status", "seq", "start_status", "cutoff_us", F.unix_micros("changed_at").alias("k_us")))
    out = rows.groupBy("not_id").transformWithStateInPandas(
        Settlement(width_us(keep), once), _OUT, outputMode="Append", timeMode="EventTime")
    w = (out.writeStream.outputMode("append")
         .foreachBatch(lambda df, e: _write_epoch(spark, df, e, invoice, out_root, once))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_late(spark: SparkSession, out_root: str) -> DataFrame | None:
    """Records that came too late to count (see ``keep``)."""
    return read_runs(spark, committed(spark, out_root, "late"))
