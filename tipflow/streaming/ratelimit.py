"""F6 streaming form: request-rate breaches over fixed windows, with event-time state and late records.

One query counts all rules.  Each task first counts its records per (client, rule, window), so a
client that sends a third of the feed reaches the state as few rows.  The state (``transformWithState``,
RocksDB) holds the counts of a client's open windows of one rule; an event-time timer closes a window when
the watermark passes its end and frees its count.

Output rows have a kind:

* ``update``: the count of an open window after a change, if it exceeds the rule's limit (reported at once);
* ``closed``: the count of a window when it closed, breach or not;
* ``late``: records of a window that was closed before they came (the side table: nothing is dropped).

A window's count is its largest ``update`` or ``closed`` count plus its ``late`` counts; with every window
closed or reported, this equals the batch result in whatever order the records come.
Windows still open when a feed ends are closed by :func:`read_breaches` from ``update`` rows
alone, so late records of a window that was never closed cannot exist.

Output goes through the parquet file sink, whose log makes it exactly-once and is read as one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tipflow.operators.changes import RATE_RULES

LOG_SCHEMA = ("req_id BIGINT, client_id BIGINT, req_at TIMESTAMP, route STRING, usr_code BIGINT, "
              "asked_cli_id BIGINT, asked_not_id BIGINT")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Microseconds of a window's unit.
UNIT_US = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}

_COUNTS = "client_id long, rule string, start_us long, end_us long, most long, n long"
_OUT = "kind string, client_id long, rule string, start_us long, end_us long, n long"


def width_us(width: str) -> int:
    number, unit = width.split()
    return int(number) * UNIT_US[unit.rstrip("s")]


def window_counts(log: DataFrame, rules) -> DataFrame:
    """(client_id, rule, start_us, end_us, most, n): each task's counts, to be summed; ``most`` is the rule's limit."""
    at = F.unix_micros("req_at")
    hits = []
    for name, route, width, limit in rules:
        start = at - F.pmod(at, F.lit(width_us(width)))
        hit = F.struct(F.lit(name).alias("rule"), start.alias("start_us"), (start + width_us(width)).alias("end_us"),
                       F.lit(int(limit)).cast("long").alias("most"))
        hits.append(hit if route is None else F.when(F.col("route") == route, hit))
    rows = (log.where("req_at is not null").select("client_id", F.explode(F.array(*hits)).alias("h")).where("h is not null")
            .select("client_id", "h.*"))

    def count(frames):
        for pdf in frames:
            yield pdf.groupby(["client_id", "rule", "start_us", "end_us", "most"], dropna=False).size().reset_index(name="n")

    return rows.mapInPandas(count, _COUNTS)


class WindowCounts(StatefulProcessor):
    """Counts of the open windows of one client and rule."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start_us long", "end_us long, n long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        out = []
        counts = pd.concat([p.groupby(["start_us", "end_us", "most"])["n"].sum().reset_index() for p in rows])
        for (start, end, most), n in counts.groupby(["start_us", "end_us", "most"])["n"].sum().items():
            start, end, n = int(start), int(end), int(n)
            if end <= watermark:
                out.append(("late", start, end, n))
                continue
            if self.open.containsKey((start,)):
                n += self.open.getValue((start,))[1]
            else:
                self.handle.registerTimer(end // 1000)
            self.open.updateValue((start,), (end, n))
            if n > most:
                out.append(("update", start, end, n))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        gone = [(start[0], value[0], value[1]) for start, value in self.open.iterator() if value[0] <= at]
        for start, _, _ in gone:
            self.open.removeKey((start,))
        yield self._frame(key, [("closed", *row) for row in gone])

    @staticmethod
    def _frame(key, rows):
        import pandas as pd
        kind, start, end, n = zip(*rows) if rows else ((), (), (), ())
        client = pd.Series([key[0]] * len(rows), dtype="Int64")
        return pd.DataFrame({"kind": pd.Series(kind, dtype=str), "client_id": client,
                             "rule": pd.Series([key[1]] * len(rows), dtype=str), "start_us": pd.Series(start, dtype="int64"),
                             "end_us": pd.Series(end, dtype="int64"), "n": pd.Series(n, dtype="int64")})

    def close(self) -> None:
        pass


def breach_stream(log: DataFrame, rules, watermark: str) -> DataFrame:
    """Rows of :class:`WindowCounts` over a stream of requests."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the event time itself does not reach the state, so Spark drops no late record before it
    counts = window_counts(log.withWatermark("req_at", watermark), rules)
    return counts.groupBy("client_id", "rule").transformWithStateInPandas(
        WindowCounts(), _OUT, outputMode="Append", timeMode="EventTime")


def start_breach_stream(spark: SparkSession, log_dir: str, sink_dir: str, checkpoint: str, watermark: str,
                        rules=RATE_RULES, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the query.  ``watermark`` says how far behind the newest record a window stays open."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (breach_stream(reader.parquet(log_dir), rules, watermark).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def late_records(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The side table: (client_id, rule, window_start, window_end, n) of records that came after their window closed."""
    out = spark.read.parquet(sink_dir).where("kind = 'late'")
    return out.groupBy("client_id", "rule", "start_us", "end_us").agg(F.sum("n").alias("n")).select(
        "client_id", "rule", F.timestamp_micros("start_us").alias("window_start"),
        F.timestamp_micros("end_us").alias("window_end"), "n")


def read_breaches(spark: SparkSession, sink_dir: str, rules=RATE_RULES) -> DataFrame:
    """Windows whose count, late records included, exceeds the rule's limit."""
    out = spark.read.parquet(sink_dir)
    limit = F.element_at(F.create_map(*[x for name, _, _, most in rules for x in (F.lit(name), F.lit(int(most)))]), F.col("rule"))
    return (out.groupBy("client_id", "rule", "start_us", "end_us")
            .agg((F.coalesce(F.max(F.when(F.col("kind") != "late", F.col("n"))), F.lit(0))
                  + F.coalesce(F.sum(F.when(F.col("kind") == "late", F.col("n"))), F.lit(0))).alias("n"))
            .where(F.col("n") > limit)
            .select("client_id", "rule", F.timestamp_micros("start_us").alias("window_start"),
                    F.timestamp_micros("end_us").alias("window_end"), "n"))
