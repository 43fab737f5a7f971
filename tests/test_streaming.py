"""Batch form equals streaming form (availableNow) for F1 and F6."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tipflow.operators import changes as ch
from tipflow.sources.mart import mart
from tipflow.streaming import limits, ratelimit, settlement

from .conftest import SF_SMALL


def _write_in_time_slices(df, time_col, root, n=4):
    ordered = df.withColumn("_slice", F.ntile(n).over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(time_col, df.columns[0])))
    for i in range(1, n + 1):
        ordered.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.parquet(f"{root}/part{i:03d}")
    return [f"{root}/part{i:03d}" for i in range(1, n + 1)]


def _flatten(spark, dirs, target):
    # one folder of files, file names sorting in time order
    for i, d in enumerate(dirs):
        spark.read.parquet(d).coalesce(1).write.mode("append").parquet(target)


def test_settlement_stream_equals_batch(spark, scratch):
    m = mart(spark, SF_SMALL)
    feed = m.status_feed.select("not_id", "new_status", "changed_at", "seq")
    slices = _write_in_time_slices(feed, "changed_at", f"{scratch}/slices")
    feed_dir = f"{scratch}/feed"
    os.makedirs(feed_dir)
    # move slice files into one folder keeping time order in their names
    for i, d in enumerate(slices):
        for f in sorted(os.listdir(d)):
            if f.endswith(".parquet"):
                os.link(os.path.join(d, f), os.path.join(feed_dir, f"{i:03d}-{f}"))
    q = settlement.start_settlement_stream(spark, feed_dir, m.invoice, f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination()
    streamed = settlement.read_movements(spark, f"{scratch}/out").drop("fire_at")
    batch = ch.settle_paid_invoices(m)["movements"]
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert streamed.count() > 0


def _invoice(spark, status):
    return spark.createDataFrame([(1, status, None, None, Decimal("9.00"), None, 1)],
                                 "not_id long, charge_status string, status_updated_at timestamp, paid_value decimal(18,2), "
                                 "invoice_value decimal(18,2), settled_on date, ctb_id long")


def _feed(spark, statuses, start=1):
    return spark.createDataFrame([(1, s, dt.datetime(2024, 1, i), i) for i, s in enumerate(statuses, start)],
                                 "not_id long, new_status string, changed_at timestamp, seq long")


def test_transitions_fire_on_raw_text_and_again(spark, scratch):
    # 'paid' to 'PAID' is a change of the raw text into paid; so is a second payment after 'waiting'
    inv = _invoice(spark, "waiting")
    feed = _feed(spark, ["paid", "paid", "PAID", "waiting", None, "paid"])
    start = inv.select("not_id", F.col("charge_status").alias("start_status"))
    assert sorted(r.fire_seq for r in ch.settlement_fires(feed, start).collect()) == [1, 3, 6]
    assert [r.fire_seq for r in ch.settlement_fires(feed, start, once=True).collect()] == [1]
    # the same in two epochs of the foreachBatch form; a replayed epoch replaces its output
    out = f"{scratch}/out"
    settlement.process_batch(spark, _feed(spark, ["paid", "paid", "PAID"]), 0, inv, out)
    for _ in range(2):
        settlement.process_batch(spark, _feed(spark, ["waiting", None, "paid"], 4), 1, inv, out)
    got = settlement.read_movements(spark, out).collect()
    assert len(got) == 3 and {str(r.mov_date) for r in got} == {"2024-01-01"}
    # records that are not newer change nothing, and an epoch without movements reads back
    settlement.process_batch(spark, feed, 2, inv, out)
    assert settlement.read_movements(spark, out).count() == 3
    # and in the state store form
    os.makedirs(f"{scratch}/feed")
    for i, part in enumerate((_feed(spark, ["paid", "paid", "PAID"]), _feed(spark, ["waiting", None, "paid"], 4))):
        part.coalesce(1).write.parquet(f"{scratch}/p{i}")
        for f in os.listdir(f"{scratch}/p{i}"):
            if f.endswith(".parquet"):
                os.link(f"{scratch}/p{i}/{f}", f"{scratch}/feed/{i}-{f}")
    settlement.start_stateful_settlement(spark, f"{scratch}/feed", inv, f"{scratch}/st", f"{scratch}/ck",
                                         max_files_per_trigger=1).awaitTermination()
    got = settlement.read_movements(spark, f"{scratch}/st").collect()
    assert len(got) == 3 and {str(r.mov_date) for r in got} == {"2024-01-01"}


def test_unreadable_state_is_an_error(spark, scratch):
    from tipflow.sources.sinks import committed
    assert committed(spark, f"{scratch}/none", "state") == []
    os.makedirs(f"{scratch}/bad/_commits")
    with open(f"{scratch}/bad/_commits/000000000001.json", "w") as fh:
        fh.write("not json")
    with pytest.raises(ValueError):
        committed(spark, f"{scratch}/bad", "state")


def _files(dirs, target):
    """Copy the parquet files of folders into one folder, in this order."""
    import shutil
    os.makedirs(target)
    for i, d in enumerate(dirs):
        for f in sorted(os.listdir(d)):
            if f.endswith(".parquet"):
                shutil.copy(os.path.join(d, f), os.path.join(target, f"{i:03d}-{f}"))
                os.utime(os.path.join(target, f"{i:03d}-{f}"), (1_700_000_000 + i, 1_700_000_000 + i))


RULES = [("daily", None, "1 day", 5), ("login", "login", "1 day", 1), ("quick", None, "15 minutes", 2)]


@pytest.mark.parametrize("order, watermark", [([0, 1, 2, 3, 4, 5], "30 days"), ([4, 0, 5, 2, 1, 3], "1 hour")])
def test_rate_limit_stream_equals_batch(spark, scratch, order, watermark):
    """In order, and shuffled so that whole files come long after their windows closed."""
    m = mart(spark, SF_SMALL)
    slices = _write_in_time_slices(m.request_log, "req_at", f"{scratch}/slices", n=6)
    _files([slices[i] for i in order], f"{scratch}/log")
    ratelimit.start_breach_stream(spark, f"{scratch}/log", f"{scratch}/sink", f"{scratch}/ckpt", watermark, rules=RULES,
                                  max_files_per_trigger=1).awaitTermination()
    streamed = ratelimit.read_breaches(spark, f"{scratch}/sink", RULES)
    batch = ch.rate_limit_breaches(m.request_log, RULES)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert batch.count() > 0
    late = ratelimit.late_records(spark, f"{scratch}/sink")
    assert (late.count() > 0) == (watermark == "1 hour")
    # nothing is lost: every record is in one window of the first rule
    counted = spark.read.parquet(f"{scratch}/sink").where("rule = 'daily'")
    if watermark == "1 hour":
        closed = counted.where("kind in ('closed', 'late')").agg(F.sum("n")).first()[0]
        assert closed <= m.request_log.count()


def test_stateful_settlement_equals_batch(spark, scratch):
    m = mart(spark, SF_SMALL)
    feed = m.status_feed.select("not_id", "new_status", "changed_at", "seq")
    slices = _write_in_time_slices(feed, "changed_at", f"{scratch}/slices")
    feed_dir = f"{scratch}/feed"
    os.makedirs(feed_dir)
    for i, d in enumerate(slices):
        for f in sorted(os.listdir(d)):
            if f.endswith(".parquet"):
                os.link(os.path.join(d, f), os.path.join(feed_dir, f"{i:03d}-{f}"))
    q = settlement.start_stateful_settlement(spark, feed_dir, m.invoice, f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination()
    streamed = settlement.read_movements(spark, f"{scratch}/out")
    batch = ch.settle_paid_invoices(m)["movements"]
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert streamed.count() > 0


def _statuses(spark, scratch, name, parts):
    """A folder of one file for each list of (not_id, status, day, seq)."""
    dirs = []
    for i, rows in enumerate(parts):
        df = spark.createDataFrame([(n, s, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), q) for n, s, d, q in rows],
                                   "not_id long, new_status string, changed_at timestamp, seq long")
        df.repartition(1).write.parquet(f"{scratch}/{name}-{i}")
        dirs.append(f"{scratch}/{name}-{i}")
    _files(dirs, f"{scratch}/{name}")
    return f"{scratch}/{name}"


def test_stateful_settlement_with_a_hot_invoice_and_closed_state(spark, scratch):
    import random
    rnd = random.Random(2)
    inv = spark.createDataFrame(
        [(i, "waiting", None, None, Decimal("9.00"), None, 1) for i in range(6)],
        "not_id long, charge_status string, status_updated_at timestamp, paid_value decimal(18,2), "
        "invoice_value decimal(18,2), settled_on date, ctb_id long")
    # invoice 0 sends most of the feed, in no order inside a file; files follow one another in time
    parts = [[(0 if rnd.random() < 0.6 else rnd.randint(1, 4), rnd.choice(["paid", "PAID", "waiting", None]), 10 * f + rnd.random() * 9,
               f * 10_000 + i) for i in range(4000)] for f in range(3)]
    # invoice 5: paid early, silent for long (its state closes), then the same raw text again, then a real payment
    parts[0].append((5, "paid", 1.0, 90_001))
    parts.append([(1, "waiting", 300.0, 90_002)])
    parts.append([(1, "waiting", 301.0, 90_003)])
    parts.append([(5, "paid", 310.0, 90_004), (5, "waiting", 311.0, 90_005), (5, "paid", 312.0, 90_006), (5, "paid", 0.5, 90_007)])
    feed_dir = _statuses(spark, scratch, "feed", parts)
    settlement.start_stateful_settlement(spark, feed_dir, inv, f"{scratch}/out", f"{scratch}/ck", keep="60 days",
                                         max_files_per_trigger=1).awaitTermination()
    late = settlement.read_late(spark, f"{scratch}/out").collect()
    assert [(r.not_id, r.seq) for r in late] == [(5, 90_007)]
    feed = spark.read.parquet(feed_dir).where("seq <> 90007")
    start = inv.select("not_id", F.col("charge_status").alias("start_status"))
    every = ch.settlement_fires(feed, start)
    settled = ch.first_fires(every).select("not_id", F.col("fire_at").alias("settled_at"))
    want = ch.movements_of(every.join(settled, "not_id"), inv)
    got = settlement.read_movements(spark, f"{scratch}/out")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.where("not_id = 5").count() == 2
    from tipflow.sources.sinks import committed, read_runs
    closed = read_runs(spark, committed(spark, f"{scratch}/out", "closed")).collect()
    assert 5 in {r.not_id for r in closed} and {r.last_status for r in closed if r.not_id == 5} == {"paid"}


def test_limit_stream_equals_batch_and_replay(spark, scratch):
    m = mart(spark, SF_SMALL)
    slices = _write_in_time_slices(m.limit_feed, "changed_at", f"{scratch}/slices")
    # the first file comes again at the end: its records are not newer than the state
    _files([*slices, slices[0]], f"{scratch}/feed")
    limits.start_limit_stream(spark, f"{scratch}/feed", m.tenant, m.collaborator, f"{scratch}/out", f"{scratch}/ck",
                              max_files_per_trigger=1).awaitTermination()
    got = limits.read_limited(spark, f"{scratch}/out")
    batch = ch.pix_limit_trigger(m)
    columns = ["usr_id", "cli_id", "day_value", "night_value"]
    assert sorted(got.select(columns).collect(), key=str) == sorted(batch.select(columns).collect(), key=str)
    assert batch.count() > 0
    # each record's changes are those of the trigger, run record by record
    feed = m.limit_feed.orderBy("changed_at", "seq").collect()
    last = {r.cli_id: r.pix_limit for r in m.tenant.collect()}
    values = {r.usr_id: [r.cli_id, r.day_value, r.night_value] for r in m.collaborator.collect()}
    want = set()
    for r in feed:
        old, last[r.cli_id] = last[r.cli_id], r.new_limit
        if old is None or r.new_limit is None or r.new_limit >= old:
            continue
        for usr, v in values.items():
            if v[0] == r.cli_id and any(x is not None and x > r.new_limit for x in v[1:]):
                v[1:] = [min(x, r.new_limit) if x is not None else None for x in v[1:]]
                want.add((usr, r.cli_id, *v[1:], r.seq))
    rows = spark.read.parquet(f"{scratch}/out").select(*columns, "seq").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
