"""Aggregate formulations checked against brute force on small fixtures, including hot keys."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tipflow.operators import changes as ch
from tipflow.operators.ids import number_within

STATUSES = ["paid", "PAID", "waiting", "active", "expired", "canceled", "settled"]


def brute_paid(start, records):
    """Walk the status history in order; a change of the raw text into 'paid' (any case) fires."""
    prev, fires = start, []
    for at, seq, status in sorted(records, key=lambda r: r[:2]):
        if (status or "").lower() == "paid" and status != prev:
            fires.append((at, seq))
        prev = status
    return fires


def test_settlement_fires_match_sequential_walk(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    starts, feed = {}, []
    seq = 0
    for inv in range(60):
        starts[inv] = rnd.choice(STATUSES + [None])
        n = 3000 if inv == 0 else rnd.randint(0, 12)   # invoice 0 holds most of the feed
        for _ in range(n):
            seq += 1
            feed.append((inv, rnd.choice(STATUSES), t0 + dt.timedelta(minutes=rnd.randint(0, 5000)), seq))
    feed_df = spark.createDataFrame(feed, "not_id long, new_status string, changed_at timestamp, seq long")
    start_df = spark.createDataFrame(list(starts.items()), "not_id long, start_status string")
    got = sorted((r.not_id, r.fire_at, r.fire_seq) for r in ch.settlement_fires(feed_df, start_df).collect())
    want = []
    for inv, start in starts.items():
        want += [(inv, *f) for f in brute_paid(start, [(at, s, st) for i, st, at, s in feed if i == inv])]
    assert got == sorted(want)
    assert len([w for w in want if w[0] == 0]) > 100
    first = {r.not_id: (r.fire_at, r.fire_seq) for r in ch.settlement_fires(feed_df, start_df, once=True).collect()}
    assert first == {i: min(w[1:] for w in want if w[0] == i) for i in {w[0] for w in want}}


def test_number_within_matches_row_number_with_skew(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 40), rnd.randint(0, 10**6), i) for i in range(20000)]
    df = spark.createDataFrame(rows, "g long, k long, id long")
    got = number_within(df, ["g"], ["k", "id"], "rn", one_task=1000)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted(got.select("g", "k", "id", "rn").collect()) == sorted(want.collect())


def test_rate_limit_windows_match_counting(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    log = [(i, 0 if rnd.random() < 0.5 else rnd.randint(1, 9), t0 + dt.timedelta(seconds=rnd.randint(0, 3600 * 6)),
            rnd.choice(["api", "login", "reset"])) for i in range(5000)]
    df = spark.createDataFrame(log, "req_id long, client_id long, req_at timestamp, route string")
    rules = [("general", None, "1 minute", 20), ("login", "login", "15 minutes", 15), ("reset", "reset", "15 minutes", 3)]
    got = {(r.client_id, r.rule, r.window_start): r.n for r in ch.rate_limit_breaches(df, rules).collect()}
    want = {}
    for name, route, width, limit in rules:
        minutes = int(width.split()[0])
        counts = {}
        for _, client, at, rt in log:
            if route and rt != route:
                continue
            start = at.replace(second=0, microsecond=0)
            start = start - dt.timedelta(minutes=start.minute % minutes)
            counts[(client, start)] = counts.get((client, start), 0) + 1
        for (client, start), n in counts.items():
            if n > limit:
                want[(client, name, start)] = n
    assert got == want and want
