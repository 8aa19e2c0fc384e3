"""Streams whose cost a row must not grow: state by bucket in place of state by entity, and batches of several files."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from tidemark.catalogue import SQL
from tidemark.operators.text import Router
from tidemark.plans.streams import st_dedupe
from tidemark.plans.views import Tables
from tidemark.streaming import processors, streams

START = dt.datetime(2024, 1, 1)
BIG = 2**60 + 1  # ids that a double can't hold, beside one that is null


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def entries(said):
    return max(p["stateOperators"][0]["numRowsTotal"] for p in said if p["stateOperators"])


def test_orders_of_many_entities_share_a_bucket(spark):
    draw = random.Random(21)
    who = [None, BIG, BIG + 1, *range(300)]
    rows = [(i, draw.choice(who), f"k{draw.randrange(4)}", at(i / 10), float(draw.choice((100, 104, 120))), 100.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, entity long, idempotency_key string, ts timestamp, price double, ref_price double")
    said = []
    stream = streams.as_ordered_stream(df, "orders", "ts", 3)
    out = streams.drained(processors.orders_guarded(stream, limit=1, buckets=4), "guarded", conf=processors.STORE, progress_of=said)
    got = {r["event_id"]: (r["duplicate"], r["halted"], r["far"]) for r in out.collect()}
    seen, recent, want = set(), [], {}
    for i, e, key, ts, price, ref in rows:
        recent = [(x, t) for x, t in recent if (ts - t).total_seconds() < 60]
        want[i] = ((e, key) in seen, any(x == e and t < ts for x, t in recent), abs(price / ref - 1) > 0.05)
        if (e, key) not in seen:
            seen.add((e, key))
            recent.append((e, ts))
    assert got == want and {x[0] for x in want.values()} == {x[1] for x in want.values()} == {True, False}
    assert entries(said) < 60  # of over 300 entities and 900 keys


def test_beats_of_many_entities_share_a_bucket_and_closed_ones_keep_nothing(spark):
    draw = random.Random(22)
    who = [None, BIG, BIG + 1, *range(300)]
    rows = [(i, draw.choice(who), at(i / 10)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, entity long, at timestamp")
    us = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    want, last, end = [], {}, us(rows[-1][2])
    for _, e, t in rows:
        if e not in last or us(t) - last[e] > 300_000_000:
            want += [(e, us(t), "NORMAL")] + ([(e, last[e] + 300_000_000, "CLOSE_ONLY")] if e in last else [])
        last[e] = us(t)
    want += [(e, x + 300_000_000, "CLOSE_ONLY") for e, x in last.items() if (x + 300_000_000) // 1000 + 1 <= end // 1000]
    for batches in (1, 5):
        said = []
        out = streams.drained(processors.modes_switched(streams.as_ordered_stream(df, "beats", "at", batches), buckets=4), "modes", conf=processors.STORE, progress_of=said)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr), batches
        assert entries(said) < 60


def test_alerts_of_many_entities_share_a_bucket(spark):
    draw = random.Random(23)
    who = [None, BIG, BIG + 1, *range(200)]
    words = ["pricefell", "volumerose", "boardresigned", "profitwarning", "courtruling", "merger"]
    rows = [(i, draw.choice(who), draw.choice(("P0", "P1", "P2")), draw.choice(words) + draw.choice(("", "x", str(i))), at(4 * i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, entity long, severity string, norm string, created_at timestamp")
    said = []
    stream = streams.as_ordered_stream(df, "alerts", "created_at", 3)
    got = {r["event_id"]: (r["entity"], r["routed"]) for r in streams.drained(processors.alerts_routed(stream, buckets=4), "routed", conf=processors.STORE, progress_of=said).collect()}
    routers = {}
    assert got == {i: (e, routers.setdefault(e, Router()).route(t.timestamp(), severity, norm)) for i, e, severity, norm, t in rows}
    assert entries(said) < 60


def test_a_batch_of_several_files_is_one_trigger(spark):
    rows = [(i, at(i)) for i in range(200)] + [(1000, at(399)), (1001, at(800))]  # full batches, one of one row, an empty one, one of one row
    df = spark.createDataFrame(rows, "event_id long, at timestamp")
    seen = []
    stream = streams.as_ordered_stream(df, "several", "at", 8, rows_a_file=10)
    out = streams.drained(stream.withColumn("x", F.lit(1)), "out", progress_of=seen)
    assert sorted(r["event_id"] for r in out.collect()) == sorted(r[0] for r in rows)
    assert [p["numInputRows"] for p in seen if p["sources"]][:8] == [101, 99, 0, 1, 0, 0, 0, 1]


def test_hours_are_twelve_panes(spark):
    draw = random.Random(24)
    calls = [(draw.randrange(3), START + dt.timedelta(seconds=draw.randrange(20_000), microseconds=draw.randrange(10**6))) for _ in range(300)]
    df = spark.createDataFrame(calls, "user_id long, ts timestamp")
    panes = streams.counted(streams.as_ordered_stream(df, "calls", "ts"), "ts", ["user_id"], "5 minutes", late="25 hours")
    rates = streams.hourly_rates(streams.drained_updates(panes, "rates", ["start", "user_id"], processors.STORE, by="user_id", rows_a_task=50), "user_id")
    assert str(rates._jdf.queryExecution().executedPlan()).count("Exchange") == 1
    got = {(r["user_id"], r["start"]): r["n"] for r in rates.collect()}
    want = {(r["user_id"], r["w"]["start"]): r["n"] for r in df.groupBy("user_id", F.window("ts", "1 hour", "5 minutes").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want and len(want) > 200


def test_a_batch_of_several_files_is_deduplicated_whole(spark):
    """Batches of fifteen days in files that each hold all of these days: a file mustn't make the rest of its batch late."""
    rows = [(i, at(60 * i), at(60 * i)) for i in range(1440)] + [(i, at(60 * i), at(60 * i + 60)) for i in range(0, 1440, 3)] + [(i, at(60 * i), at(60 * 1442)) for i in range(0, 1440, 7)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, sent timestamp")
    for given in ({}, {"rows_a_file": 100}):
        fresh, late = streams.drained_in_time(streams.as_ordered_stream(df, "envelopes", "sent", 4, rows_a_file=60), "in-time", "ts", 86_400, **given)
        said = []
        once = streams.drained(streams.deduplicated(fresh, "event_id", "ts", "1 day"), "deduped", progress_of=said)
        assert sorted(r["event_id"] for r in once.collect()) == list(range(1440))
        assert len([p for p in said if p["numInputRows"]]) == 4 and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in said if p["stateOperators"]) == 0
        low, high = 0, 60 * 1442 + 1
        batch = lambda i: 60 * i * 4 // (high - low)
        last = max(i for i in range(1440) if batch(i) < 3)  # the latest before the last batch, which all third deliveries are in
        assert sorted(r["event_id"] for r in late.collect()) == [i for i in range(0, 1440, 7) if i < last - 24]


def test_deliveries_without_id_or_time_or_of_an_id_used_again(spark, tmp_path):
    """No id is a group like any other, an id that comes again after days is kept, and a delivery without a time is neither kept nor late."""
    rows = [(i, at(600 * i)) for i in range(1, 100)] + [(None, at(3)), (None, at(50_000)), (2, at(40_000)), (14, at(59_000)), (700, None), (701, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["kept"], r["n_late"]) for r in st_dedupe(Tables(spark, str(tmp_path))).collect()}
    with duckdb.connect() as db:
        db.sql("SET TimeZone = 'UTC'")
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = {i: (kept, n) for i, kept, n in db.sql(SQL["st_dedupe"]).fetchall()}
    assert got == want and got[700] == (False, 0) and 701 not in got and got[None][0] and got[2][0] and got[14][1] == 1
