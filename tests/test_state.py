"""State that goes: order guards, dead man's switches and deduplication, by what the query says about its batches."""

import datetime as dt
import random

from tidemark.operators.text import Router
from tidemark.plans.streams import st_alert_router
from tidemark.plans.views import Tables
from tidemark.streaming import processors, streams

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_an_active_entity_keeps_what_it_ordered_lately_only(spark):
    """One entity orders a new key a minute for ten hours and remembers keys for one."""
    rows = [(i, 1, f"k{i}", at(i), 100.0, 100.0) for i in range(600)] + [(1000 + i, 1, f"k{i}", at(i + 30.5), 100.0, 100.0) for i in range(0, 600, 10)]
    rows += [(2000, 1, "k5", at(500.2), 100.0, 100.0), (2001, 2, "k5", at(3.0), 100.0, 0.0)]
    df = spark.createDataFrame(rows, "event_id long, entity long, idempotency_key string, ts timestamp, price double, ref_price double")
    said = []
    stream = streams.as_ordered_stream(df, "orders", "ts", 12)
    got = {r["event_id"]: r["duplicate"] for r in streams.drained(processors.orders_guarded(stream, remembered_ms=3_600_000), "guarded", conf=processors.STORE, progress_of=said).collect()}
    assert not any(got[i] for i in range(600)) and all(got[1000 + i] for i in range(0, 600, 10))  # within the hour
    assert not got[2000] and not got[2001]  # forgotten; another entity's
    held = [p["stateOperators"][0]["numRowsTotal"] for p in said if p["stateOperators"]]
    assert len(held) >= 12 and max(held) < 300 and min(held[-2:]) < 250  # of 600 keys; some entries are timers


def test_silence_closes_by_timer_without_a_new_row(spark):
    beats = [(1, 1, at(0)), (2, 1, at(4)), (3, 1, at(30)), (4, 2, at(1)), (5, 3, at(0)), (6, 3, at(5)), (7, 1, at(33)), (8, 4, at(59.9))]
    df = spark.createDataFrame(beats, "event_id long, entity long, at timestamp")
    for batches in (1, 2, 8):
        out = streams.drained(processors.modes_switched(streams.as_ordered_stream(df, "beats", "at", batches)), "modes", conf=processors.STORE)
        got = sorted((r["entity"], (r["at_us"] - int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)) / 6e7, r["mode"]) for r in out.collect())
        assert got == [(1, 0, "NORMAL"), (1, 9, "CLOSE_ONLY"), (1, 30, "NORMAL"), (1, 38, "CLOSE_ONLY"), (2, 1, "NORMAL"), (2, 6, "CLOSE_ONLY"), (3, 0, "NORMAL"), (3, 10, "CLOSE_ONLY"), (4, 59.9, "NORMAL")], (batches, got)


def test_keys_are_forgotten_and_late_replays_go_apart(spark):
    rows = [(i, at(10 * i), at(10 * i)) for i in range(200)] + [(i, at(10 * i), at(10 * i + 15)) for i in range(0, 200, 2)] + [(i, at(10 * i), at(2100)) for i in (0, 1, 2, 195)] + [(0, at(0), at(2100))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, sent timestamp")
    fresh, late = streams.drained_in_time(streams.as_ordered_stream(df, "envelopes", "sent", 20), "in-time", "ts", 7200)
    said = []
    once = streams.drained(streams.deduplicated(fresh, "event_id", "ts", "2 hours"), "deduped", progress_of=said)
    assert sorted(r["event_id"] for r in once.collect()) == list(range(200))
    assert sorted(r["event_id"] for r in late.collect()) == [0, 0, 1, 2]
    states = [p["stateOperators"][0] for p in said if p["stateOperators"]]
    assert sum(s["numRowsRemoved"] for s in states) > 100 and max(s["numRowsTotal"] for s in states) < 80 and states[-1]["numRowsTotal"] < 80


def routed_one_by_one(rows):
    """The sequential rule: (event_id, entity, severity, norm, created_at) -> event_id: routed."""
    routers, out = {}, {}
    for i, entity, severity, norm, when in sorted(rows, key=lambda r: (r[4], r[0])):
        out[i] = routers.setdefault(entity, Router()).route(when.timestamp(), severity, norm)
    return out


def test_alerts_are_routed_as_one_by_one_and_old_texts_go(spark):
    draw = random.Random(12)
    words = ["pricefell", "volumerose", "boardresigned", "profitwarning", "courtruling", "merger", ""]
    rows = [(i, draw.choice((1, 1, 1, 2)), draw.choice(("P0", "P1", "P2", "P2")), draw.choice(words) + draw.choice(words) + draw.choice(("", "x", str(i), f"of{i}and{i * 7}")), at(11 * i + draw.randrange(9))) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, entity long, severity string, norm string, created_at timestamp")
    for batches in (1, 9):
        said = []
        out = streams.drained(processors.alerts_routed(streams.as_ordered_stream(df, "alerts", "created_at", batches)), "routed", conf=processors.STORE, progress_of=said).collect()
        got = {r["event_id"]: r["routed"] for r in out}
        assert got == routed_one_by_one(rows) and set(got.values()) == {"sent", "suppressed", "digest"}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in said if p["stateOperators"]]
    assert max(held) < 500 and sum(p["stateOperators"][0]["numRowsRemoved"] for p in said if p["stateOperators"]) >= 0


def test_the_alert_query_equals_the_sequential_rule(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    from tidemark.operators import text as tx
    from pyspark.sql import functions as F

    given = t.alerts.select("event_id", "entity", "severity", tx.normalized_summary(F.col("summary")).alias("norm"), F.col("created_at").cast("timestamp").alias("at")).collect()
    assert {r["event_id"]: r["routed"] for r in st_alert_router(t).collect()} == routed_one_by_one([tuple(r) for r in given])
