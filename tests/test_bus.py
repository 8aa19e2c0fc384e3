"""Events: groups apart, batches that fail and come again, replay from a point; snapshots: both tables move at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups
from tidemark.sources import caches, snapshots
from tidemark.streaming import bus

START = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
ROW = "n long, stream string, note string, at timestamp"


def envelopes(spark, numbers, stream="signals"):
    df = spark.createDataFrame([(i, stream, f"註 \"{i}\"\n" if i else None, START + dt.timedelta(seconds=i)) for i in numbers], ROW)
    return bus.wrapped(df, F.col("stream"), F.lit("signal.made"), ["note", "n"], F.col("at"), F.lit("run-1"))


def numbers(events):
    return sorted(r[0] for r in events.select(F.get_json_object("payload", "$.n").cast("long")).collect())


def test_groups_have_progress_of_their_own_and_replay_none(spark, tmp_path):
    path, desk, audit = f"{tmp_path}/bus", f"{tmp_path}/desk", f"{tmp_path}/audit"
    first = bus.publish(envelopes(spark, range(20)), path)
    bus.publish(envelopes(spark, range(5), "alerts"), path)
    bus.consume(spark, path, "desk", bus.into(desk), "signals")
    second = bus.publish(envelopes(spark, range(20, 30)), path)
    assert numbers(bus.kept(spark, desk)) == list(range(20)) and numbers(bus.pending(spark, path, bus.kept(spark, desk), "signals")) == list(range(20, 30))
    bus.consume(spark, path, "desk", bus.into(desk), "signals")
    bus.consume(spark, path, "desk", bus.into(desk), "signals")  # nothing new
    bus.consume(spark, path, "audit", bus.into(audit))
    assert numbers(bus.kept(spark, desk)) == list(range(30)) and numbers(bus.kept(spark, audit)) == sorted([*range(30), *range(5)])
    assert bus.pending(spark, path, bus.kept(spark, audit)).isEmpty()
    whole = bus.replay(spark, path, "signals").orderBy("message_id").collect()
    assert whole == bus.replay(spark, path, "signals").orderBy("message_id").collect() and len({r["message_id"] for r in whole}) == 30
    assert whole[3]["produced_at"] == START + dt.timedelta(seconds=3) and whole[3]["fault"] is None  # to the microsecond
    assert {(r["event_id"], r["idempotency_key"]) for r in envelopes(spark, range(30)).collect()} == {(r["event_id"], r["idempotency_key"]) for r in whole}
    assert first < second and numbers(bus.replay(spark, path, "signals", since=second)) == list(range(20, 30))
    point = whole[25]["message_id"]
    assert numbers(bus.replay(spark, path, "signals", since=point)) == sorted(int(r["payload"].split('"n":')[1].split(",")[0].rstrip("}")) for r in whole[25:])


def test_a_batch_that_fails_is_not_acknowledged_and_comes_again_alone(spark, tmp_path):
    path, done = f"{tmp_path}/bus", f"{tmp_path}/done"
    for k in range(3):
        bus.publish(envelopes(spark, range(10 * k, 10 * k + 10)).coalesce(1), path)
    broken, calls = [True], []

    def handle(events, number):
        calls.append(number)
        if number == 1 and broken[0]:
            raise ValueError("the desk is away")
        bus.into(done)(events, number)

    with pytest.raises(Exception, match="the desk is away"):
        bus.consume(spark, path, "desk", handle, files=1)
    had = numbers(bus.kept(spark, done))
    assert len(had) == 10
    broken[0] = False
    bus.consume(spark, path, "desk", handle, files=1)
    assert numbers(bus.kept(spark, done)) == list(range(30)) and calls[:3] == [0, 1, 1]


def test_envelopes_must_be_whole(spark, tmp_path):
    path = f"{tmp_path}/bus"
    bus.publish(envelopes(spark, [1]), path)
    for column, value, name in (("stream", "a/b", "stream"), ("stream", None, "stream"), ("event_type", "", "event_type"), ("schema_version", 0, "schema_version"), ("produced_at", None, "produced_at")):
        wrong = envelopes(spark, [2, 3])
        kind = wrong.schema[column].dataType
        assert [r[0] for r in wrong.withColumn(column, F.lit(value).cast(kind)).select(bus.fault()).collect()] == [name] * 2
        with pytest.raises(Exception, match="an envelope without a right"):
            bus.publish(wrong.withColumn(column, F.lit(value).cast(kind)), path)
    spark.createDataFrame([("not json",), ('{"stream":"signals"}',), ("",)], "value string").write.text(f"{path}/publication={'9' * 20}-00000000/stream=signals")
    got = sorted((r["raw"], r["fault"]) for r in bus.replay(spark, path).where("fault is not null").collect())
    assert [g for g in got if g[0]] == [("not json", "stream"), ('{"stream":"signals"}', "event_id")]
    assert numbers(bus.replay(spark, path).where("fault is null")) == [1]


def test_no_envelopes(spark, tmp_path):
    path = f"{tmp_path}/bus"
    bus.consume(spark, path, "early", bus.into(f"{tmp_path}/early"))  # a group may come before the first publication
    bus.publish(envelopes(spark, []), path)
    bus.publish(envelopes(spark, [7]), path)
    bus.consume(spark, path, "early", bus.into(f"{tmp_path}/early"))
    assert numbers(bus.kept(spark, f"{tmp_path}/early")) == [7]


def ranking(spark, day, score, frequencies=("Daily", "Weekly")):
    return spark.createDataFrame([(day, f, a, score + i, None if i else "x, \"y\"\nz") for f in frequencies for i, a in enumerate("AB")], KINDS)


KINDS = "signal_date date, frequency string, asset string, score double, note string"


def test_dated_and_latest_snapshots_move_at_once(spark, tmp_path, monkeypatch):
    path, day = f"{tmp_path}/snapshots", dt.date(2024, 1, 5)
    assert snapshots.latest(spark, path, KINDS).isEmpty() and snapshots.dated(spark, path, KINDS).isEmpty()
    assert snapshots.publish(ranking(spark, day, 1.0), path) == ["Daily@2024-01-05", "Weekly@2024-01-05"]
    later = dt.date(2024, 1, 8)
    snapshots.publish(ranking(spark, later, 5.0, ("Daily",)), path)
    last = sorted((r["frequency"], r["signal_date"], r["asset"], r["score"], r["note"]) for r in snapshots.latest(spark, path, KINDS).collect())
    assert [r[4] for r in last] == ['x, "y"\nz', None] * 2
    assert [r[:4] for r in last] == [("Daily", later, "A", 5.0), ("Daily", later, "B", 6.0), ("Weekly", day, "A", 1.0), ("Weekly", day, "B", 2.0)]
    assert snapshots.dated(spark, path, KINDS).count() == 6
    snapshots.publish(ranking(spark, later, 7.0, ("Daily",)), path)  # the same date again replaces its part
    assert snapshots.dated(spark, path, KINDS).count() == 6
    before = sorted(map(tuple, snapshots.latest(spark, path, KINDS).drop("note").collect()))
    assert (later, "Daily", "A", 7.0) in before

    def stop(*_):
        raise OSError("interrupted")

    monkeypatch.setattr(caches, "_publish", stop)
    with pytest.raises(OSError):
        snapshots.publish(ranking(spark, dt.date(2024, 1, 9), 9.0), path)
    assert sorted(map(tuple, snapshots.latest(spark, path, KINDS).drop("note").collect())) == before and snapshots.dated(spark, path, KINDS).count() == 6


def test_keyed_rotation_equals_one_frequency_at_a_time(spark):
    rows = [(f, dt.date(2020, 1, 1) + dt.timedelta(days=i), i + 1, a, "g" + str(o % 2), o, 50 + o + ((i * (o + 2) * 7) % 13) / (1 + k)) for k, f in enumerate(("Daily", "Weekly")) for i in range(40 - 9 * k) for o, a in enumerate("NABCD")]
    rows = [r[:-1] + (None if r[5] and r[2] % 11 == r[5] else float(r[-1]),) for r in rows]
    grid = spark.createDataFrame(rows, "frequency string, d date, pos long, asset string, grp string, ord int, close double")
    windows = {"Daily": (9, 3), "Weekly": (5, 2), "Yearly": (4, 2)}
    got = groups.rotation_summaries(grid.where("ord > 0"), grid.where("ord = 0"), windows)
    for f in ("Daily", "Weekly"):
        one = grid.where(F.col("frequency") == f).drop("frequency")
        long, short = windows[f]
        wanted = groups.rotation_summary(one.where("ord > 0"), one.where("ord = 0"), short, long, short).collect()
        mine = got.where(F.col("frequency") == f).orderBy("place").drop("frequency", "place").collect()
        assert len(wanted) == 2 and [tuple(r) for r in mine] == [tuple(r) for r in wanted]
    assert got.count() == 4
