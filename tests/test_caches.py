"""Caches updated in place: prices by month behind a pointer, flows by date."""

import datetime as dt
import math
import os

import pytest

from tidemark.sources import caches

DAY = dt.date(2024, 1, 1)
SCHEMA = "d date, asset string, close double"


def days(spark, asset, prices, start=0):
    return spark.createDataFrame([(DAY + dt.timedelta(days=start + i), asset, None if p is None else float(p)) for i, p in enumerate(prices)], SCHEMA)


def stored(spark, path):
    return {(r["asset"], (r["d"] - DAY).days): r["close"] for r in caches.read(spark, path).collect()}


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_two_updates_write_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert caches.read(spark, path).count() == 0
    first = days(spark, "A", [100 + i % 7 for i in range(75)]).unionByName(days(spark, "B", [50] * 10, start=3))
    assert caches.update_prices(first, path) == ["2024-01", "2024-02", "2024-03"]
    got = stored(spark, path)
    assert got["A", 74] == 100 + 74 % 7 and got["B", 3] == 50 and ("B", 2) not in got and got["B", 74] == 50  # filled to the end of the calendar
    before = files_of(path)
    fresh = days(spark, "A", [None, 104.5, 103.0], start=73).unionByName(days(spark, "C", [7, 7.5], start=74))
    assert caches.update_prices(fresh, path) == ["2024-03"]
    got = stored(spark, path)
    assert got["A", 73] == 100 + 73 % 7 and got["A", 74] == 104.5 and got["A", 75] == 103 and got["B", 75] == 50 and got["C", 75] == 7.5 and ("C", 73) not in got
    assert set(before) < set(files_of(path))  # nothing that was there was rewritten
    after = files_of(path)
    assert caches.update_prices(fresh, path) == [] and set(stored(spark, path).items()) == set(got.items())
    assert set(caches.pointer(spark, path)) == {"2024-01", "2024-02", "2024-03"} and len(set(caches.pointer(spark, path).values())) == 2
    assert len([f for f in files_of(path) if f.endswith(".parquet")]) == len([f for f in after if f.endswith(".parquet")])


def test_a_jump_rebases_the_whole_past_of_its_asset_alone(spark, tmp_path):
    path = str(tmp_path / "cache")
    caches.update_prices(days(spark, "X", [100, 102] * 20).unionByName(days(spark, "Y", [10] * 40)), path)
    caches.update_prices(days(spark, "X", [25.5, 26], start=40).unionByName(days(spark, "Y", [2], start=40)), path, repairable="asset = 'X'")
    got = stored(spark, path)
    assert math.isclose(got["X", 0], 25) and math.isclose(got["X", 39], 25.5) and got["X", 41] == 26
    assert got["Y", 39] == 10 and got["Y", 40] == got["Y", 41] == 2
    assert caches.update_prices(days(spark, "X", [26], start=41), path, repairable="asset = 'X'") == []


def test_an_interrupted_update_leaves_the_old_cache(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    caches.update_prices(days(spark, "A", [1.0, 1.1, 1.2]), path)
    old = stored(spark, path)

    def stop(*_):
        raise RuntimeError("lost")

    publish = caches._publish
    monkeypatch.setattr(caches, "_publish", stop)
    with pytest.raises(RuntimeError, match="lost"):
        caches.update_prices(days(spark, "A", [1.3], start=3), path)
    assert stored(spark, path) == old
    os.makedirs(f"{path}/pointers/2")  # a pointer without its success mark
    assert stored(spark, path) == old
    monkeypatch.setattr(caches, "_publish", publish)
    caches.update_prices(days(spark, "A", [1.3], start=3), path)
    assert stored(spark, path)["A", 3] == 1.3
    assert len(caches.vacuum(spark, path)) >= 1 and stored(spark, path)["A", 3] == 1.3 and len(os.listdir(f"{path}/data")) == len(set(caches.pointer(spark, path).values()))


def test_of_two_writers_from_one_pointer_the_later_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    caches.update_prices(days(spark, "A", [1.0]), path)
    monkeypatch.setattr(caches, "_generation", lambda *_: 0)  # as the other writer saw it
    with pytest.raises(Exception, match="(?i)already exists"):
        caches.update_prices(days(spark, "A", [2.0]), path)
    monkeypatch.undo()
    assert stored(spark, path) == {("A", 0): 1.0}


def test_flows_go_in_by_missing_date_and_a_rerun_writes_no_file(spark, tmp_path):
    path = str(tmp_path / "flows")
    shape = "d date, asset string, total_net double, seq int"
    rows = [(DAY, "A", 1.0, 0), (DAY, "A", 2.0, 1), (DAY, "B", 3.0, 0), (DAY + dt.timedelta(days=1), "A", 4.0, 0)]
    assert caches.update_flows(spark.createDataFrame(rows, shape), path) == 2
    read = lambda: sorted((r["d"].day, r["asset"], r["total_net"]) for r in caches.flows(spark, path, shape).collect())
    assert read() == [(1, "A", 2.0), (1, "B", 3.0), (2, "A", 4.0)]
    before = {f: os.path.getmtime(f) for f in files_of(path)}
    assert caches.update_flows(spark.createDataFrame([(DAY, "A", 99.0, 9)], shape), path) == 0
    assert {f: os.path.getmtime(f) for f in files_of(path)} == before
    assert caches.update_flows(spark.createDataFrame([(DAY, "A", 99.0, 9), (DAY + dt.timedelta(days=2), "C", 5.0, 0)], shape), path) == 1
    assert read() == [(1, "A", 2.0), (1, "B", 3.0), (2, "A", 4.0), (3, "C", 5.0)]
    assert caches.update_flows(spark.createDataFrame([], shape), path) == 0
