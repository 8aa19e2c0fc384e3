"""Operators whose state lives in the state store, with timers on event time: order guards, dead man's switches and alert routing.

Entities are dealt over a fixed number of buckets by hash, and a bucket is a key of the state: a call into the store costs about as much as handling
a hundred rows, so a trigger's rows of a bucket are handled together, in the order of time and id, with a few calls for all its entities. What a
trigger leaves behind is appended to its buckets' state, packed as Arrow, and goes by timer once the watermark has passed the time for which it
matters. How many rows come together is bounded by what a trigger reads over the number of buckets.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state of these operators needs: a store on disk, whose memory is bounded for all tasks of an executor together.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
#: In how many buckets an operator's entities lie. It can't change for a query that has begun.
BUCKETS = 256


def _in_order(rows: Iterator[pd.DataFrame], at: str) -> pd.DataFrame:
    both = pd.concat(list(rows))
    both["us"] = both[at].astype("datetime64[us]").astype("int64") if both[at].dt.tz is None else both[at].dt.tz_convert("UTC").dt.tz_localize(None).astype("datetime64[us]").astype("int64")
    return both.sort_values(["us", "event_id"])


def _frame(rows: list[tuple], kinds: dict[str, str]) -> pd.DataFrame:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pd.DataFrame({c: pd.Series(list(values), dtype=k) for (c, k), values in zip(kinds.items(), columns, strict=True)})


class _Held:
    """A bucket's rows in a list of the state store: packed as Arrow, appended, never changed, and written anew by timer without what has gone."""

    PIECE = 50_000

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema) -> None:
        self.list, self.schema = handle.getListState(name, "packed binary"), schema

    def rows(self) -> Iterator[tuple]:
        if self.list.exists():
            for (packed,) in self.list.get():
                with pa.ipc.open_stream(bytes(packed)) as stream:
                    yield from zip(*[c.to_pylist() for c in stream.read_all().columns], strict=True)

    def _packed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for k in range(0, len(rows), self.PIECE):
            piece = [pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + self.PIECE], strict=True), self.schema, strict=True)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as stream:
                stream.write_batch(pa.record_batch(piece, schema=self.schema))
            out.append((sink.getvalue().to_pybytes(),))
        return out

    def add(self, rows: list[tuple]) -> None:
        if rows:
            self.list.appendList(self._packed(rows))

    def put(self, rows: list[tuple]) -> None:
        self.list.put(self._packed(rows)) if rows else self.list.clear()


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _dealt(stream: DataFrame, at: str, late: str, buckets: int):
    """The stream by bucket; entities travel as text, as pandas has no null among integers."""
    named = stream.withWatermark(at, late).withColumn("entity", F.col("entity").cast("string"))
    return named.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets))).groupBy("bucket")


class _Guard(StatefulProcessor):
    OUT = {"event_id": "int64", "duplicate": "bool", "halted": "bool", "far": "bool"}

    def __init__(self, limit: int, seconds: int, deviation: float, remembered_ms: int) -> None:
        self.limit, self.span, self.deviation, self.remembered_ms = limit, seconds * 1_000_000, deviation, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = _Held(handle, "seen", _schema(entity=pa.string(), name=pa.string(), us=pa.int64()))
        self.recent = _Held(handle, "recent", _schema(entity=pa.string(), us=pa.int64()))

    def _seen(self, limit_ms: int) -> dict[tuple, int]:
        """The keys used since then, with the time of their last use."""
        seen = {}
        for entity, name, us in self.seen.rows():
            if us // 1000 >= limit_ms and us >= seen.get((entity, name), us):
                seen[entity, name] = us
        return seen

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, watermark = _in_order(rows, "ts"), timerValues.getCurrentWatermarkInMs()
        seen, used, recents, out = self._seen(watermark - self.remembered_ms), {}, {}, []
        for entity, us in self.recent.rows():
            recents.setdefault(entity, []).append(us)
        for event, entity, name, now, price, ref in zip(*[batch[c].tolist() for c in ("event_id", "entity", "idempotency_key", "us", "price", "ref_price")], strict=True):
            recent = [x for x in recents.get(entity, ()) if now - x < self.span]
            before = [x for x in recent if x < now]
            halted = len(before) >= self.limit
            duplicate = (entity, name) in seen
            if not duplicate:
                recent = before[-self.limit :] + [x for x in recent if x >= now][-self.limit :] + [now]  # as many as the limit are enough to halt
            recents[entity] = recent
            if not duplicate or seen[entity, name] < now:
                seen[entity, name] = used[entity, name] = now
            far = bool(ref > 0 and abs(price / ref - 1) > self.deviation)
            out.append((event, duplicate, halted, far))
        self.seen.add([(entity, name, us) for (entity, name), us in used.items()])
        self.recent.put([(entity, us) for entity, recent in recents.items() for us in recent if us > watermark * 1000 - self.span])
        if next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(int(batch["us"].min() // 1000) + self.remembered_ms + 1)
        yield _frame(out, self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forget the keys that have been out of use for long enough, and come back when the oldest of the others will have."""
        limit = timerValues.getCurrentWatermarkInMs() - self.remembered_ms
        seen = self._seen(limit)
        self.seen.put([(entity, name, us) for (entity, name), us in seen.items()])
        if seen:
            # not more often than a quarter of the time, so that each entry is written anew a few times only
            self.handle.registerTimer(max(min(seen.values()) // 1000 + 1, limit + self.remembered_ms // 4) + self.remembered_ms)
        else:
            self.recent.put([])
        yield _frame([], self.OUT)

    def close(self) -> None:
        pass


def orders_guarded(stream: DataFrame, limit: int = 10, seconds: int = 60, deviation: float = 0.05, remembered_ms: int = 86_400_000, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """orders(event_id, entity, idempotency_key, ts, price, ref_price) -> event_id, duplicate, halted and far.

    A duplicate has a key that its entity used before; an order is halted if `limit` or more first ones came within the seconds before it; it is
    far if its price is off the reference by more than deviation. A key is forgotten remembered_ms after its last use, once the watermark has got
    there, whether or not its entity goes on ordering: what an active entity keeps is bounded by what it orders in 1.25 times that time.
    """
    guard = _Guard(limit, seconds, deviation, remembered_ms)
    return _dealt(stream, "ts", late, buckets).transformWithStateInPandas(guard, "event_id long, duplicate boolean, halted boolean, far boolean", "Append", "EventTime")


class _Switch(StatefulProcessor):
    OUT = {"entity": "object", "at_us": "int64", "mode": "object"}

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_us = timeout_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = _Held(handle, "open", _schema(entity=pa.string(), us=pa.int64()))

    def _open(self) -> dict[str | None, int]:
        """The entities that aren't closed, with their last heartbeat."""
        last = {}
        for entity, us in self.open.rows():
            last[entity] = max(us, last.get(entity, us))
        return last

    def _ends(self, us: int) -> int:
        return (us + self.timeout_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, beats, changes = self._open(), {}, []
        batch = _in_order(rows, "at")
        for entity, us in zip(batch["entity"].tolist(), batch["us"].tolist(), strict=True):
            before = last.get(entity)
            if before is not None and us - before > self.timeout_us:
                changes.append((entity, before + self.timeout_us, "CLOSE_ONLY"))
            if before is None or us - before > self.timeout_us:
                changes.append((entity, us, "NORMAL"))
            last[entity] = beats[entity] = us if before is None else max(us, before)
        self.open.add(list(beats.items()))
        due, first = self._ends(min(beats.values())), next(iter(self.handle.listTimers()), None)
        if first is None or due < first:
            self.handle.registerTimer(due)
        yield _frame(changes, self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Close and forget those whose time is over, and come back when the next one's will be."""
        watermark, last = timerValues.getCurrentWatermarkInMs(), self._open()
        gone = {entity for entity, us in last.items() if self._ends(us) <= watermark}
        left = [(entity, us) for entity, us in last.items() if entity not in gone]
        self.open.put(left)
        if left:
            self.handle.registerTimer(min(self._ends(us) for _, us in left))
        yield _frame([(entity, last[entity] + self.timeout_us, "CLOSE_ONLY") for entity in gone], self.OUT)

    def close(self) -> None:
        pass


def modes_switched(stream: DataFrame, timeout_ms: int = 300_000, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """beats(event_id, entity, at) -> entity, at_us, mode: every change of what an entity may do.

    A heartbeat opens (NORMAL); when none has come for more than timeout_ms, a timer on the watermark closes (CLOSE_ONLY, at the time at which the
    timeout ended), without any row of the entity. A silence that begins and ends within one batch gives the same two changes. A closed entity
    keeps no state.
    """
    changes = _dealt(stream, "at", late, buckets).transformWithStateInPandas(_Switch(timeout_ms), "entity string, at_us long, mode string", "Append", "EventTime")
    return changes.withColumn("entity", F.col("entity").cast("long"))


class Texts:
    """Texts with the time of their last use; which of them are like another, asked by length, then by letters, then in full."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.last: dict[str, int] = {}
        self.by_length: dict[int, dict[str, Counter]] = {}

    def add(self, text: str, us: int) -> None:
        self.last[text] = max(us, self.last.get(text, us))
        self.by_length.setdefault(len(text), {}).setdefault(text, Counter(text))

    def forget(self, before: int) -> None:
        for text in [x for x, us in self.last.items() if us < before]:
            del self.last[text], self.by_length[len(text)][text]
            if not self.by_length[len(text)]:
                del self.by_length[len(text)]

    def like(self, text: str, since: int) -> bool:
        """Whether a text used since then has a ratio of the threshold or more; equal ones have."""
        if self.last.get(text, since - 1) >= since:
            return True
        n, t = len(text), self.threshold
        letters = Counter(text)
        for m, texts in self.by_length.items():
            if not n or not m or 2 * min(n, m) < t * (n + m):
                continue
            for other, own in texts.items():
                if self.last[other] >= since and 2 * (letters & own).total() >= t * (n + m) - 1e-9 and difflib.SequenceMatcher(None, other, text).ratio() >= t:
                    return True
        return False


class _Alerts(StatefulProcessor):
    DAY, HOUR = 86_400_000_000, 3_600_000_000
    OUT = {"event_id": "int64", "entity": "object", "routed": "object", "digest": "object"}

    def __init__(self, hourly: int, threshold: float) -> None:
        self.hourly, self.threshold = hourly, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = _Held(handle, "recent", _schema(entity=pa.string(), norm=pa.string(), us=pa.int64()))
        self.hour = _Held(handle, "hour", _schema(entity=pa.string(), us=pa.int64(), event_id=pa.int64(), counts=pa.bool_()))

    def _recent(self, since: int) -> dict[tuple[str | None, str], int]:
        """The texts used since then by entity, with the time of their last use."""
        recent = {}
        for entity, norm, us in self.recent.rows():
            if us >= since:
                recent[entity, norm] = max(us, recent.get((entity, norm), us))
        return recent

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, watermark = _in_order(rows, "created_at"), timerValues.getCurrentWatermarkInMs() * 1000
        texts: dict[str | None, Texts] = {}
        for (entity, norm), us in self._recent(watermark - self.DAY).items():
            texts.setdefault(entity, Texts(self.threshold)).add(norm, us)
        hours, swept, used, out = {}, {}, {}, []
        for entity, *h in self.hour.rows():
            hours.setdefault(entity, []).append(tuple(h))
        for event, entity, us, norm, severity in zip(*[batch[c].tolist() for c in ("event_id", "entity", "us", "norm", "severity")], strict=True):
            own, at_once = texts.setdefault(entity, Texts(self.threshold)), severity == "P0"
            if us - swept.setdefault(entity, us) > self.DAY // 4:  # rows come in order, so what is a day older than this one is asked for no more
                own.forget(us - self.DAY)
                swept[entity] = us
            if not at_once and own.like(norm, us - self.DAY):
                out.append((event, entity, "suppressed", None))
                continue
            own.add(norm, us)
            used[entity, norm] = own.last[norm]
            hour = hours[entity] = [h for h in hours.get(entity, ()) if us - h[0] < self.HOUR] + [(us, event, not at_once)]
            gathered = not at_once and sum(h[2] for h in hour) > self.hourly
            out.append((event, entity, "digest" if gathered else "sent", ",".join(str(h[1]) for h in hour) if gathered else None))
        self.recent.add([(entity, norm, us) for (entity, norm), us in used.items()])
        self.hour.put([(entity, *h) for entity, hour in hours.items() for h in hour if h[0] > watermark - self.HOUR])
        if next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer((int(batch["us"].min()) + self.DAY) // 1000 + 1)
        yield _frame(out, self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forget the texts of over a day ago, and come back when the oldest of the others will be."""
        limit = timerValues.getCurrentWatermarkInMs() * 1000 - self.DAY
        recent = self._recent(limit)
        self.recent.put([(entity, norm, us) for (entity, norm), us in recent.items()])
        if recent:
            self.handle.registerTimer((max(min(recent.values()) + 1000, limit + self.DAY // 4) + self.DAY) // 1000)
        else:
            self.hour.put([])
        yield _frame([], self.OUT)

    def close(self) -> None:
        pass


def alerts_routed(stream: DataFrame, hourly: int = 5, threshold: float = 0.85, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """alerts(event_id, entity, severity, norm, created_at) -> event_id, entity, routed and digest: the ids of the entity's last hour, if routed into one.

    P0 is always sent. Others are suppressed if their entity had an equal text, or one of a ratio of the threshold, within a day; of the rest, more than
    `hourly` in an hour become digests. An entity keeps its texts of the last day and its last hour; both go by timer.
    """
    routed = _dealt(stream, "created_at", late, buckets).transformWithStateInPandas(_Alerts(hourly, threshold), "event_id long, entity string, routed string, digest string", "Append", "EventTime")
    return routed.withColumn("entity", F.col("entity").cast("long"))
