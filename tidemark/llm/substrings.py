"""Substring dedup by recompression: locally consistent parsing names runs and pairs, and shared names reveal long repeats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_of, hash_words, lean, mix64, numbered, slices, split_all, table
from .graph import signed

WINDOW = 13
#: Rounds of pair naming after the round of run naming. A symbol of round 3 has up to 8 words and hangs on 10; one of round 4, on more than a window.
ROUNDS = 3
FAR = 1 << 40
#: Keys of one pack of texts; bounds a worker's memory.
PACKED = 1_500_000
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW words from each place on; the last places', and those across texts, mean nothing."""
    h = np.zeros(len(words), np.uint64)
    for k in range(min(WINDOW, len(words))):
        h[: len(words) - k] = mix64(h[: len(words) - k] * GOLDEN + words[k:] + np.uint64(k + 1))
    return h


def anchors(words: np.ndarray, text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A key for the window at each place, the same for equal windows: the name of a symbol inside it, or its own hash.

    Round 0 names maximal runs of equal words. Each later round splits the symbols into left and right ones by a bit of their
    names' hash and names every left one with a right one behind it as a pair. Names are hashes of the contents, so that all tasks
    agree on them. Each symbol carries the stretch of words that its making hangs on, neighbours included; within a window,
    a symbol whose whole stretch lies inside is there in every copy of the window. Of those, the window's key is the one of the most
    words, then of the largest hash: the longer a symbol, the rarer is it shared by chance. words: hashes; text: the text of each place, rising.
    """
    n = len(words)
    best = np.zeros(n, np.uint64)
    if not n:
        return best

    def joined(left: np.ndarray) -> np.ndarray:
        """Whether each symbol and the next one are of the same text."""
        return left[1:] == left[:-1]

    def offer(name: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        fits = high - low <= WINDOW
        name, low, high, size = name[fits], low[fits], high[fits], size[fits]
        worth = (size.astype(np.uint64) << np.uint64(60)) | (mix64(name) >> np.uint64(4))
        for k in range(WINDOW):  # windows that start k words before the stretch
            start = low - k
            ok = (start >= 0) & (start + WINDOW >= high)
            np.maximum.at(best, start[ok], worth[ok])

    starts = np.flatnonzero(np.r_[True, ~((words[1:] == words[:-1]) & joined(text))])
    ends = np.r_[starts[1:], n]
    name = np.where(ends - starts > 1, mix64(words[starts] + GOLDEN * (ends - starts).astype(np.uint64)), words[starts])
    own, size = text[starts], ends - starts
    same = joined(own)
    low = np.where(np.r_[False, same], starts - 1, -FAR)  # a run's ends show by what stands beside them
    high = np.where(np.r_[same, False], ends + 1, FAR)
    for r in range(1, ROUNDS + 1):
        right = (mix64(name ^ np.uint64(int(GOLDEN) * r & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
        same = joined(own)
        pair = np.r_[~right[:-1] & right[1:] & same, False]
        second = np.r_[False, pair[:-1]]
        # a left one without a right one behind it hangs on the next, a right one on the one before
        after_low, after_high = np.r_[np.where(same, low[1:], -FAR), -FAR], np.r_[np.where(same, high[1:], FAR), FAR]
        before_low, before_high = np.r_[-FAR, np.where(same, low[:-1], -FAR)], np.r_[FAR, np.where(same, high[:-1], FAR)]
        new_low = np.minimum(low, np.where(right, before_low, after_low))
        new_high = np.maximum(high, np.where(right, before_high, after_high))
        new_name = np.where(pair, mix64(name * GOLDEN + np.r_[name[1:], np.uint64(0)] + np.uint64(r)), name)
        new_size = np.where(pair, size + np.r_[size[1:], 0], size)
        kept = ~second
        name, low, high, own, size, made = new_name[kept], new_low[kept], new_high[kept], own[kept], new_size[kept], pair[kept]
        offer(name[made], low[made], high[made], size[made])
    return np.where(best > 0, best, windows >> np.uint64(4))


def _squeeze(values: np.ndarray) -> bytes:
    """Integers of any width, their bytes regrouped by significance, compressed."""
    width = values.dtype.itemsize
    data = zstandard.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), 3)
    return struct.pack("<I", len(data)) + data


def _spread(data: bytes, at: int, dtype: str) -> tuple[np.ndarray, int]:
    (size,) = struct.unpack_from("<I", data, at)
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(data[at + 4 : at + 4 + size]), np.uint8)
    return np.frombuffer(raw.reshape(width, -1).T.tobytes(), dtype), at + 4 + size


def pack(bucket: np.ndarray, which: np.ndarray, rows: np.ndarray, items: np.ndarray, places: np.ndarray | None = None) -> pa.RecordBatch:
    """(bucket, payload): for each bucket its rows (id and number), how many items each has, the items, and their places."""
    order = np.lexsort((which, bucket))
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.empty(0, np.int64)
    made = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
        at = order[a:b]
        own, counts = np.unique(which[at], return_counts=True)
        made.append(_squeeze(rows[own, 0]) + _squeeze(rows[own, 1]) + _squeeze(counts.astype("<u4")) + (b"" if places is None else _squeeze(places[at].astype("<u4"))) + items[at].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]], pa.int32()), pa.array(made, pa.binary())], ["bucket", "payload"])


def unpack(parts: list[bytes], kind: str, with_places: bool = False) -> tuple[np.ndarray, ...]:
    """items, rows (two columns) and places of a bucket's packs."""
    items, rows, places = [], [], []
    for p in parts:
        ids, at = _spread(p, 0, "<u8")
        numbers, at = _spread(p, at, "<u8")
        counts, at = _spread(p, at, "<u4")
        if with_places:
            own, at = _spread(p, at, "<u4")
            places.append(own)
        rows.append(np.repeat(np.stack([ids, numbers], 1), counts, axis=0))
        items.append(np.frombuffer(p[at:], kind))
    return np.concatenate(items), np.concatenate(rows), np.concatenate(places) if with_places else np.empty(0, np.uint32)


def _by_row(row: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items grouped by row: the rows, which of them each item has, the items, and where each row's begin."""
    order = np.lexsort((items, row[:, 1], row[:, 0]))
    row, items = row[order], items[order]
    fresh = np.r_[True, (row[1:] != row[:-1]).any(1)] if len(row) else np.empty(0, bool)
    cuts = np.flatnonzero(fresh)
    return row[cuts], np.cumsum(fresh) - 1, items, cuts


def to_homes(row: np.ndarray, items: np.ndarray, buckets: int, first: int = 0) -> pa.RecordBatch:
    """Packs of what was found for each row, by a bucket of the row itself, numbered from `first`, so that few records travel, whatever the number of buckets."""
    rows, which, items, _ = _by_row(row, items)
    home = (mix64(rows[:, 0] * GOLDEN + rows[:, 1]) % np.uint64(buckets)).astype(np.int64) + first
    return pack(home[which] if len(which) else np.empty(0, np.int64), which, rows, items)


def at_home(parts: list[bytes]) -> pa.RecordBatch:
    """One record for each row: all that was found for it."""
    items, row, _ = unpack(parts, "<u4")
    rows, _, items, cuts = _by_row(row, items)
    made = [items[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(items)], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(signed(rows[:, 0])), pa.array(signed(rows[:, 1])), pa.array(made, pa.binary())], ["row_id", "number", "found"])


def by_bucket(judge, buckets: int | None = None):
    """Rows (bucket, payload) in order -> judge(the payloads of one bucket). What a block found by itself comes in buckets numbered
    from `buckets` on, and goes home as it is."""

    def one(bucket: int, parts: list[bytes]) -> pa.RecordBatch:
        if buckets is None or bucket < buckets:
            return judge(parts)
        return pa.RecordBatch.from_arrays([pa.array([bucket - buckets] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and parts:
                    yield one(bucket, parts)
                    parts = []
                bucket = b
                parts.append(p)
        if parts:
            yield one(bucket, parts)

    return run


def _parsed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: the text of each place, its place in it, whether a window starts there, window hashes and window keys."""
    words, counts = split_all(texts)
    h = hash_words(words)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = place + WINDOW <= np.repeat(counts, counts)
    windows = window_hashes(h)
    return text, place, starts, windows, anchors(h, text, windows)


def _ranked(item: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of items that are there more than once, by item, then id; where each such item begins among them; how many it has."""
    order = np.argsort(item)
    start = np.flatnonzero(np.r_[True, item[order][1:] != item[order][:-1]]) if len(item) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[start, len(item)])
    at = order[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    return at[np.lexsort((ids[at], item[at]))], np.cumsum(sizes) - sizes, sizes


def shared_in_block(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items go to their key's bucket, and which are known here to have a key that another id has.

    Of a key that several ids of a block have, only its first and last go on, to tell other blocks that two ids have it.
    """
    at, start, sizes = _ranked(key, ids)
    first, last = at[start], at[start + sizes - 1]
    several = ids[first] != ids[last]
    known = at[np.repeat(several, sizes)]
    sent = np.ones(len(key), bool)
    sent[known] = False
    sent[first[several]] = sent[last[several]] = True
    return np.flatnonzero(sent), known


def later_in_block(window: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items go to their window's bucket, those of its smallest id in the block, and which are known here to come after a smaller id."""
    at, start, sizes = _ranked(window, ids)
    later = at[ids[at] > np.repeat(ids[at[start]], sizes)]
    sent = np.ones(len(window), bool)
    sent[later] = False
    return np.flatnonzero(sent), later


def _keys(buckets: int):
    """(row id, number, text) -> packs of the distinct window keys of each text, but for those that are known in their block to be shared."""

    def packs(keys: list, which: list, rows: list) -> Iterator[pa.RecordBatch]:
        key, own, row = np.concatenate(keys), np.concatenate(which), np.concatenate(rows)
        sent, known = shared_in_block(key, row[own, 0].view(np.int64))
        yield pack(key[sent] % np.uint64(buckets), own[sent], row, key[sent])
        yield to_homes(row[own[known]], (key[known] >> np.uint64(32)).astype("<u4"), buckets, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, which, rows, held = [], [], [], 0
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1)], 1)
            for at, texts in slices(batch.column(2)):
                text, _, starts, _, key = _parsed(texts)
                text, key = text[starts], key[starts]
                fresh = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.empty(0, bool)
                text, key = text[fresh], key[fresh]
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                fresh = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.empty(0, bool)
                keys.append(key[fresh])
                which.append(text[fresh] + sum(map(len, rows)))
                rows.append(ids[at : at + len(texts)])
                held += len(keys[-1])
                if held >= PACKED:
                    yield from packs(keys, which, rows)
                    keys, which, rows, held = [], [], [], 0
        if held:
            yield from packs(keys, which, rows)

    return run


def _shared(buckets: int):
    """Of a bucket: each row's keys, or half of each, that rows of other ids have too."""

    def judge(parts: list[bytes]) -> pa.RecordBatch:
        key, row, _ = unpack(parts, "<u8")
        order = np.lexsort((row[:, 0].view(np.int64), key))
        key, row = key[order], row[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first, last = row[start, 0], row[np.r_[start[1:], len(key)] - 1, 0]
        many = np.repeat(first != last, np.diff(np.r_[start, len(key)]))
        return to_homes(row[many], (key[many] >> np.uint64(32)).astype("<u4"), buckets)

    return by_bucket(judge, buckets)


def _windows(buckets: int):
    """(row id, number, text, shared keys) -> packs of hashes and places of the windows that have such a key, but for those that a
    smaller id of their block has too."""

    def packs(keys: list, which: list, rows: list, places: list) -> Iterator[pa.RecordBatch]:
        window, own, row, place = np.concatenate(keys), np.concatenate(which), np.stack(rows), np.concatenate(places)
        sent, known = later_in_block(window, row[own, 0].view(np.int64))
        yield pack(window[sent] % np.uint64(buckets), own[sent], row, window[sent], place[sent])
        yield to_homes(row[own[known]], place[known].astype("<u4"), buckets, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, which, rows, places, held = [], [], [], [], 0
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1)], 1)
            for at, texts in slices(batch.column(2)):
                text, place, starts, windows, key = _parsed(texts)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    a, b = int(cut[i]), int(cut[i + 1])
                    wanted = np.sort(np.frombuffer(batch.column(3)[at + i].as_py(), "<u4"))
                    short = (key[a:b] >> np.uint64(32)).astype(np.uint32)  # half a key: a chance hit only costs a comparison
                    spot = np.searchsorted(wanted, short)
                    hit = starts[a:b] & (wanted[np.minimum(spot, len(wanted) - 1)] == short)
                    keys.append(windows[a:b][hit])
                    places.append(place[a:b][hit])
                    which.append(np.full(len(keys[-1]), len(rows)))
                    rows.append(ids[at + i])
                    held += len(keys[-1])
                if held >= PACKED:
                    yield from packs(keys, which, rows, places)
                    keys, which, rows, places, held = [], [], [], [], 0
        if held:
            yield from packs(keys, which, rows, places)

    return run


def _repeats(buckets: int):
    """Of a bucket of windows: for each row the places of those that a row of a smaller id has too."""

    def judge(parts: list[bytes]) -> pa.RecordBatch:
        key, row, place = unpack(parts, "<u8", True)
        order = np.lexsort((row[:, 0].view(np.int64), key))
        key, row, place = key[order], row[order], place[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = np.repeat(row[start, 0].view(np.int64), np.diff(np.r_[start, len(key)]))
        later = row[:, 0].view(np.int64) > first
        return to_homes(row[later], place[later].astype("<u4"), buckets)

    return by_bucket(judge, buckets)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row id, number, text, places) -> (row id, number, n_words, n_removed, kept)."""
    for batch in batches:
        for at, texts in slices(batch.column(2)):
            sizes, gone, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split()
                found = batch.column(3)[at + i].as_py()
                sizes.append(len(words))
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    places = np.frombuffer(found, "<u4").astype(np.int64)
                    np.add.at(edge, places, 1)
                    np.add.at(edge, places + WINDOW, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[j] for j in np.flatnonzero(stay).tolist()]
                gone.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row_id", "number", "n_words", "n_removed", "kept"])


def _stripped(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """numbered() rows -> row_id (NO_ID for null), number, n_words, n_removed and kept."""
    spark = rows.sparkSession
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    keyed = rows.select(F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(NO_ID)).alias("row_id"), "number", text.alias("text"))
    buckets = buckets_of(keyed, F.col("text"))
    found = "row_id bigint, number bigint, found binary"
    grouped = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    packed = "bucket int, payload binary"
    shared = grouped(grouped(keyed.mapInArrow(lean(_keys(buckets)), packed)).mapInArrow(lean(_shared(buckets)), packed)).mapInArrow(lean(by_bucket(at_home)), found)
    dealt = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id", "number")
    windows = dealt.join(shared, ["row_id", "number"]).select("row_id", "number", "text", "found").mapInArrow(lean(_windows(buckets)), packed)
    repeats = grouped(grouped(windows).mapInArrow(lean(_repeats(buckets)), packed)).mapInArrow(lean(by_bucket(at_home)), found)
    out = dealt.join(repeats, ["row_id", "number"], "left").select("row_id", "number", "text", "found")
    return out.mapInArrow(lean(_strip), "row_id bigint, number bigint, n_words bigint, n_removed bigint, kept string")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_words, n_removed and kept (the words left, joined by single spaces).

    A word goes if it lies in a window of WINDOW words that also starts in a row of a smaller id. Windows are those of the input.
    First every text sends its windows' keys, distinct ones and mostly names of symbols of several words; then only texts with a key that
    another id has send those windows' hashes and places; the smallest id of each hash keeps it. Both steps travel packed by hash bucket.
    What a block of texts can tell by itself goes straight home: of a key or window, however many texts have it, a block sends its bucket
    two ids' or the smallest id's. A bucket gathers about BUCKET_BYTES of text, whatever the input's size.

    Defined cases: null and blank texts have no words; rows with a null id come after all ids and lose to them, and not to each other;
    rows of equal ids don't take words from each other; repeats inside one row stay; rows are told apart by number, so that those of one id, of
    none, and equal ones each get what is found for them; an empty table gives an empty result; other columns are ignored. Texts travel once, and
    both joins read the same shuffle.
    """
    return _stripped(numbered(docs), id_col, text_col).select(F.when(F.col("row_id") != NO_ID, F.col("row_id")).alias("doc_id"), "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text replaced by what strip_repeats() leaves of it; rows left without a word go. n_chars, if there, is counted anew.

    Results come back by a number for each row; columns may have any names.
    """
    rows = numbered(docs)
    left = _stripped(rows, id_col, text_col).where("n_words > n_removed").select("number", "kept")
    rest = rows.select("number", F.struct(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text_col]).alias("row"))
    new = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rest.join(left, "number").select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of words, those removed, and a digest of what is kept."""
    return strip_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
