"""N-gram Jaccard join: size-banded tiles, bitmap signatures that bound the overlap, and exact intersection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_of, drop_staged, hashed_words, lean, mix64, numbered, slices, staged, staged_apart, table
from .graph import Labels, components, signed

NGRAM = 5
#: Two sets link when 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Sets below this size meet by prefixes, larger ones by parts.
SMALL = 32
#: Sizes from 32, 48, 72, ... are a band each.
BAND = 1.5
#: Parts of a band's universe beyond the largest difference of linked sets, as a share of it.
SLACK = 0.1
#: Shingles, or SHORT for each shorter set, that one block of a tile holds.
BLOCK = 1_000_000
SHORT = 500
#: Shingles that several sets of a tile have, beside the sets' mean size, up to which overlaps are products of matrices; columns of these.
WIDE, COLUMNS = 32, 4096
#: Packed rows of one block of texts are sent on at this many keys.
PACKED = 1_000_000


#: A shingle's hash mixes the sum of its words' hashes times these.
TIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct NGRAM-word shingles; of a shorter text, its whole sequence's; none without words."""
    h, counts = hashed_words(texts)
    rolled = np.zeros(max(0, len(h) - NGRAM + 1), np.uint64)
    for k in range(NGRAM if len(rolled) else 0):
        rolled += h[k : len(rolled) + k] * np.uint64(TIMES[k])
    rolled = mix64(rolled)
    ends = np.cumsum(counts)
    found = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= NGRAM:
            own = np.sort(rolled[end - n : end - NGRAM + 1])
            found.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:
            one = np.uint64(n)
            for x in h[end - n : end]:
                one = mix64(np.array([one], np.uint64) * np.uint64(TIMES[0]) + x)[0]
            found.append(np.array([one], np.uint64))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def set_number(fp: bytes) -> int:
    """48 bits of a set's digest. Two sets with the same number only cost a comparison: links are judged by digests."""
    return int.from_bytes(fp[:6], "little")


ROWS = "doc_id bigint, row_number bigint, n_shingles bigint, fp binary, number bigint, bits binary, bucket int, payload binary"
KINDS = {"doc_id": pa.int64(), "row_number": pa.int64(), "n_shingles": pa.int64(), "fp": pa.binary(), "number": pa.int64(), "bits": pa.binary(), "bucket": pa.int32(), "payload": pa.binary()}


def _row_batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in KINDS.items()], list(KINDS))


#: The least and the largest size of each band.
LOWS = [int(np.ceil(SMALL * BAND**k)) for k in range(64)]
HIGHS = np.array([int(np.ceil(SMALL * BAND ** (k + 1))) - 1 for k in range(64)], np.int64)
#: A family of keys is told by its band, or, of single shingles, by SINGLE and the band, if it has one; the rest of its tag is how many keys it can spare.
SINGLE, SPARE_BITS = 64, 16


def _places(n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of n that begin at `starts`, one after another, and the run of each."""
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n), np.repeat(np.arange(len(n)), n)


def tile_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sets, none empty, such that any two linked sets share one, even if each leaves out the last ones of each family that the family can
    spare, in any order of keys that is the same for all sets: (keys, the family of each, the set of each family, its tag).

    Linked sets of sizes m and n differ in (m + n) / 9 shingles at most. The universe of a band is cut by hash into more parts than
    that. A set's key for a part is the part's whole content; empty parts have none. A set has a family for each band in which it may be the larger or the
    smaller of a pair. Of its keys there no more than (m + n) / 9 can differ from those of a linked set; so of one more that come first, in whatever order, one is
    shared, and of the shared ones the first comes so early in both sets: the rest can be spared. Where there are too few keys for that, nothing is spared, and a family of the single
    shingles comes beside, as for sets below SMALL: of n of them, ceil(0.8 n) - 1 can be spared, as a linked set has 0.8 n at least.
    Neither loses a link at the sizes where the schemes meet: a set with enough keys shares one of those that it doesn't spare with any linked set, which, if it has
    too few, spares none; and sets below and above SMALL meet in band 0, whose keys the smaller has too.
    """
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(n) - n
    own = [np.flatnonzero((100 * n >= PERCENT * low) & (n <= high)) for low, high in zip(LOWS, HIGHS.tolist(), strict=True)]
    band, owner = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
    high, m = HIGHS[band], n[owner]
    parts = (2 * high / 9 * (1 + SLACK)).astype(np.int64) + 2
    place, run = _places(m, starts[owner])
    x = mix64(flat[place] ^ (np.uint64(0xA5A5A5A5) + band.astype(np.uint64))[run])
    cell = (np.cumsum(parts) - parts)[run] + (x % parts.astype(np.uint64)[run]).astype(np.int64)
    y, cells = mix64(x + np.uint64(0x1234567)), int(parts.sum())
    halves = [np.bincount(cell, h.astype(np.float64), cells).astype(np.uint64) for h in (y & np.uint64(0xFFFFFFFF), y >> np.uint64(32))]  # whole numbers below 2^53
    part, family = _places(parts, np.zeros(len(parts), np.int64))
    keys = mix64(halves[0] + (halves[1] << np.uint64(32)) + mix64(part.astype(np.uint64) + ((band + 2).astype(np.uint64) << np.uint64(32))[family]))
    filled = np.bincount(cell, minlength=cells) > 0
    keys, family = keys[filled], family[filled]
    spare = np.bincount(family, minlength=len(owner)) - (m + np.minimum(high, 100 * m // PERCENT)) // 9 - 1
    few, small = np.flatnonzero(spare < 0), np.flatnonzero(n < SMALL)
    alone, space = np.r_[small, owner[few]], np.r_[np.ones(len(small), np.int64), 2 + band[few]]
    place, run = _places(n[alone], starts[alone])
    single = mix64(mix64(flat[place]) + space.astype(np.uint64)[run])
    spare = np.minimum(np.r_[np.maximum(spare, 0), -(-PERCENT * n[alone] // 100) - 1], (1 << SPARE_BITS) - 1)
    tag = (np.r_[band, SINGLE + space - 1] << SPARE_BITS) + spare
    return np.r_[keys, single], np.r_[family, len(owner) + run], np.r_[owner, alone], tag


#: Keys of a family that follow each other in a pack, at most.
RUN = 255


def _packed(numbers: np.ndarray, sizes: np.ndarray, tags: np.ndarray, runs: np.ndarray, keys: np.ndarray) -> bytes:
    """A bucket's keys and, for each run of them, its set's number and size and its family's tag. There may be nearly as many runs as keys, where buckets are many. Of a key the
    upper half is kept: beside the bucket, equal ones of different keys are few, and only cost a comparison."""
    columns = (numbers & np.uint64(0xFFFFFFFF)).astype("<u4"), sizes.astype("<u4"), (numbers >> np.uint64(32)).astype("<u2"), (tags & ((1 << SPARE_BITS) - 1)).astype("<u2"), (tags >> SPARE_BITS).astype("u1"), runs.astype("u1"), (keys >> np.uint64(32)).astype("<u4")
    raw = np.array([len(runs), len(keys)], "<u4").tobytes() + b"".join(c.tobytes() for c in columns)
    return np.array([len(raw)], "<u4").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(pack: bytes) -> list[np.ndarray]:
    """For each key of a pack: the key, its set's number, and size, and its family's tag."""
    raw = pa.decompress(pack[4:], decompressed_size=int(np.frombuffer(pack, "<u4", 1)[0]), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    low, sizes, high, spare, kind, runs = (np.frombuffer(raw, t, n, 8 + at * n) for t, at in (("<u4", 0), ("<u4", 4), ("<u2", 8), ("<u2", 10), ("u1", 12), ("u1", 13)))
    numbers = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    return [np.frombuffer(raw, "<u4", m, 8 + 14 * n), *(np.repeat(c, runs) for c in (numbers, sizes, (kind.astype(np.uint32) << SPARE_BITS) + spare))]


def _sets(buckets: int):
    """(doc_id, row number, text) -> a row for each text (bucket null): n_shingles, fp, number and bits of its set; and packs by bucket of
    the key (see _packed). Every text is cut into shingles once."""

    def close(held: list[tuple]) -> pa.RecordBatch:
        flat, numbers, sizes, tags = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4))
        before = np.cumsum([0, *(len(h[2]) for h in held)])
        which = np.concatenate([h[1] + at for h, at in zip(held, before.tolist(), strict=False)])
        bucket = (flat % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        order = np.lexsort((which, bucket))
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order].astype(np.int64)) != 0])
        made = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            rows = order[a:b]
            own = which[rows]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            first = np.flatnonzero((np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))) % RUN == 0)
            made.append(_packed(numbers[own[first]], sizes[own[first]], tags[own[first]], np.diff(np.r_[first, len(own)]), flat[rows]))
        return _row_batch({"bucket": pa.array(bucket[order[cuts]].astype(np.int32)), "payload": pa.array(made, pa.binary())}, len(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [], 0, set()
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                found = shingle_sets(texts)
                fps = [digest(s) for s in found]
                own = [set_number(f) for f in fps]
                new = []
                for i, (s, number) in enumerate(zip(found, own, strict=True)):
                    if len(s) and number not in seen:
                        seen.add(number)
                        new.append(i)
                if new:
                    keys, family, owner, tag = tile_keys([found[i] for i in new])
                    held.append((keys, family, np.array([own[i] for i in new], np.uint64)[owner], np.array([len(found[i]) for i in new], "<u4")[owner], tag.astype("<u4")))
                    n_held += len(keys)
                yield _row_batch({
                    "doc_id": batch.column(0).slice(at, len(texts)), "row_number": batch.column(1).slice(at, len(texts)), "n_shingles": pa.array([len(s) for s in found], pa.int64()), "fp": pa.array(fps, pa.binary()),
                    "number": pa.array(signed(np.array(own, np.uint64))), "bits": pa.array([bitmap(s) for s in found], pa.binary()),
                }, len(texts))
                if n_held >= PACKED:
                    yield close(held)
                    held, n_held, seen = [], 0, set()
        if held:
            yield close(held)

    return run


SHARED = "number bigint, tag bigint, size bigint, key bigint, df bigint"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets, in order -> the keys that several sets have, by set and family, with the number of these sets."""

    def judge(bucket: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [_unpacked(p) for p in parts]
        k, s, z, t = (np.concatenate([c[i] for c in columns]) for i in range(4))
        del columns
        order = np.argsort(k)
        again = k[order][1:] == k[order][:-1]
        order = order[np.r_[again, False] | np.r_[False, again]]  # keys that occur once are most of all
        order = order[np.lexsort((s[order], k[order]))]
        order = order[np.r_[True, (k[order][1:] != k[order][:-1]) | (s[order][1:] != s[order][:-1])][: len(order)]]  # equal sets of several tasks
        _, at, n = np.unique(k[order], return_inverse=True, return_counts=True)
        df = n[at]
        order, df = order[df > 1], df[df > 1]
        if len(order):
            yield pa.RecordBatch.from_arrays([pa.array(signed(s[order])), pa.array(t[order].astype(np.int64)), pa.array(z[order].astype(np.int64)), pa.array((bucket << 32) + k[order].astype(np.int64)), pa.array(df.astype(np.int64))], ["number", "tag", "size", "key", "df"])

    bucket, parts = None, []
    for batch in batches:
        for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and parts:
                yield from judge(bucket, parts)
                parts = []
            bucket = b
            parts.append(p)
    if parts:
        yield from judge(bucket, parts)


def _tied(shared: DataFrame) -> DataFrame:
    """SHARED rows -> links (a, b) such that any two linked sets are in one component. Each family leaves out what it can spare, the keys of most sets first: so what many texts
    have in common, as lines or passages, ties none that have enough of their own. Of what is left, the sets of a key stand by size, and each is tied to the
    next larger one if that is in reach: so any two in reach are tied."""
    last = F.row_number().over(Window.partitionBy("number", "tag").orderBy(F.desc("df"), F.desc("key")))
    left = shared.withColumn("last", last).where(F.col("last") > F.col("tag").bitwiseAND((1 << SPARE_BITS) - 1)).select("key", "size", "number")
    by_size = Window.partitionBy("key").orderBy("size", "number")
    beside = left.select("size", "number", F.lag("size").over(by_size).alias("size2"), F.lag("number").over(by_size).alias("number2"))
    return beside.where((100 * F.col("size2") >= PERCENT * F.col("size")) & (F.col("number") != F.col("number2"))).select(F.col("number").alias("a"), F.col("number2").alias("b"))


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: the power of two from n on, 64 at least."""
    return max(64, 1 << (n - 1).bit_length()) if n else 64


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit says whether an odd number of the set's shingles has that hash. Two bitmaps differ in at most as many bits as their sets
    differ in shingles, which bounds the overlap from above; one of twice the width becomes one of the width by folding."""
    bits = width(len(hashes))
    odd = np.bincount((mix64(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible_links(left: list[tuple], right: list[tuple] | None) -> list[tuple]:
    """A spanning forest of the pairs within `left`, or between left and right, that can link by their sizes and bitmaps. Rows
    (fp, n, bits), each side by size."""
    rows = left + (right or [])
    n = np.array([r[1] for r in rows], np.int64)
    widths = np.array([8 * len(r[2]) for r in rows], np.int64)
    maps, at = {}, {}
    for w in np.unique(widths).tolist():  # sets in reach have the same width, or one has twice the other's
        own = np.flatnonzero((widths == w) | (widths == 2 * w))
        words = [np.frombuffer(rows[i][2], np.uint64) for i in own.tolist()]
        maps[w] = np.stack([x if len(x) * 64 == w else x[: len(x) // 2] ^ x[len(x) // 2 :] for x in words])
        at[w] = np.full(len(rows), -1)
        at[w][own] = np.arange(len(own))
    forest, end = Labels(len(rows)), len(rows)
    for i in range(len(left)):
        start = i + 1 if right is None else len(left)
        first = start + int(np.searchsorted(100 * n[start:end], PERCENT * n[i], "left"))
        near = np.arange(first, start + int(np.searchsorted(PERCENT * n[start:end], 100 * n[i], "right")))
        near = near[forest.of[near] != forest.of[i]]  # only a forest is asked for
        narrow = np.minimum(widths[near], widths[i])
        for w in np.unique(narrow).tolist():
            own = near[narrow == w]
            apart = np.bitwise_count(maps[w][at[w][own]] ^ maps[w][at[w][i]]).sum(1, dtype=np.int64)
            forest.join(i, own[(100 + PERCENT) * ((n[own] + n[i] - apart) // 2) >= PERCENT * (n[own] + n[i])])
    return [(rows[a][0], rows[b][0]) for a, b in forest.kept]


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, fp, n, bits) in order -> the tiles' possible links."""

    def finish(sides: list[list]) -> Iterator[pa.RecordBatch]:
        if sides[0] and len(sides[0]) + len(sides[1]) > 1 and (pairs := possible_links(sides[0], sides[1] or None)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

    tile, sides = None, [[], []]
    for batch in batches:
        for t, side, fp, n, bits in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if t != tile:
                yield from finish(sides)
                tile, sides = t, [[], []]
            sides[side].append((fp, n, bits))
    yield from finish(sides)


def judge_tile(left: list[tuple], right: list[tuple] | None):
    """Links within `left`, or between left and right: rows (fp, copies, hashes), by size -> (links of each fp, a spanning forest).

    Shingles that one set only has don't count towards any overlap. Where the others are few beside the sets' sizes, as of near copies, overlaps are products of
    matrices of zeros and ones, COLUMNS shingles at a time; else, for each set, those in reach by size are marked. A set's links count the copies of the other sets.
    """
    rows = left + (right or [])
    n = np.array([len(r[2]) for r in rows], np.int64)
    copies = np.array([r[1] for r in rows], np.int64)
    _, ranks, often = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    links, forest = np.zeros(len(rows), np.int64), Labels(len(rows))

    def settle(i: int, linked: np.ndarray) -> None:
        links[i] += copies[linked].sum()
        links[linked] += copies[i]
        forest.join(i, linked)

    shared = np.flatnonzero(often > 1)
    if len(shared) <= WIDE * n.mean() and n.max() < 1 << 24:
        column = np.full(len(often), -1)
        column[shared] = np.arange(len(shared))
        column, row = column[ranks], np.repeat(np.arange(len(rows)), n)
        low = 0 if right is None else len(left)
        both = np.zeros((len(left), len(rows) - low), np.float32)
        for c in range(0, len(shared), COLUMNS):
            own = (column >= c) & (column < c + COLUMNS)
            held = np.zeros((len(rows), min(COLUMNS, len(shared) - c)), np.float32)
            held[row[own], column[own] - c] = 1
            both += held[: len(left)] @ held[low:].T
        for i in range(len(left)):
            start = i + 1 if right is None else 0
            settle(i, low + start + np.flatnonzero((100 + PERCENT) * both[i, start:].astype(np.int64) >= PERCENT * (n[low + start :] + n[i])))
        return links, [(rows[a][0], rows[b][0]) for a, b in forest.kept]
    mark = np.zeros(len(often), bool)
    for i in range(len(left)):
        start = i + 1 if right is None else len(left)
        near = start + np.flatnonzero(100 * np.minimum(n[start:], n[i]) >= PERCENT * np.maximum(n[start:], n[i]))
        if not len(near):
            continue
        own = ranks[ends[i] - n[i] : ends[i]]
        mark[own] = True
        sizes = n[near]
        both = np.add.reduceat(mark[ranks[_places(sizes, ends[near] - sizes)[0]]].astype(np.int64), np.cumsum(sizes) - sizes)
        mark[own] = False
        settle(i, near[(100 + PERCENT) * both >= PERCENT * (sizes + n[i])])
    return links, [(rows[a][0], rows[b][0]) for a, b in forest.kept]


def _tiled(sets: DataFrame) -> DataFrame:
    """sets(root, fp, n_shingles, ...), a written table, with tiles: for each set the tiles it belongs to and its side in each.

    A component's sets are parted by size, a class for each tenth of a natural logarithm, and a class by hash into as many blocks as its
    shingles need; every pair of blocks in reach of each other is a tile. Tiles of one block have one side. Only sums by component and
    class meet, so that a component of any size is spread over many tasks.
    """
    sets = sets.withColumn("class", F.floor(F.log(F.col("n_shingles").cast("double")) * 10).cast("int"))
    weight = F.sum(F.greatest("n_shingles", F.lit(SHORT)))
    classes = staged(sets.groupBy("root", "class").agg(F.ceil(weight / BLOCK).cast("int").alias("blocks"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")), "classes")
    other = classes.select("root", F.col("class").alias("class2"), F.col("blocks").alias("blocks2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    in_reach = (100 * F.col("high") >= PERCENT * F.col("low2")) & (100 * F.col("high2") >= PERCENT * F.col("low"))
    reach = classes.join(other, "root").where(in_reach).groupBy("root", "class", "blocks").agg(F.collect_list(F.struct("class2", "blocks2")).alias("reach"))  # a few classes each
    sets = sets.join(staged(reach, "reach"), ["root", "class"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))

    def tile(c: Column, b: Column) -> Column:
        ours, theirs = F.struct(F.col("class").alias("c"), F.col("block").alias("b")), F.struct(c.alias("c"), b.alias("b"))
        return F.struct(F.xxhash64("root", F.least(ours, theirs), F.greatest(ours, theirs)).alias("tile"), F.when(ours <= theirs, 0).otherwise(1).alias("side"))

    tiles = F.flatten(F.transform("reach", lambda r: F.transform(F.sequence(F.lit(0), r["blocks2"] - 1), lambda b: tile(r["class2"], b))))
    return sets.withColumn("tiles", tiles).drop("root", "class", "blocks", "reach", "block")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, fp, copies, text) in order -> (a, b, links): links of a, with b null; or a link of the forest."""

    def finish(sides: list[list]) -> Iterator[pa.RecordBatch]:
        left, right = (sides[0], None) if not sides[1] else (sides[0], sides[1])
        if len(left) + len(right or []) < 2 or not left:
            return
        links, forest = judge_tile(left, right)
        rows = left + (right or [])
        out = [(rows[i][0], None, int(links[i])) for i in np.flatnonzero(links).tolist()] + [(a, b, 0) for a, b in forest]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())], ["a", "b", "links"])

    tile, sides = None, [[], []]
    for batch in batches:
        for at, texts in slices(batch.column(4)):
            rows = zip(*(batch.column(i).slice(at, len(texts)).to_pylist() for i in range(4)), shingle_sets(texts), strict=True)
            for t, side, fp, copies, hashes in rows:
                if t != tile:
                    yield from finish(sides)
                    tile, sides = t, [[], []]
                if not sides[side] or sides[side][-1][0] != fp:  # rows of equal id and text come twice
                    sides[side].append((fp, copies, hashes))
    yield from finish(sides)


def _similar(numbers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """numbered() rows -> what similar() returns, with row_number and in_front: whether the row is its component's first, by id, then number."""
    keyed = numbers.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col("number").alias("row_number"), F.col(f"row.`{text_col}`").alias("text"))
    buckets = buckets_of(keyed, F.col("text"))
    both, packs = staged_apart(keyed.mapInArrow(lean(_sets(buckets)), ROWS), F.col("bucket").isNotNull(), "shingles")
    rows = both.select("doc_id", "row_number", "n_shingles", "fp", "number", "bits")
    tiles = packs.select("bucket", "payload").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    candidates = components(_tied(tiles.mapInArrow(lean(_shared), SHARED)))
    sets = rows.where("n_shingles > 0").groupBy("fp", "number", "n_shingles").agg(F.min(F.struct("doc_id", "row_number")).alias("rep"), F.count("*").alias("copies"), F.first("bits").alias("bits"))
    sets = staged(sets.join(candidates.select(F.col("node").alias("number"), "root"), "number").select("fp", "n_shingles", "copies", "bits", "root", "rep.doc_id", "rep.row_number"), "candidates")
    drop_staged(packs)  # nothing reads the keys any more, which are most of what was written
    coarse = _tiled(sets.select("root", "fp", "n_shingles", "bits")).select(F.explode("tiles").alias("t"), "fp", "n_shingles", "bits").select("t.tile", "t.side", "fp", "n_shingles", "bits")
    possible = coarse.repartition("tile").sortWithinPartitions("tile", "side", "n_shingles", "fp").mapInArrow(lean(_possible), "a binary, b binary")
    near = components(possible).select(F.col("node").alias("fp"), "root")
    k, s = keyed.alias("k"), _tiled(staged(sets.drop("root", "bits").join(near, "fp"), "near")).alias("s")
    work = k.join(s, F.col("k.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("k.row_number") == F.col("s.row_number"))).select("fp", "copies", "n_shingles", F.explode("tiles").alias("t"), "text")
    work = work.select("t.tile", "t.side", "fp", "copies", "text", "n_shingles").repartition("tile").sortWithinPartitions("tile", "side", "n_shingles", "fp")
    judged = staged(work.mapInArrow(lean(_verify), "a binary, b binary, links bigint"), "judged")
    counted = judged.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    members = components(judged.where("b is not null").select("a", "b")).select(F.col("node").alias("fp"), "root")
    in_front = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row_number")
    firsts = rows.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(in_front).alias("front"), F.count("*").alias("copies"))
    firsts = firsts.join(members, "fp", "left").join(counted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = staged(firsts.select("fp", "first", "front", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "firsts")
    labels = staged(firsts.groupBy("root").agg(F.min("first").alias("component_id"), F.min("front")["row_number"].alias("front")), "labels")
    firsts = firsts.select("fp", "root", "n_links").join(labels, "root").select("fp", "component_id", "n_links", "front")
    full = rows.where("n_shingles > 0").join(firsts, "fp").select("doc_id", "n_shingles", "component_id", "n_links", "row_number", (F.col("row_number") == F.col("front")).alias("in_front"))
    alone = F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "row_number", F.lit(True).alias("in_front")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", *alone))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_shingles, component_id (the smallest id that links reach) and n_links (other rows that the row links with).

    Two rows link when their sets of lower-cased 5-word shingles have a Jaccard similarity of 0.8 or more; exact, with no cap.
    Defined cases: texts below five words have one shingle, their whole sequence; texts without words, or null, have none and link
    with nothing, not even each other; equal texts link; rows whose ids are null link like others, and their component is null
    only if no row of it has an id; repeated ids stay rows; an empty table gives an empty result; other columns are ignored.

    Steps: equal sets become one; sets that share a tile key, leaving out as many of the commonest as they can, become candidates, tied in chains, never in all pairs; components of
    candidates are parted by size into blocks, and every pair of blocks in reach of each other is a tile for one task. There bitmaps, a bit a
    shingle, leave the pairs whose overlap can be large enough; their components, mostly groups of real near-duplicates, are tiled
    once more, and only their texts travel, for exact intersections. Equal sets and hot groups thus cost one row, or blocks
    over many tasks. Tasks send on spanning forests and counts, not links.
    """
    return _similar(numbered(docs), id_col, text_col).select("doc_id", "n_shingles", "component_id", "n_links")
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for those of near-duplicate groups; of each of those one row, of the smallest id, stays.

    Rows are told apart by number, not by id: of equal rows, of rows of one id and of rows without an id each stays or goes by its own text. A row
    without an id comes after all others of its group. Rows without words are in no group and stay.
    """
    rows = numbered(docs)
    spare = _similar(rows, id_col, text_col).where("not in_front").select(F.col("row_number").alias("number"))
    return rows.join(spare, "number", "left_anti").select("row.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size, its component and its number of links."""
    return similar(table(spark, sf_dir, "documents"))
