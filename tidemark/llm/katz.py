"""Katz backoff (Katz, 1987): Good-Turing discounted bigram and unigram counts, with exactly normalised backoff weights."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_of, hash_words, lean, mix64, slices, split_all, staged, table
from .toxicity import remainder

#: Counts up to this are discounted by Good-Turing; larger ones lose LOSS, so that every history leaves something to back off to.
MOST_DISCOUNTED = 5
LOSS = 0.5
#: The most frequent words: their counts are broadcast, so they travel as short codes.
FREQUENT = 1 << 18
#: A history with more than this share of all tokens, and that of a text's first word, is dealt over all buckets by the word after it.
HOT_SHARE = 1e-3
#: Text bytes whose distinct bigrams travel together; bounds a worker's memory.
BLOCK_BYTES = 12 << 20
#: Not hashes of words, but for a chance of 2 ** -64.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)

PAIRS, TEXTS, ANSWERS, WEIGHTS, HISTORY, COUNTS, NEED = range(7)
ROWS = "kind int, block string, bucket int, part int, payload binary, ids array<bigint>, held array<boolean>, h bigint, m array<bigint>, p double, rare array<bigint>, alphas array<double>"
NAMES = ["kind", "block", "bucket", "part", "payload", "ids", "held", "h", "m", "p", "rare", "alphas"]
KINDS = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32- or 64-bit integers, compressed by byte planes."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        width = a.dtype.itemsize
        packed = zstandard.compress(a.view(np.uint8).reshape(-1, width).T.tobytes(), 3) if len(a) else b""
        out.append(struct.pack("<BQQ", width, len(a), len(packed)) + packed)
    return b"".join(out)


def load(data: bytes) -> list[np.ndarray]:
    found, at = [], 1
    for _ in range(data[0]):
        width, n, size = struct.unpack_from("<BQQ", data, at)
        at += 17
        raw = zstandard.decompress(data[at : at + size]) if n else b""
        found.append(np.frombuffer(np.frombuffer(raw, np.uint8).reshape(width, n).T.tobytes(), f"<u{width}"))
        at += size
    return found


class Discounts(NamedTuple):
    """factors[r]: what a count of r keeps, r from 1 to MOST_DISCOUNTED."""

    factors: tuple[float, ...]

    def kept(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        table_ = np.array([0.0, *self.factors])
        return np.where(c > MOST_DISCOUNTED, c - LOSS, c * table_[np.minimum(counts, MOST_DISCOUNTED).astype(np.int64)])


def discounts(n: list[int]) -> Discounts:
    """Katz's discounts from n[r], the number of items counted r times, r from 0 to MOST_DISCOUNTED + 1. Where the counts of counts
    give nothing between 0 and 1, as in small tables, r keeps r - LOSS."""
    k = MOST_DISCOUNTED
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    factors = []
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        factors.append(d if 0 < d < 1 else (r - LOSS) / r)
    return Discounts(tuple(factors))


class Unigrams(NamedTuple):
    """tokens, distinct and texts of the training rows; unknown: the chance of all words not among them together."""

    tokens: int
    distinct: int
    texts: int
    discounts: Discounts
    unknown: float
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.kept(counts) / max(self.tokens, 1), self.unknown)


def _count_words(buckets: int):
    """(text) -> packed distinct words and their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            ends = [*cuts[1:].tolist(), len(order)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]], pa.int32()), pa.array([dump(keys[order[a:b]], counts[order[a:b]].astype("<u8")) for a, b in zip(cuts.tolist(), ends, strict=True)], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                words, _ = split_all(texts, lower=True)
                held += [hash_words(words), np.full(len(texts), END)]
                size += sum(map(len, texts))
                if size >= 2 * BLOCK_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets, in order -> one row for each bucket: its words and counts, counts of counts, and its most frequent words."""

    def close(bucket: int, parts: list[bytes]) -> pa.RecordBatch:
        both = [load(p) for p in parts]
        keys, at = np.unique(np.concatenate([b[0] for b in both]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate([b[1] for b in both]).astype(np.int64))
        n = np.bincount(np.minimum(counts, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)
        large = counts > MOST_DISCOUNTED
        n[MOST_DISCOUNTED + 2] = large.sum()
        top = np.argsort(-counts, kind="stable")[:FREQUENT]
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
        one = (bucket, dump(keys, counts.astype("<u8")), n.tolist(), int(counts.sum()), len(keys), dump(keys[top], counts[top].astype("<u8")))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds, strict=True)], ["bucket", "words", "n", "tokens", "types", "top"])

    bucket, parts = None, []
    for batch in batches:
        for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and parts:
                yield close(bucket, parts)
                parts = []
            bucket = b
            parts.append(p)
    if parts:
        yield close(bucket, parts)


def _unpack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            keys, counts = load(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["w", "c"])


def count_unigrams(docs: DataFrame, buckets: int) -> tuple[DataFrame, Unigrams]:
    """The table of words and counts, partitioned by bucket, and what the driver needs of it: totals, and the FREQUENT most frequent words."""
    packs = docs.select("text").mapInArrow(lean(_count_words(buckets)), "bucket int, payload binary").repartition("bucket").sortWithinPartitions("bucket")
    words = staged(packs.mapInArrow(lean(_sum_words), "bucket int, words binary, n array<bigint>, tokens bigint, types bigint, top binary"), "unigrams")
    sums = words.agg(F.sum("tokens"), F.sum("types"), *[F.sum(F.get("n", F.lit(r))) for r in range(MOST_DISCOUNTED + 3)]).first()
    tokens, types, *n = [x or 0 for x in sums]
    given = discounts(n)
    kept = float((given.kept(np.arange(1, MOST_DISCOUNTED + 1)) * np.array(n[1 : MOST_DISCOUNTED + 1])).sum()) + tokens - sum(r * n[r] for r in range(MOST_DISCOUNTED + 1)) - LOSS * n[MOST_DISCOUNTED + 2]
    unknown = 1 - kept / tokens if tokens else 1.0
    plain = words.select("top").mapInArrow(lean(_unpack_words), "w bigint, c bigint")
    top = plain.orderBy(F.desc("c"), "w").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    keys, counts = top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    ends = counts[keys == END]
    return words, Unigrams(tokens, types, int(ends[0]) if len(ends) else 0, given, unknown, keys[order], counts[order])


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted_keys; len(sorted_keys) where they aren't."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, len(sorted_keys))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(NAMES, KINDS, strict=True)], NAMES)


def _blocks(model, buckets: int, wanted: int):
    """(doc_id, held, text) -> of each block the distinct bigrams by bucket (PAIRS), or its texts as places among those (TEXTS).

    Both runs over the same rows give the same blocks and places. A bucket's bigrams stand by history, then word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        hot = np.sort(np.append(m.frequent[m.frequent_counts > HOT_SHARE * m.tokens], START))
        task, number, held, rows = TaskContext.get().partitionId(), 0, 0, []

        def close(block: str) -> Iterator[pa.RecordBatch]:
            h, w = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            learnt = np.concatenate([np.repeat(~np.array(r[3], bool), r[4]) for r in rows])
            salt = np.where(_find(hot, h) < len(hot), mix64(w) % np.uint64(buckets), np.uint64(0))
            bucket = (mix64(h + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            # one key: 30 bits of the history and 24 of the word; a clash only parts a bigram's or a history's rows, and both are summed later
            order = np.argsort((mix64(h) >> np.uint64(34) << np.uint64(24)) | (mix64(w) >> np.uint64(40)))
            # by bucket apart, so that any number of buckets fits; up to 2^16 of them are sorted by radix
            order = order[np.argsort(bucket[order].astype(np.min_scalar_type(buckets - 1)), kind="stable")]
            h, w, bucket = h[order], w[order], bucket[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
            if wanted == TEXTS:
                place = np.empty(len(order), np.int64)
                place[order] = np.cumsum(first) - 1
                at = 0
                for part, (own, _, ids, out, counts) in enumerate(rows):
                    yield _batch([{"kind": TEXTS, "block": block, "bucket": -1, "part": part, "payload": dump(place[at : at + len(own)].astype("<u4"), np.array(counts, "<u4")), "ids": ids, "held": out}])
                    at += len(own)
                return
            starts = np.flatnonzero(first)
            counts = np.add.reduceat(learnt[order].astype(np.int64), starts)
            h, w, bucket = h[starts], w[starts], bucket[starts]
            code = _find(m.frequent, w)
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
            made = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
                runs = np.flatnonzero(np.r_[True, h[a + 1 : b] != h[a : b - 1]])
                lengths = np.diff(np.r_[runs, b - a])
                rare = code[a:b] == len(m.frequent)
                made.append({"kind": PAIRS, "block": block, "bucket": int(bucket[a]), "part": 0, "payload": dump(h[a:b][runs], lengths.astype("<u4"), code[a:b].astype("<u4"), w[a:b][rare], counts[a:b].astype("<u4"))})
            for i in range(0, len(made), 64):
                yield _batch(made[i : i + 64])

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, texts in slices(batch.column(2)):
                words, counts = split_all(texts, lower=True)
                ends = np.cumsum(counts + 1)
                w = np.empty(int(ends[-1]), np.uint64)
                last = np.zeros(len(w), bool)
                last[ends - 1] = True
                w[~last], w[last] = hash_words(words), END
                h = np.r_[START, w[:-1]]
                h[np.r_[0, ends[:-1]]] = START
                rows.append((h, w, ids[at : at + len(texts)], out[at : at + len(texts)], counts + 1))
                held += sum(map(len, texts))
                if held >= BLOCK_BYTES:
                    yield from close(f"{task}-{number}")
                    number, held, rows = number + 1, 0, []
        if rows:
            yield from close(f"{task}-{number}")

    return run


def _answer(model):
    """PAIRS rows of whole buckets, in order of bucket -> ANSWERS (for each block: counts of its bigrams and histories), HISTORY (what
    a history's backoff weight needs), NEED (which histories of which block need one) and COUNTS (counts of counts)."""

    def judge(bucket: int, rows: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        m = model.value
        none = len(m.frequent)
        h, w, count, cuts, runs = [], [], [], [0], []
        for _, data in rows:
            keys, lengths, code, rare, own = load(data)
            word = np.append(m.frequent, np.uint64(0))[code]
            word[code == none] = rare
            h.append(np.repeat(keys, lengths))
            w.append(word)
            count.append(own)
            runs.append(lengths)
            cuts.append(cuts[-1] + len(word))
        h, w, count = np.concatenate(h), np.concatenate(w), np.concatenate(count).astype(np.int64)
        order = np.lexsort((w, h))
        first = np.r_[True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])]
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        pair_h, pair_w, pair_c = h[order][starts], w[order][starts], np.add.reduceat(count[order], starts)
        back = np.empty(len(h), np.int64)
        back[order] = group
        own_h = np.flatnonzero(np.r_[True, pair_h[1:] != pair_h[:-1]])  # the first bigram of each history
        history = np.cumsum(np.r_[True, pair_h[1:] != pair_h[:-1]]) - 1
        keys = pair_h[own_h]
        known = _find(m.frequent, keys)
        total = np.where(known < none, np.append(m.frequent_counts, 0)[known], np.add.reduceat(pair_c, own_h))
        total[keys == START] = m.texts  # may be dealt over buckets, and isn't a word
        wide = np.minimum(pair_c, MOST_DISCOUNTED + 1)
        seen = np.stack([np.add.reduceat((wide == r).astype(np.int64), own_h) for r in range(1, MOST_DISCOUNTED + 2)] + [np.add.reduceat(np.where(pair_c > MOST_DISCOUNTED, pair_c, 0), own_h)], 1)
        word_at = _find(m.frequent, pair_w)
        rare = (word_at == none) & (pair_c > 0)
        chance = np.where((pair_c > 0) & ~rare, m.chance(np.append(m.frequent_counts, 1)[word_at]), 0.0)
        p = np.add.reduceat(chance, own_h)
        needed = (np.minimum.reduceat(pair_c, own_h) == 0) & (total > 0)
        split = (known < none) & (total > HOT_SHARE * m.tokens) | (keys == START)
        n = np.bincount(np.minimum(pair_c, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)
        yield _batch([{"kind": COUNTS, "m": n.tolist()}])
        out = []
        for (block, _), a, b, lengths in zip(rows, cuts[:-1], cuts[1:], runs, strict=True):
            at = np.r_[0, np.cumsum(lengths.astype(np.int64))[:-1]]
            mine = history[back[a:b]][at]
            c = pair_c[back[a:b]]
            out.append({"kind": ANSWERS, "block": block, "bucket": bucket, "part": 0, "payload": dump(c.astype("<u8"), total[mine].astype("<u8"), lengths)})
            open_ = np.minimum.reduceat(c, at) == 0
            out += [{"kind": NEED, "block": block, "bucket": bucket, "part": i, "h": k} for i, k in zip(np.flatnonzero(open_ & (total[mine] > 0)).tolist(), keys[mine][open_ & (total[mine] > 0)].view(np.int64).tolist(), strict=True)]
        edges = np.r_[own_h, len(pair_h)]
        for i in np.flatnonzero(needed | split).tolist():
            a, b = edges[i], edges[i + 1]
            out.append({"kind": HISTORY, "h": int(keys[i : i + 1].view(np.int64)[0]), "m": seen[i].tolist(), "p": float(p[i]), "rare": pair_w[a:b][rare[a:b]].view(np.int64).tolist()})
        for i in range(0, len(out), 5000):
            yield _batch(out[i : i + 5000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for block, b, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if b != bucket and rows:
                    yield from judge(bucket, rows)
                    rows = []
                bucket = b
                rows.append((block, data))
        if rows:
            yield from judge(bucket, rows)

    return run


def _score(model, given: Discounts):
    """Rows of whole blocks in order (ANSWERS, WEIGHTS, TEXTS by kind as numbered below) -> each text's figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        block, answers, weights, ready = None, [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                name, kind = batch.column(1)[i].as_py(), batch.column(0)[i].as_py()
                if name != block:
                    block, answers, weights, ready = name, [], [], None
                if kind == ANSWERS:
                    answers.append((batch.column(2)[i].as_py(), load(batch.column(4)[i].as_py())))
                    continue
                if kind == WEIGHTS:
                    weights.append((batch.column(2)[i].as_py(), batch.column(8)[i].values.to_numpy(), batch.column(11)[i].values.to_numpy()))
                    continue
                if ready is None:
                    answers.sort(key=lambda x: x[0])
                    offset, at = {}, 0
                    for b, (_, totals, _) in answers:
                        offset[b], at = at, at + len(totals)
                    alpha = np.ones(at)
                    for b, place, x in weights:
                        alpha[offset[b] + place] = x
                    lengths = np.concatenate([x[2] for _, x in answers])
                    ready = np.concatenate([x[0] for _, x in answers]).astype(np.int64), np.repeat(np.concatenate([x[1] for _, x in answers]).astype(np.int64), lengths), np.repeat(alpha, lengths)
                place, sizes = load(batch.column(4)[i].as_py())
                pair_c, history_c, alpha = (x[place] for x in ready)
                sizes = sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                word_c = np.r_[history_c[1:], 0]  # a word's count is that of the history it is to the next
                word_c[ends - 1] = m.texts
                chance = m.chance(word_c)
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(pair_c > 0, given.kept(pair_c) / np.maximum(history_c, 1), np.where(history_c > 0, alpha, 1.0) * chance)
                starts = ends - sizes
                total = lambda x: np.add.reduceat(x, starts)
                base = np.log10((word_c + 1) / (m.tokens + m.distinct + 1))
                columns = (batch.column(6)[i].as_py(), sizes, total((word_c > 0).astype(np.int64)), np.full(len(sizes), m.tokens), total(base), total(np.log10(p)))
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(5)[i].as_py(), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def backoff_weights(histories: DataFrame, words: DataFrame, unigrams: Unigrams, given: Discounts) -> DataFrame:
    """(h, m, p, rare) by part -> h, alpha: what h's seen words leave of its chance, over what they leave of the unigrams' chance."""
    k = MOST_DISCOUNTED
    plain = words.select("words").mapInArrow(lean(_unpack_words), "w bigint, c bigint")
    chances = F.array(*[F.lit(r * unigrams.discounts.factors[r - 1]) for r in range(1, k + 1)])
    chance = F.when(F.col("c") > k, F.col("c") - LOSS).otherwise(F.get(chances, F.col("c").cast("int") - 1)) / float(max(unigrams.tokens, 1))
    rare = histories.select("h", F.explode("rare").alias("w")).join(plain, "w").groupBy("h").agg(F.sum(chance).alias("rare_p"))
    m = lambda r: F.sum(F.get("m", F.lit(r)))
    left = F.lit(0.0)
    for r in range(1, k + 1):
        left = left + (1 - given.factors[r - 1]) * r * m(r - 1)
    total = F.lit(0)
    for r in range(1, k + 1):
        total = total + r * m(r - 1)
    sums = histories.groupBy("h").agg((left + LOSS * m(k)).alias("left"), (total + m(k + 1)).alias("total"), F.sum("p").alias("p"))
    return sums.join(rare, "h", "left").select("h", (F.col("left") / F.col("total") / (1 - F.col("p") - F.coalesce("rare_p", F.lit(0.0)))).alias("alpha"))


def score_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows that aren't held out. Tokens are lower-cased words and an end. The chance of a word after the one
    before it (the first: after the start) is its discounted count over the history's; for a bigram not seen, the history's weight
    times the word's discounted unigram chance; after a history not seen, that chance itself; all words not seen share what the
    discounted unigrams leave. For each history the chances of all words, the unseen together, sum to 1.

    Defined cases: a null or empty text is its end alone; null held_out counts as false; ids may be null or repeated; without training
    rows every token is unseen and has chance 1; an empty table gives an empty result; other columns are ignored. Words are told
    apart by 64-bit hashes. docs must give the same rows in the same order when read again, as tables do.

    Distinct bigrams of a block of texts meet those of others by a hash of the history, hot histories by the word too; counts go
    back to the block; texts travel as places in its list of bigrams.
    """
    spark = docs.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_of(docs, F.col("text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    words, unigrams = count_unigrams(rows.where("not held_out"), buckets)
    model = spark.sparkContext.broadcast(unigrams)  # FREQUENT words and a few numbers
    pairs = rows.mapInArrow(lean(_blocks(model, buckets, PAIRS)), ROWS).select(*NAMES).repartition("bucket").sortWithinPartitions("bucket", "block")
    answers = staged(pairs.mapInArrow(lean(_answer(model)), ROWS), "bigrams")
    n = answers.where(F.col("kind") == COUNTS).agg(*[F.sum(F.get("m", F.lit(r))) for r in range(MOST_DISCOUNTED + 3)]).first()
    given = discounts([x or 0 for x in n])
    weights = backoff_weights(answers.where(F.col("kind") == HISTORY).select("h", "m", "p", "rare"), words, unigrams, given)
    needed = answers.where(F.col("kind") == NEED).select("block", "bucket", "part", "h").join(weights, "h")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in answers.schema.fields}
    packed = needed.groupBy("block", "bucket").agg(F.collect_list(F.struct("part", "alpha")).alias("w"))  # a block's histories of a bucket
    own = {"kind": F.lit(WEIGHTS), "block": F.col("block"), "bucket": F.col("bucket"), "m": F.col("w.part").cast("array<bigint>"), "alphas": F.col("w.alpha")}
    back = packed.select(*[own[c].alias(c) if c in own else empty[c] for c in NAMES])
    texts = rows.mapInArrow(lean(_blocks(model, buckets, TEXTS)), ROWS)
    together = texts.unionByName(back).unionByName(answers.where(F.col("kind") == ANSWERS))
    in_order = together.repartition("block").sortWithinPartitions("block", F.when(F.col("kind") == TEXTS, 9).otherwise(F.col("kind")), "bucket", "part")
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return in_order.mapInArrow(lean(_score(model, given)), out)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by the model, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "text"))
