"""Byte-level BPE: every distinct word is encoded once, and ids return to their places by joins."""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table

#: Text bytes whose words share one local dictionary; bounds a worker's memory.
BLOCK_BYTES = 12 << 20
#: Words above this many bytes are merged by a heap.
LONG_WORD = 96
#: Encoded words that a worker remembers; beyond it, it starts anew.
MOST_REMEMBERED = 1_000_000
BLOCKS = "route bigint, block string, kind int, bucket int, part int, payload binary, ids array<bigint>, counts array<int>"
KINDS = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
NAMES = ["route", "block", "kind", "bucket", "part", "payload", "ids", "counts"]
#: Rows of a block: packed words (or their ids) of a bucket; the buckets of its words, the most frequent first; packed texts.
WORDS, DEALT, TEXTS = 0, 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of the lowest rank, the leftmost on ties, is joined until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    get, none = ranks.get, 1 << 60
    parts = [word[i : i + 1] for i in range(len(word))]
    cost = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while cost and (least := min(cost)) < none:
        i = cost.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        if i:
            cost[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(cost):
            cost[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() in n log n steps: parts are linked, and a heap holds the pairs that have a rank."""
    n = len(word)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i: where it ends, where the one before starts
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            back[stop] = i
        offer(i)
        if back[i] >= 0:
            offer(back[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _pack(values: np.ndarray) -> bytes:
    """32-bit integers, mostly small: a byte each, where 255 refers to the rest, whose bytes are grouped by significance; compressed."""
    x = values.astype("<u4")
    rest = x[x >= 255] - np.uint32(255)
    return struct.pack("<I", len(x)) + zstandard.compress(np.minimum(x, 255).astype(np.uint8).tobytes() + rest.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _unpack(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    raw = np.frombuffer(zstandard.decompress(data[4:]), np.uint8)
    out = raw[:n].astype(np.int64)
    out[out == 255] += np.frombuffer(raw[n:].reshape(4, -1).T.tobytes(), "<u4")
    return out


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 9)


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n + 1)[1:]) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1]], ends, strict=True)] if n else []


class Numbers(dict):
    """Counts upwards for each new key."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Places(dict):
    """What stands between two spaces -> the numbers of its words, the space before it included."""

    def __init__(self, find, numbers: Numbers):
        super().__init__()
        self.find, self.numbers = find, numbers

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        places = self[chunk] = tuple(map(self.numbers.__getitem__, self.find(" " + chunk)))
        return places


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), KINDS, strict=True)], NAMES)


def _to_blocks(pattern: str, buckets: int):
    """(doc_id, text) -> blocks: the distinct words of a block by bucket (WORDS), the buckets by falling frequency of their words
    (DEALT), and the texts as ranks of their words (TEXTS).

    `pattern` must part texts so that a single space before something else than white space goes with what follows it, as
    byte-level BPE patterns do; texts without two white spaces in a row are then cut at their spaces, and each distinct piece is parted once.
    """
    find = regex.compile(pattern).findall
    cut_by_pattern = re.compile(r"\s\s").search

    def close(block: str, numbers: Numbers, texts: list) -> Iterator[pa.RecordBatch]:
        words = [w.encode("utf-8") for w in numbers]
        by_frequency = np.argsort(-np.bincount(np.concatenate([np.empty(0, np.int64), *(t[0] for t in texts)]), minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by_frequency] = np.arange(len(words))
        dealt = np.fromiter((xxhash.xxh64_intdigest(words[i]) % buckets for i in by_frequency.tolist()), np.int64, len(words))
        order = np.argsort(dealt, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(dealt[order]) != 0]) if len(words) else np.array([], np.int64)
        home = xxhash.xxh64_intdigest(block.encode()) >> 1
        packed = [(int(dealt[order[a]]), block, WORDS, int(dealt[order[a]]), 0, _pack_words([words[i] for i in by_frequency[order[a:b]].tolist()]), None, None) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=False)]
        yield from _rows(packed + [(home, block, DEALT, -1, 0, _pack(dealt), None, None)])
        for part, (seen, ids, counts) in enumerate(texts):
            yield from _rows([(home, block, TEXTS, -1, part, _pack(rank[seen]), ids, counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = TaskContext.get().partitionId(), 0
        numbers, rows, held = Numbers(), [], 0
        places = Places(find, numbers)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in slices(batch.column(1)):
                seen, counts = [], []
                for t in texts:
                    text, before = t.decode("utf-8"), len(seen)
                    if cut_by_pattern(text):
                        seen += map(numbers.__getitem__, find(text))
                    else:
                        first, *rest = text.split(" ")
                        seen += map(numbers.__getitem__, find(first))
                        seen += chain.from_iterable(map(places.__getitem__, rest))
                    counts.append(len(seen) - before)
                    held += len(t)
                rows.append((np.array(seen, np.int64), ids[at : at + len(texts)], counts))
                if held >= BLOCK_BYTES:
                    yield from close(f"{task}-{blocks}", numbers, rows)
                    numbers, rows, held, blocks = Numbers(), [], 0, blocks + 1
                    places = Places(find, numbers)
        if rows:
            yield from close(f"{task}-{blocks}", numbers, rows)

    return run


def _encode_words(ranks):
    """WORDS rows: their words -> their ids (number of ids of each word, then all ids); other rows pass. A word always comes to the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        table_ = ranks.value
        for batch in batches:
            made = []
            for kind, data in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if kind != WORDS:
                    made.append(data)
                    continue
                counts, ids = [], []
                for w in _unpack_words(data):
                    own = known.get(w)
                    if own is None:
                        if len(known) >= MOST_REMEMBERED:
                            known.clear()
                        own = known[w] = merge(w, table_)
                    counts.append(len(own))
                    ids += own
                made.append(_pack(np.array([len(counts), *counts, *ids], np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary()), *batch.columns[6:]], NAMES)

    return run


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run of `count` places."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of block, kind, bucket and part -> doc_id and tokens (little-endian unsigned 32-bit integers)."""
    block, parts, starts, counts, flat = None, [], None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            name, kind, data = batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), _unpack(batch.column(5)[i].as_py())
            if name != block:
                block, parts, flat = name, [], None
            if kind == WORDS:
                parts.append(data)
            elif kind == DEALT:
                by_bucket = np.argsort(data, kind="stable")  # ranks in the order in which the buckets' words come
                came = np.concatenate([np.empty(0, np.int64), *(p[1 : 1 + p[0]] for p in parts)])
                flat = np.concatenate([np.empty(0, np.int64), *(p[1 + p[0] :] for p in parts)]).astype("<u4")
                counts, starts = np.empty(len(came), np.int64), np.empty(len(came), np.int64)
                counts[by_bucket] = came
                starts[by_bucket] = np.cumsum(came) - came
                parts = []
            else:
                own = counts[data]
                tokens = flat[_spread(starts[data], own)].tobytes()
                ends = np.r_[0, np.cumsum(own)]
                cut = 4 * ends[np.r_[0, np.cumsum(np.array(batch.column(7)[i].as_py(), np.int64))]]
                made = [tokens[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(6)[i].as_py(), pa.int64()), pa.array(made, pa.binary())], ["doc_id", "tokens"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, tokens (binary: ids as little-endian unsigned 32-bit integers) by the ranks in `path`, without special tokens.

    Each match of `pattern` is a word. Distinct words of a block of texts go, with the others of their hash bucket, to the task of
    that bucket, which merges each distinct word once; ids go back to the block, where they take the words' places. Words travel
    once for each block that has them, however often; texts travel as ranks of their words. A block is named by its task and
    number, so docs must give the same rows in the same order if a lost task runs again, as tables do. Defined cases: a null or empty text has no tokens; null or
    repeated ids stay rows of their own; an empty table gives an empty result; other columns are ignored. Ids must fit a long.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranks = spark.sparkContext.broadcast(read_ranks(path))  # of fixed size: the vocabulary
    encoded = rows.mapInArrow(lean(_to_blocks(pattern, buckets)), BLOCKS).repartition("route").mapInArrow(lean(_encode_words(ranks)), BLOCKS)
    return encoded.repartition("block").sortWithinPartitions("block", "kind", "bucket", "part").mapInArrow(lean(_assemble), "doc_id bigint, tokens binary")


def decode(tokens: DataFrame, path: str, tokens_col: str = "tokens") -> DataFrame:
    """tokens with a binary column `decoded`: each id's bytes from the token-byte table, a broadcast of the vocabulary's fixed size.

    A null is decoded as no tokens. An id that the vocabulary lacks is an error.
    """
    spark = tokens.sparkSession
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    pieces = spark.sparkContext.broadcast(by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces.value.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index(tokens_col)
            made = [b"".join(map(piece, np.frombuffer(t or b"", "<u4").tolist())) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"])

    kept = [f for f in tokens.schema.fields if f.name != "decoded"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["decoded binary"])
    return tokens.select(*[f"`{f.name}`" for f in kept]).mapInArrow(lean(run), schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id (id_col of docs), n_tokens, ids_sha256 and decoded_sha256 of every row of docs, encoded and decoded again."""
    both = decode(encode(docs, path, pattern, id_col), path)
    return both.select("doc_id", F.expr("octet_length(tokens) div 4").cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of what they decode to."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
