"""Benchmark decontamination: a positional inverted index of the training texts, searched from the rarest words of each phrase."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, staged, table, whole

#: Words of a phrase.
WINDOW = 10
#: Words that may stand between those of a phrase, in all, in a match by proximity.
SLOP = 10
#: Text bytes of a block of the index; bounds what a task holds.
BLOCK_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII characters other than digits and letters, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = set(b"0123456789" + LOWER.encode()) | set(range(128, 256))
_FOLD = bytes(c if c in _LETTERS else 32 for c in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))
INDEX = "block bigint, term binary, n bigint, places binary, start bigint, doc_id bigint"


def words(text: Column) -> Column:
    """The lower-cased words of a text as binary values, in the JVM."""
    return F.transform(F.filter(F.split(F.translate(whole(text), UPPER, LOWER), GAP), lambda w: w != ""), lambda w: w.cast("binary"))


class _Numbers(dict):
    """word -> its number in the order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Texts in one stream of places, a place apart from each other, so that no phrase reaches over an end."""

    def __init__(self, number: int) -> None:
        self.number, self.size, self.next = number, 0, 0
        self.terms, self.ids, self.places, self.starts, self.counts = _Numbers(), [], [], [], []
        self.docs: list = []

    def add(self, docs: list, texts: list[bytes]) -> None:
        found: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.translate(_FOLD).split()
            counts[i] = len(own)
            found += own
            self.size += len(t)
        self.ids.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
        self.places.append((self.next + np.arange(len(found)) + np.repeat(np.arange(len(texts)), counts)).astype(np.uint32))
        self.starts.append(self.next + np.r_[0, np.cumsum(counts)[:-1]] + np.arange(len(texts)))
        self.counts.append(counts)
        self.docs += docs
        self.next += len(found) + len(texts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each text, then one for each term: its places, rising, as differences."""
        names = ["block", "term", "n", "places", "start", "doc_id"]
        n = len(self.docs)
        empty = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), empty, pa.array(np.concatenate(self.counts)), empty, pa.array(np.concatenate(self.starts)), pa.array(self.docs, pa.int64())], names)
        n = len(self.terms)
        if not n:
            return
        ids, places = np.concatenate(self.ids), np.concatenate(self.places)
        order = np.argsort(ids, kind="stable")
        places = places[order]
        ends = np.cumsum(np.bincount(ids, minlength=n))
        first = np.r_[0, ends[:-1]]
        steps = np.diff(places, prepend=np.uint32(0))
        steps[first] = places[first]
        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * np.r_[0, ends]).astype(np.int32).tobytes()), pa.py_buffer(steps.astype("<u4").tobytes())])
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), pa.array(list(self.terms), pa.binary()), pa.array(ends - first), packed, none, none], names)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    block = _Block(number)
    for batch in batches:
        for at, texts in slices(batch.column(1)):
            block.add(batch.column(0).slice(at, len(texts)).to_pylist(), texts)
            if block.size >= BLOCK_BYTES:
                yield from block.rows()
                number += 1
                block = _Block(number)
    if block.docs:
        yield from block.rows()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of docs, as a written table: for each block of about BLOCK_BYTES of text and each of its terms the term's places,
    and for each text (term null) its id, number of words and first place.

    A text's blocks are made where it is read: nothing is shuffled, a frequent term is one row a block, and each row stands for itself, so a
    task that runs again may cut its blocks anew.
    """
    return staged(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(_indexed), INDEX), "index")


def phrases_at(lists: list, order: np.ndarray, first: int, size: int) -> np.ndarray:
    """Places at which the words first, ..., first + size - 1 of an item stand in a row: offset-adjusted lists, intersected from the rarest on."""
    rarest, *rest = sorted(range(first, first + size), key=order.__getitem__)
    found = lists[rarest] - (rarest - first)
    for k in rest:
        if not len(found):
            break
        there, wanted = lists[k], found + (k - first)
        at = np.searchsorted(there, wanted)
        found = found[there[np.minimum(at, len(there) - 1)] == wanted]
    return found


def near_at(lists: list, order: np.ndarray, first: int, size: int, stretch: int, edges: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Places of the rarest of the words first, ..., first + size - 1 around which all of them, each as often, stand in some order within
    `stretch` words of one text, but for the texts left out. Those with too few of another word about them go first, the rarest of the others
    asked first."""
    window = sorted(range(first, first + size), key=order.__getitem__)
    kinds: dict[int, list] = {}
    for k in window:
        kinds.setdefault(id(lists[k]), [lists[k], 0])[1] += 1
    kinds = list(kinds.values())
    found = lists[window[0]]
    text = np.searchsorted(edges, found, "right")
    found, text = found[~left_out[text - 1]], text[~left_out[text - 1]]
    low, high = np.maximum(found - stretch + 1, edges[text - 1]), np.minimum(found + stretch, np.r_[edges, np.iinfo(np.int64).max][text])
    for there, times in kinds:
        enough = np.searchsorted(there, high) - np.searchsorted(there, low) >= times
        found, low, high = found[enough], low[enough], high[enough]
        if not len(found):
            return found
    good = [i for i in range(len(found)) if _covers([(t[np.searchsorted(t, low[i]) : np.searchsorted(t, high[i])], n) for t, n in kinds], stretch)]
    return found[good]


def _covers(places: list[tuple[np.ndarray, int]], stretch: int) -> bool:
    """Whether some `stretch` places in a row hold as many of each list as it asks for."""
    events = sorted((int(p), k) for k, (own, _) in enumerate(places) for p in own)
    lacking, held, left = sum(n for _, n in places), [0] * len(places), 0
    for p, k in events:
        held[k] += 1
        lacking -= held[k] <= places[k][1]
        while events[left][0] <= p - stretch:
            out = events[left][1]
            lacking += held[out] <= places[out][1]
            held[out] -= 1
            left += 1
        if not lacking:
            return True
    return False


class _Search:
    """What items hit in one block."""

    def __init__(self, number: int, window: int, slop: int | None) -> None:
        self.number, self.window, self.slop = number, window, slop
        self.starts: list[int] = []
        self.lists: dict[bytes, np.ndarray] = {}
        self.hits: list[np.ndarray] = []
        self.exact: dict[int, set] = {}
        self.near: dict[int, set] = {}

    def item(self, name: str, terms: list[bytes], order: np.ndarray) -> None:
        edges = np.array(self.starts, np.int64)  # rows come in this order
        lists = [self.lists.get(t) for t in terms]
        size = min(self.window, len(terms))
        gone = np.cumsum([0, *[x is None for x in lists]])
        whole_windows = [k for k in range(len(terms) - size + 1) if gone[k + size] == gone[k]]
        covered = []
        for k in whole_windows:
            found = phrases_at(lists, order, k, size)
            if len(found):
                covered.append((found[:, None] + np.arange(size)).ravel())
        met: set[int] = set()
        if covered:
            places = np.unique(np.concatenate(covered))
            self.hits.append(places)
            met = set(np.unique(np.searchsorted(edges, places, "right") - 1).tolist())
            for t in met:
                self.exact.setdefault(t, set()).add(name)
        if len(self.hits) > 64:
            self.hits = [np.unique(np.concatenate(self.hits))]
        if self.slop is not None:
            done = np.zeros(len(edges), bool)
            done[list(met)] = True
            for k in whole_windows:
                text = np.searchsorted(edges, near_at(lists, order, k, size, size + self.slop, edges, done), "right") - 1
                done[text] = True
                for t in set(text.tolist()):
                    self.near.setdefault(t, set()).add(name)

    def rows(self) -> pa.RecordBatch:
        edges = np.array(self.starts, np.int64)
        places = np.unique(np.concatenate(self.hits)) if self.hits else np.empty(0, np.int64)
        hit = np.bincount(np.searchsorted(edges, places, "right") - 1, minlength=len(edges))
        met = sorted(self.exact.keys() | self.near.keys())
        made = [[self.number] * len(met), edges[met].tolist(), hit[met].tolist() if met else [], [sorted(self.exact.get(t, ())) for t in met], [sorted(self.near.get(t, ())) for t in met]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds, strict=True)], ["block", "start", "n_hit", "items", "near"])


def _searched(window: int, slop: int | None):
    """Rows (block, kind, start, term, places, name, terms, counts), in order of block, kind and start -> what each text holds of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            block, kind, start, term, places, name, terms, counts = (c.to_pylist() for c in batch.columns)
            for i, b in enumerate(block):
                if now is None or b != now.number:
                    if now is not None and (now.exact or now.near):
                        yield now.rows()
                    now = _Search(b, window, slop)
                if kind[i] == 0:
                    now.starts.append(start[i])
                elif kind[i] == 1:
                    now.lists[term[i]] = np.cumsum(np.frombuffer(places[i], "<u4").astype(np.int64))
                else:
                    now.item(name[i], terms[i], np.array(counts[i], np.int64))
        if now is not None and (now.exact or now.near):
            yield now.rows()

    return run


def search(found: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = SLOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """An index() and items -> doc_id, n_words, n_hit, items and near of every text of the index.

    A phrase is `window` words in a row of an item; an item of fewer words, but not none, is one phrase. n_hit counts the text's words inside any
    occurrence of a phrase; items lists, as strings, the ids of the items with an occurring phrase, near those without one of which all words
    of a phrase, each as often, stand in any order within `slop` more words than the phrase has (slop None: not searched, near is empty).

    Frequencies of the items' words come from the index. Each phrase is looked for only in blocks that hold its rarest word; there the
    lists of its words are shifted by their offsets and intersected, the rarest first. Only lists of words that items have travel, each to its
    block's task; items go to blocks by a join, so that neither side is broadcast unless Spark knows it to be small.

    Defined cases: null, empty and wordless texts have no words and no hits, and such items are in nothing; a null item_id is listed as an empty
    string; items of one id are listed once; repeated rows and null or repeated doc_ids stay rows of their own; an empty table of texts gives an
    empty result, one of items no hits; words are compared whole, not by hashes; other columns are ignored, whatever their names.
    """
    texts, postings = found.where("term is null"), found.where("term is not null")
    rows = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("name"), words(F.col(f"`{text_col}`")).alias("terms"), F.monotonically_increasing_id().alias("item"))
    asked = staged(rows.where(F.size("terms") > 0), "items")
    spelt = asked.select("item", F.posexplode("terms").alias("offset", "term"))
    vocabulary = staged(spelt.select("term").distinct(), "vocabulary")
    counts = staged(postings.select("term", "n").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")), "counts")
    known = spelt.join(counts, "term", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("offset", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("spelt"))
    asked = staged(asked.join(known, "item").select("item", "name", "terms", "spelt.n", "spelt").withColumnRenamed("n", "counts"), "asked")
    size = F.least(F.size("spelt"), F.lit(window))
    by_count = F.transform("spelt", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term")))
    seeds = F.transform(F.sequence(F.lit(1), F.size("spelt") - size + 1), lambda k: F.array_min(F.slice(by_count, k, size)))
    seeds = asked.select("item", F.explode(F.array_distinct(seeds)).alias("seed")).where("seed.n > 0").select("item", "seed.term")
    where = postings.select("block", "term").join(seeds, "term").select("block", "item").distinct()
    nothing = lambda kind: F.lit(None).cast(kind)
    shape = {"start": "bigint", "term": "binary", "places": "binary", "name": "string", "terms": "array<binary>", "counts": "array<bigint>"}
    row = lambda df, kind, *has: df.select("block", F.lit(kind).alias("kind"), *[F.col(c) if c in has else nothing(t).alias(c) for c, t in shape.items()])
    parts = row(texts, 0, "start").unionByName(row(postings.join(vocabulary, "term", "left_semi"), 1, "term", "places")).unionByName(row(where.join(asked, "item"), 2, "name", "terms", "counts"))
    hits = parts.repartition("block").sortWithinPartitions("block", "kind", "start").mapInArrow(lean(_searched(window, slop)), "block bigint, start bigint, n_hit bigint, items array<string>, near array<string>")
    none = F.array().cast("array<string>")
    return texts.join(hits, ["block", "start"], "left").select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its words that lie in a passage of the benchmark, and the items whose passages it holds or holds nearly."""
    found = search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
