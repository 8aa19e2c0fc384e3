"""Source divergence audit: the terms of each language that enough documents hold, found by iceberg refinement of byte prefixes, and how sources differ in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, slices, staged, table, whole

#: Documents of a language that a kept term is in, at least.
LEAST = 10
#: Ranks of terms for each group.
MOST = 10
#: Bytes of the first prefixes; each further level has twice as many.
FIRST_LEVEL = 2
#: Text bytes whose terms one block holds, and terms that one chunk compares.
BLOCK_BYTES, CHUNK = 32 << 20, 4096
#: Groups of a language that one tile of the comparison has on a side.
TILE = 256
#: Shares are counted in parts of UNITS; every count is raised by PRIOR.
UNITS, PRIOR = 1_000_000_000, 2
_LETTERS = set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_FOLD = bytes(c if c in _LETTERS else 32 for c in bytes(range(256)).lower())
TERMS = "lang string, term binary, since int, docs array<int>, sources array<string>, counts array<bigint>"


def levels_to(longest: int) -> list[int]:
    """Prefix lengths, level by level, until one holds the longest."""
    found = [FIRST_LEVEL]
    while found[-1] < longest:
        found.append(2 * found[-1])
    return found


def shared_bytes(terms: list[bytes]) -> np.ndarray:
    """Of each of the sorted terms the number of bytes that it shares with the one before; the first shares none."""
    known = 64
    m = np.array(terms, f"S{known}").view(np.uint8).reshape(len(terms), known)
    differs = m[1:] != m[:-1]
    found = np.where(differs.any(1), differs.argmax(1), known)
    for i in np.flatnonzero(found == known).tolist():
        a, b = terms[i], terms[i + 1]
        found[i] = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return np.r_[0, found]


class _Block:
    def __init__(self) -> None:
        self.size, self.docs = 0, 0
        self.numbers: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.ids, self.counts, self.group = [], [], []

    def add(self, langs: list, sources: list, texts: list[bytes]) -> None:
        numbers = self.numbers
        found: list[bytes] = []
        for t in texts:
            own = t.translate(_FOLD).split()
            self.counts.append(len(own))
            found += own
            self.size += len(t)
        self.ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
        self.group += [self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)]
        self.docs += len(texts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """For each language its terms in byte order, each ended by a zero byte: the documents of the block that hold a term with the same prefix, for
        each level at which the term is the first of its prefix, and its occurrences by source."""
        if not self.numbers:
            return
        terms = sorted(self.numbers)
        n = len(terms)
        rank = np.empty(n, np.int64)
        rank[np.fromiter(map(self.numbers.__getitem__, terms), np.int64, n)] = np.arange(n)
        self.numbers.clear()
        pairs = np.repeat(np.arange(self.docs) * n, self.counts)
        pairs += rank[np.concatenate(self.ids)]
        self.ids.clear()
        pairs.sort()
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        times = np.diff(first, append=len(pairs)).astype(np.int32)
        pairs = pairs[first]
        doc, ids = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        del pairs, first
        group = np.array(self.group, np.int32)[doc]
        langs = sorted({lang for lang, _ in self.groups})
        lang_of = np.array([langs.index(lang) for lang, _ in self.groups])
        names = [source for _, source in self.groups]
        for k, lang in enumerate(langs):
            mine = lang_of[group] == k
            yield from self._language(lang, terms, doc[mine], ids[mine], group[mine], times[mine], names)

    def _language(self, lang: str, terms: list[bytes], doc: np.ndarray, ids: np.ndarray, group: np.ndarray, times: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        used = np.unique(ids)
        own = [terms[i] + b"\0" for i in used.tolist()]
        ids = np.searchsorted(used, ids).astype(np.int32)
        n, lengths = len(own), np.fromiter(map(len, own), np.int64, len(used))
        shared = shared_bytes([t[:-1] for t in own])
        shared[0] = -1
        levels = levels_to(int(lengths.max()))
        since = np.searchsorted(levels, shared, "right")  # the first level at which a term isn't in the group of the one before
        since[0] = 0
        done = np.searchsorted(levels, lengths)  # the level that holds the whole term
        width = np.maximum(done - since + 1, 0)
        ends = np.cumsum(width)
        docs = np.zeros(int(ends[-1]), np.int64)
        for j, level in enumerate(levels):
            prefix = np.cumsum(shared < level) - 1
            found = prefix[ids]
            new = np.r_[True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]
            held = np.bincount(found[new], minlength=prefix[-1] + 1)
            first = np.flatnonzero((shared < level) & (done >= j))
            docs[(ends - width)[first] + j - since[first]] = held[prefix[first]]
        by_source = ids.astype(np.int64) * len(names) + group
        order = np.argsort(by_source)
        by_source = by_source[order]
        first = np.flatnonzero(np.r_[True, by_source[1:] != by_source[:-1]])
        by_source, counts = by_source[first], np.add.reduceat(times[order].astype(np.int64), first)
        cuts = np.r_[np.searchsorted(by_source, np.arange(n) * len(names)), len(by_source)].astype(np.int32)
        source = pa.array(names, pa.string()).take(pa.array(by_source % len(names)))
        columns = [
            pa.array([lang] * n, pa.string()), pa.array(own, pa.binary()), pa.array(since, pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(docs, pa.int32())),
            pa.ListArray.from_arrays(pa.array(cuts), source), pa.ListArray.from_arrays(pa.array(cuts), pa.array(counts, pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "since", "docs", "sources", "counts"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches:
        for at, texts in slices(batch.column(2)):
            block.add(batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(1).slice(at, len(texts)).to_pylist(), texts)
            if block.size >= BLOCK_BYTES:
                yield from block.rows()
                block = _Block()
    yield from block.rows()


def kept_terms(terms: DataFrame, least: int = LEAST) -> DataFrame:
    """terms of TERMS -> lang, term of those that `least` documents of their language hold, by refinement of prefixes.

    At each level documents are counted for each prefix whose own prefix of the level before was kept; the others are discarded, and with them
    all terms that begin so, before they are ever counted. A level has twice the bytes of the one before, so the number of rounds is the logarithm of
    the longest kept prefix. A prefix that ends with a term's zero byte is a whole term: if it is kept, the term is.
    """
    rows = terms.select("lang", "term", "since", "docs")
    survivors, kept, level, before = None, [], 0, 0
    while True:
        size = FIRST_LEVEL << level
        prefix = F.substring("term", 1, size).alias("prefix")
        here = rows.where((F.octet_length("term") > before) & (F.col("since") <= level))
        if survivors is not None:
            here = rows.where(F.octet_length("term") > before).withColumn("held", F.substring("term", 1, before)).join(survivors.select("lang", F.col("prefix").alias("held")), ["lang", "held"], "left_semi").where(F.col("since") <= level)
        docs = F.sum(F.get("docs", F.lit(level) - F.col("since")).cast("long")).alias("docs")
        keys = ["lang", "prefix"] if survivors is None else ["lang", "held", "prefix"]  # dealt by held already
        found = staged(here.withColumn("prefix", prefix).groupBy(*keys).agg(docs).where(F.col("docs") >= least).select("lang", "prefix", "docs"), f"level-{size}")
        ended = F.substring("prefix", -1, 1) == F.lit(b"\0")
        kept.append(found.where(ended).select("lang", F.col("prefix").alias("term")))
        survivors = found.where(~ended)
        if survivors.isEmpty():
            break
        level, before = level + 1, size
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNITS * (count + PRIOR) / (n + PRIOR * v)) in integers, by three steps of long division, which keep clear of 2^63."""
    top, base = count + PRIOR, n + PRIOR * v
    whole_part, rest = F.call_function("div", top, base), top % base
    for _ in range(3):
        whole_part, rest = whole_part * 1000 + F.call_function("div", rest * 1000, base), (rest * 1000) % base
    return whole_part + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _share(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    top, base = count + PRIOR, n + PRIOR * v
    found, rest = top // base, top % base
    for _ in range(3):
        found, rest = found * 1000 + rest * 1000 // base, rest * 1000 % base
    return found + 1


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, term, source, count, n, v, here) in order of tile, groups (term null) first -> (tile, a, b, value): the distance of each pair
    of a tile's groups, summed over the chunk's terms. here is the number of kept terms of the chunk."""
    now, groups, rows = None, None, None

    def finish() -> Iterator[pa.RecordBatch]:
        sides = [sorted({g for s, g in groups if s == k}) for k in (0, 1)]
        diagonal = now[2] == now[3]
        if not sides[0] or not (diagonal or sides[1]):
            return
        v, here = groups[0, sides[0][0]][1:]
        matrices, numbers = [], {}
        for k in (0, 1):
            names = sides[0 if diagonal else k]
            place = {g: i for i, g in enumerate(names)}
            own = [r for r in rows if r[0] == (0 if diagonal else k)]
            counts = np.zeros((len(names), here), np.int64)
            counts[[place[r[2]] for r in own], [numbers.setdefault(r[1], len(numbers)) for r in own]] = [r[3] for r in own]
            matrices.append(_share(counts, np.array([groups[0 if diagonal else k, g][0] for g in names], np.int64)[:, None], v))
        a, b, value = [], [], []
        for i, g in enumerate(sides[0]):
            p, q = matrices[0][i], matrices[1][i + 1 :] if diagonal else matrices[1]
            d = p - q
            found = (d * d // (p + q)).sum(1)
            other = sides[0][i + 1 :] if diagonal else sides[1]
            a, b, value = a + [g] * len(other), b + list(other), value + found.tolist()
        yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

    for batch in batches:
        for lang, chunk, x, y, side, term, source, count, n, v, here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, chunk, x, y) != now:
                if now is not None:
                    yield from finish()
                now, groups, rows = (lang, chunk, x, y), {}, []
            if term is None:
                groups[side, source] = (n, v, here)
            else:
                rows.append((side, term, source, count))
    if now is not None:
        yield from finish()


def audit(docs: DataFrame, least: int = LEAST, most: int = MOST, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs -> lang, source, part, item, value and rank. A term is a run of letters, ASCII ones lower-cased, or of characters beyond ASCII; a language
    keeps the V terms that `least` of its documents hold. A group, the documents of one language and source, gives each kept term the share
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its occurrences of all kept terms, and so does the language. The distance of two shares is
    floor((p - q)^2 / (p + q)). Part `pair`: the sum of distances from each other source of the language, all ranks. Part `term`: the distance of
    terms that the group has and uses more than its language, the first `most` ranks. Ranks go by falling value, then by item's bytes.

    Defined cases: null text, lang or source count as empty; empty and wordless texts make their group occur; ids don't matter, so that repeated rows
    count as often as they are there; a language without kept terms has distances of 0 and no terms; an empty table gives an empty result; other
    columns are ignored.

    Documents are cut into terms once, by block, and written with the numbers of documents that each prefix of each level has in the block; the
    levels join and count those rows. Pairs are compared in tiles of TILE groups a side and CHUNK terms: a task adds distances up over its terms,
    and only these sums meet. Counts are exact integers up to 9 * 10^15.
    """
    named = docs.select(*[whole(F.col(f"`{c}`")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    terms = staged(named.mapInArrow(lean(_terms), TERMS), "terms")
    kept = staged(kept_terms(terms, least), "kept")
    spread = terms.select("lang", "term", "sources", "counts").join(kept, ["lang", "term"]).select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("s"))
    counts = staged(spread.groupBy("lang", "term", F.col("s.sources").alias("source")).agg(F.sum("s.counts").alias("count")), "term-counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = staged(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    return _pairs(groups, counts, kept).unionByName(_terms_used(groups, counts, most))


def _ranked(df: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")


def _terms_used(groups: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    both = counts.withColumn("all", F.sum("count").over(Window.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
    whole_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("all"), F.col("lang_n"), F.col("v"))
    found = both.join(whole_lang, "lang").select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    item = F.expr("cast(substring(term, 1, octet_length(term) - 1) as string)")
    ranked = found.select("lang", "source", F.lit("term").alias("part"), item.alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return ranked.select("*", _ranked(ranked)).where(F.col("rank") <= most)


def _pairs(groups: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.max(F.ceil(F.col("v") / CHUNK)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("term"), F.greatest("chunks", F.lit(1))).cast("int").alias("chunk")
    here = kept.join(tiles, "lang").select("lang", chunk).groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("here"))
    side = F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile")
    placed = groups.join(tiles, "lang").select("lang", "source", "n", "v", "tiles", side)
    chunks = tiles.select("lang", F.explode(F.sequence(F.lit(0), F.greatest("chunks", F.lit(1)) - 1)).alias("chunk")).join(here, ["lang", "chunk"], "left").select("lang", "chunk", F.coalesce("here", F.lit(0)).alias("here"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    at = [F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side")]
    headers = placed.select("*", other).join(chunks, "lang").select("lang", "chunk", *at, F.lit(None).cast("binary").alias("term"), "source", F.lit(None).cast("long").alias("count"), "n", "v", "here")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("v", "long"), ("here", "int"))]
    rows = counts.join(tiles, "lang").select("lang", chunk, side, "tiles", "term", "source", "count").select("*", other).select("lang", "chunk", *at, "term", "source", "count", *none)
    work = headers.unionByName(rows).repartition("lang", "chunk", "x", "y").sortWithinPartitions("lang", "chunk", "x", "y", F.col("term").isNotNull(), "side")
    sums = work.mapInArrow(lean(_tiles), "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    both = sums.select("lang", "value", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    return both.select("*", _ranked(both))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ from each other, and in which terms from their language."""
    return audit(table(spark, sf_dir, "documents"))
