"""What the operators of this folder share: written tables, words and their hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Text bytes that a Python worker handles at once; bounds its memory whatever the batch.
SLICE_BYTES = 1 << 21
#: Words whose hashes a Python worker remembers.
CACHED_WORDS = 100_000
#: Text bytes whose packed records one hash bucket gathers; bounds what a worker holds, whatever the input's size.
BUCKET_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode, as in tests; elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Lists that get the path of each table written while they are open.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables written within."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)


def discard(spark: SparkSession, paths: list[str], needed: DataFrame) -> None:
    """Remove written tables that no result needs any more; those whose files `needed` reads stay."""
    read = needed.inputFiles()
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in f for f in read):
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder is the cluster's to clear
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The table is read by the lazy result, so it is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    for paths in _OPEN:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_apart(df: DataFrame, second: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """As staged(), in one pass, two tables: the rows for which `second` doesn't hold, and those for which it does, which drop_staged() can remove before the others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    for paths in _OPEN:
        paths.append(path)
    writers, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    spark.conf.set(writers, "2")  # else the rows are sorted first
    try:
        df.withColumn("second", F.when(second, 1).otherwise(0)).write.option("compression", "zstd").partitionBy("second").parquet(path)
    finally:
        spark.conf.unset(writers) if before is None else spark.conf.set(writers, before)
    read = []
    for k in (0, 1):
        part = f"{path}/second={k}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)  # where there are no such rows
        read.append(spark.read.schema(df.schema).parquet(part))
    return read[0], read[1]


def drop_staged(df: DataFrame) -> None:
    """Remove a table of staged_apart(), which nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)


def numbered(docs: DataFrame) -> DataFrame:
    """docs -> row (its columns, as a struct) and number: one for each row, whatever its id and however often it occurs.

    Rows are numbered where they are read, so that several reads of docs give a row the same number. A table that comes out of a shuffle, which may deal
    its rows anew each time, is written first.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    shuffled = "Exchange" in docs._jdf.queryExecution().executedPlan().toString()
    return staged(out, "numbered") if shuffled else out


def buckets_of(docs: DataFrame, text: Column, size: int = BUCKET_BYTES) -> int:
    """Hash buckets for the texts of docs: one for each `size` bytes, spark.sql.shuffle.partitions at least. Reads the texts once, for their sizes."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def lean(run: Callable) -> Callable:
    """A function for mapInArrow whose worker, which lives on for other tasks, gives freed memory back to the system at its end."""

    @functools.wraps(run)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return freed


def whole(text: str | Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, as an array, in the JVM."""
    return F.filter(F.split(whole(text), GAP), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


class WordHashes(dict):
    """bytes -> 64-bit hash; remembers the first CACHED_WORDS words it meets."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = h
        return h


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


#: Whether a byte stands between words; what is left of 8 bytes for a word that has so many; words of more bytes than LONG are hashed one by one.
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LEFT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
LONG = 512


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the texts, and each text's number of words; no word becomes an object. Words are mixed 8 bytes at a
    time, after their lengths; the hashes aren't those of hash_words()."""
    raw = b" ".join([b"", *texts, b" " * 8]).lower()
    x = np.frombuffer(raw, np.uint8)
    space = _SPACE[x]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.arange(8)
    part = lambda at, n: x[at[:, None] + eight].view("<u8").ravel() & _LEFT[np.minimum(n, 8)]
    h = mix64(mix64(part(starts, sizes)) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))
    k, rest = 8, np.flatnonzero(sizes > 8)
    while len(rest) and k < LONG:
        h[rest] = mix64(h[rest] * np.uint64(0x9E3779B97F4A7C15) + part(starts[rest] + k, sizes[rest] - k))
        k += 8
        rest = rest[sizes[rest] > k]
    for i in rest.tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return h, np.diff(np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of consecutive rows that together hold about `most` bytes; null is empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        part = texts.slice(at, stop - at)
        yield at, [t or b"" for t in part.cast(pa.large_binary() if pa.types.is_large_string(part.type) else pa.binary()).to_pylist()]
        at = stop


def split_all(texts: list[bytes], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in one list, and each text's number of words. bytes.split() parts at exactly the gaps of GAP."""
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = (t.lower() if lower else t).split()
        counts[i] = len(own)
        words += own
    return words, counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
