"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHED_WORDS, lean, slices, table

#: Labelled rows that the fit uses at most, on average; beyond it a sample by hash of the id.
MOST_LABELLED = 200_000
LEAST_Z = 3.0
LEAST_COUNT = 5
#: Bytes of a token's beginnings that are features beside the token itself; words that vary at their ends share them.
PREFIXES = (4, 5, 6, 7)
#: Share of toxic tokens that a toxic passage is taken to have; sets what every other token costs.
DENSITY = 0.05
#: Chance below which a passage is significant in a text of clean tokens as long as its own.
SIGNIFICANT = 0.05
#: ASCII punctuation and control characters part tokens as gaps do.
PARTS = bytes(b if b >= 128 or chr(b).isalnum() or chr(b) in "'-_" else 32 for b in range(256))


class Model(NamedTuple):
    scores: dict[bytes, float]
    other: float
    decay: float
    slope: float
    offset: float


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(PARTS).split()


def features(token: bytes) -> list[bytes]:
    """The token, and its beginnings marked by a star, the longest first."""
    return [token, *(token[:k] + b"*" for k in reversed(PREFIXES) if len(token) > k)]


class TokenScores(dict):
    """token -> its score: that of its first feature that has one, or 0."""

    def __init__(self, scores: dict[bytes, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, token: bytes) -> float:
        score = next((self.scores[f] for f in features(token) if f in self.scores), 0.0)
        if len(self) < CACHED_WORDS:
            self[token] = score
        return score


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def segments(scores: np.ndarray, places: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a text in which places[i] scores scores[i] > 0 and every other
    token `other` < 0, in time linear in the places (Ruzzo and Tompa, 1999): none can be extended or joined for a higher score."""
    found: list[list] = []  # first, end, total before, total after
    total, at = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total += other * (place - at)
        new = [place, place + 1, total, total + score]
        total, at = total + score, place + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


def significant(model: Model, hits: np.ndarray, places: np.ndarray, n: int) -> list[tuple[int, int, float]]:
    """Segments whose chance in n clean tokens, 1 - exp(-n exp(-decay * score)), is below SIGNIFICANT; the score in excess of ln n, in nats."""
    return [(a, b, x) for a, b, s in segments(hits, places, model.other) if (x := model.decay * s - math.log(n)) > -math.log(-math.log1p(-SIGNIFICANT))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for at, texts in slices(batch.column(0)):
            both = Counter(), Counter()
            for t, label in zip(texts, labels[at:], strict=False):
                both[label].update({f for w in set(tokens(t)) for f in features(w)})
            seen = list({**both[0], **both[1]})
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([both[0][w] for w in seen], pa.int64()), pa.array([both[1][w] for w in seen], pa.int64())], ["token", "clean", "toxic"])


def _passages(model):
    """(doc_id, text) -> (doc_id, n_tokens, passages)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known = TokenScores(m.scores)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                sizes, found = [], []
                for t in texts:
                    own = tokens(t)
                    scored = np.fromiter(map(known.__getitem__, own), np.float64, len(own))
                    places = np.flatnonzero(scored)
                    sizes.append(len(own))
                    found.append([{"start": a, "end": b, "score": s} for a, b, s in significant(m, scored[places], places, len(own))] if len(places) else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(found, kind)], ["doc_id", "n_tokens", "passages"])

    return run


def _evidence() -> Column:
    """What a text's passages say together: the logarithm of 1 + their summed excess."""
    return F.log1p(F.aggregate("passages", F.lit(0.0), lambda a, p: a + p["score"]))


def _decay(shares: list[tuple[float, float]], other: float) -> float:
    """The positive root of sum(share * exp(root * score)) = 1 over clean tokens; shares: (share, score) of those above 0."""
    rest = 1 - sum(p for p, _ in shares)
    excess = lambda x: sum(p * math.exp(min(x * s, 700.0)) for p, s in shares) + rest * math.exp(x * other) - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(low, 1e-6)


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over (x, clean, toxic), by Newton's method with a slight ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = -1e-3 * a, -1e-3 * b, 1e-3, 0.0, 1e-3
        for x, clean, toxic in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            n, e = clean + toxic, toxic - (clean + toxic) * p
            w = max(n * p * (1 - p), 1e-12)
            ga, gb, haa, hab, hbb = ga + e * x, gb + e, haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2 / (abs(da) + abs(db) + 1e-12))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 0.0), b


def fit(docs: DataFrame, labels: DataFrame, calibrate: Column, label_col: str = "toxic") -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, label_col of 0 or 1): token scores from rows where `calibrate` (over doc_id)
    is false, and the curve from evidence to probability from the others.

    About MOST_LABELLED labelled rows are used at most, by hash of the id; their ids are broadcast, so that texts are not shuffled.
    A feature's score is the log-odds of its share of the toxic texts' features against its share of the clean ones', each text
    counting a feature once, and both sides having a Dirichlet prior of the toxic side's size dealt by the shares in all texts; features
    of LEAST_COUNT toxic texts or more and a z of LEAST_Z or more keep theirs, and all others cost alike. Rows without a label or id are left out;
    of several labels of one id the highest counts. Without usable labels no token scores, and every text gets the same probability.
    """
    spark = docs.sparkSession
    labelled = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = labelled.count()
    if n > MOST_LABELLED:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * MOST_LABELLED / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")
    counts = rows.where(~calibrate).select("text", "label").mapInArrow(lean(_count), "token binary, clean bigint, toxic bigint").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    n_clean, n_toxic = totals["clean"] or 0, totals["toxic"] or 0
    chosen = []
    if n_clean and n_toxic:
        prior = F.lit(float(n_toxic)) * (F.col("clean") + F.col("toxic")) / float(n_clean + n_toxic)
        t, c = F.col("toxic") + prior, F.col("clean") + prior
        odds = F.log(t / (2.0 * n_toxic - t)) - F.log(c / (float(n_clean + n_toxic) - c))
        scored = counts.where(F.col("toxic") >= LEAST_COUNT).select("token", "clean", odds.alias("score"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"), (c / float(n_clean + n_toxic)).alias("share"))
        chosen = scored.where(F.col("z") >= LEAST_Z).collect()  # tokens of MOST_LABELLED texts at most that stand out among them
    other = math.log(1 - DENSITY)
    model = Model({bytes(r["token"]): r["score"] for r in chosen}, other, _decay([(r["share"], r["score"]) for r in chosen], other) if chosen else 1.0, 1.0, 0.0)
    evidence = find_passages(rows.where(calibrate).select("doc_id", "text"), model).select("doc_id", F.round(_evidence(), 2).alias("x")).join(F.broadcast(labelled), "doc_id")
    curve = evidence.groupBy("x").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic")).collect()  # x has a few hundred values
    slope, offset = _logistic([(r["x"], r["clean"], r["toxic"]) for r in curve])
    return model._replace(slope=slope, offset=offset)


def find_passages(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, passages (array of start and end in tokens, and score: excess in nats)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, passages array<struct<start:int,end:int,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(lean(_passages(shared)), schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """find_passages() with score, the probability that the text is toxic, and predicted (1 from one half on).

    Defined cases: a null, empty or blank text has no passages and gets the probability of a text without evidence; ids may be null or
    repeated; an empty table gives an empty result; other columns are ignored.
    """
    return find_passages(docs, model).withColumn("score", 1 / (1 + F.exp(-(F.lit(model.slope) * _evidence() + F.lit(model.offset))))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability to be toxic, learnt from the labels of the rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0), calibrate=remainder("doc_id", 5) == 4)
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
