"""Whitening, the divergence audit and decontamination, against brute-force versions and their SQL on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import decontaminate, divergence, whitening
from tidemark.llm.registry import SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spelt(text, kind=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(kind, (text or "").translate(LOWER))


# whitening


def brute_whitening(rows):
    """Eigenvectors of the covariance of the distinct integer vectors, by numpy, with exact deviations."""
    good = [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return good, n, sums, values[order], vectors[:, order]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_whitening_equals_the_eigenvectors(spark, scale):
    draw = np.random.default_rng(5)
    basis = draw.normal(size=(20, 20)) * np.logspace(0, -2, 20)
    rows = [(i, (draw.normal(size=20) @ basis * scale).astype(np.float64).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (None, rows[1][1]), (301, None), (302, [None] * 20), (303, [float("nan")] + [0.0] * 19), (304, [0.0] * 19 + [float("inf")]), (305, [])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, x string, whitened double").repartition(3)
    good, n, sums, values, vectors = brute_whitening(rows)
    got = defaultdict(dict)
    out = whitening.whiten(df).collect()
    for r in out:
        got[r["vec_id"]][r["component"]] = r
    kept = [k for k in range(min(16, 20)) if values[k] > 1e-13 * values[0]]
    assert Counter(r["vec_id"] for r in out) == Counter({i: 16 * c for i, c in Counter(i for i, _ in good).items()}) and len(kept) == 16
    signs = {}
    for i, x in good:
        assert all(int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) and r["n"] == n for r in got[i].values())
        for k in kept:
            want = (np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ vectors[:, k]) / np.sqrt(values[k])
            have = got[i][k + 1]["whitened"]
            signs.setdefault(k, np.sign(want * have) if abs(want) > 1e-3 else 0) or signs.pop(k)
            assert abs(want * signs.get(k, np.sign(want * have)) - have) < 1e-6 * max(1, abs(want))
            assert abs(got[i][k + 1]["explained"] - values[k] / values.sum()) < 1e-9 and got[i][k + 1]["identity_error"] < 1e-8


def test_whitening_of_dependent_columns_and_little(spark):
    shape = "vec_id long, embedding array<float>"
    draw = random.Random(2)
    flat = [(i, [float(draw.randrange(9)), float(draw.randrange(9))]) for i in range(40)]
    flat = [(i, [a, b, a + b, 7.0]) for i, (a, b) in flat]  # two directions only
    out = whitening.whiten(spark.createDataFrame(flat, shape)).collect()
    assert {r["component"] for r in out} == {1, 2} and len(out) == 80 and max(r["identity_error"] for r in out) < 1e-8
    assert abs(sum(r["explained"] for r in out if r["vec_id"] == 0) - 1) < 1e-12
    one = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], shape)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], shape)).dtypes == whitening.whiten(spark.createDataFrame(flat, shape)).dtypes
    with pytest.raises(Exception, match="as many entries"):
        whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5])], shape)).count()


def test_whitening_survives_ill_conditioned_vectors(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(-(1 << 28), 1 << 28, size=(200, 1))
    rows = [(i, (np.r_[b, b + draw.integers(-2, 3), draw.integers(-2, 3)] / 64).tolist()) for i, b in enumerate(base)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in out} == {1, 2, 3} and max(r["identity_error"] for r in out) < 1e-4


# the audit of sources


def held_against_sql(spark, name, found, **tables):
    con = duckdb.connect()
    for k, df in tables.items():
        con.register(k, df.toArrow())
    result = con.execute(SQL[name])
    columns = sorted(c[0] for c in result.description)
    want = Counter(tuple(r[k] for k in columns) for r in (dict(zip([c[0] for c in result.description], row, strict=True)) for row in result.fetchall()))
    assert sorted(found.columns) == columns
    assert Counter(tuple(r[k] for k in columns) for r in found.collect()) == want


def test_divergence_equals_sql_on_awkward_rows(spark, awkward, nothing):
    many = awkward
    for _ in range(3):
        many = many.unionByName(many)  # repeated rows are documents of their own
    held_against_sql(spark, "op12_divergence", divergence.audit(many.repartition(5)), documents=many)
    assert divergence.audit(nothing).count() == 0
    held_against_sql(spark, "op12_divergence", divergence.audit(awkward), documents=awkward)  # next to no kept terms


def test_divergence_of_many_sources_and_blocks(spark, monkeypatch):
    """Tiles of few groups, chunks of few terms, blocks of few documents: the same result."""
    draw = random.Random(9)
    terms = [bytes(draw.choice(b"abc") for _ in range(draw.choice((1, 2, 3, 5, 9, 17, 33)))).decode() for _ in range(150)] + ["é" * k for k in range(1, 70, 7)]
    rows = [(i, " ".join(draw.choices(terms, k=draw.randrange(40))), draw.choice(("en", "de", "")), f"s{draw.randrange(13)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, value in (("TILE", 3), ("CHUNK", 20)):
        monkeypatch.setattr(divergence, name, value)
    held_against_sql(spark, "op12_divergence", divergence.audit(docs.repartition(6)), documents=docs)


def test_a_prefix_of_too_few_documents_goes_with_all_its_terms(spark):
    """Counted prefixes are those of documents, not of terms: many terms of one prefix in few documents don't keep it."""
    rows = [(i, " ".join(f"zz{chr(97 + k)}q" for k in range(26)), "en", "s") for i in range(9)] + [(100 + i, "abcd", "en", "s") for i in range(10)]
    terms = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("lang", "source", "text").mapInArrow(divergence._terms, divergence.TERMS).cache()
    kept = divergence.kept_terms(terms).collect()
    assert [bytes(r["term"]) for r in kept] == [b"abcd\0"]


def test_shares_keep_clear_of_overflow(spark):
    from pyspark.sql import functions as F

    big = 4_000_000_000_000_000
    cases = [(0, 0, 1), (5, 9, 3), (big, big + 7, 10), (12_345_678_901, 98_765_432_109, 77_777)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
    assert [int(divergence._share(np.array([c]), np.array([n]), v)[0]) for c, n, v in cases] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


# decontamination


def brute_contamination(docs, items, slop):
    """Each text word by word, each phrase at each place."""
    out = []
    for doc_id, text in docs:
        w, hit, exact, near = spelt(text), set(), {}, set()
        for number, (name, item) in enumerate(items):
            p = spelt(item)
            size = min(10, len(p))
            windows = [p[k : k + size] for k in range(len(p) - size + 1)] if p else []
            for window in windows:
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == window:
                        hit |= set(range(at, at + size))
                        exact[number] = name
            if number not in exact and any(not Counter(x) - Counter(w[at : at + size + slop]) for x in windows for at in range(len(w))):
                near.add(str("" if name is None else name))
        names = sorted({str("" if n is None else n) for n in exact.values()})
        out.append((doc_id, len(w), len(hit), tuple(names), tuple(sorted(near))))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [300, 1 << 23])
def test_decontamination_equals_brute_force(spark, monkeypatch, awkward, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    draw = random.Random(4)
    common = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(draw.choices(common + [f"r{k}x{j}" for j in range(20)], k=draw.randrange(26)))) for k in range(25)]
    items += [(None, "One, TWO three?"), (90, "one"), (91, None), (92, " .,; "), (93, "the the the the the the the the the the"), (93, items[3][1]), ("94", "東京 ünïcödé 🙂 words here and more of them to come")]
    docs = []
    for i in range(40):
        w = draw.choices(common, k=draw.randrange(60))
        for _ in range(2):
            p = (draw.choice(items)[1] or "").split()
            a = draw.randrange(len(w) + 1)
            cut = p[draw.randrange(4) :]
            if i % 3 == 0:
                draw.shuffle(cut)
            if i % 5 == 0:
                cut = [x for y in cut for x in (y, draw.choice(common))][: 2 * len(cut) - 1]
            w[a:a] = cut
        docs.append((i % 37, draw.choice((" ", "\n", ", ", "-")).join(w)))
    docs += [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()] + [docs[0], docs[0]]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, term string").repartition(4)
    asked = spark.createDataFrame([(None if n is None else str(n), t, "clash") for n, t in items], "item_id string, text string, block string")
    for slop in (0, 10):
        out = decontaminate.search(decontaminate.index(table), asked, slop=slop)
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["near"])) for r in out.collect())
        assert got == brute_contamination(docs, items, slop)
    out = decontaminate.search(decontaminate.index(table), asked, slop=None).collect()
    assert not any(r["near"] for r in out) and sum(r["n_hit"] for r in out) == sum(k[2] * v for k, v in got.items())


def test_decontamination_of_nothing(spark, nothing, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(decontaminate.index(nothing), none).count() == 0
    out = decontaminate.search(decontaminate.index(awkward), none).collect()
    assert len(out) == awkward.count() and not any(r["n_hit"] or r["items"] for r in out)
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.search(decontaminate.index(nothing), some).count() == 0


def test_queries_equal_their_sql(spark):
    small = "/root/testdata/sf0.001"
    for name, query in (("op12_divergence", divergence.op12_divergence), ("op13_decontaminate", decontaminate.op13_decontaminate)):
        tables = {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark")}
        held_against_sql(spark, name, query(spark, small), **tables)
    found = whitening.op11_whitening(spark, small).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    good, n, sums, values, _ = brute_whitening(rows)
    assert len(found) == 16 * len(good) and all(abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-10 for r in found)
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in good}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in found)
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in decontaminate.op13_decontaminate(spark, small).collect()}
