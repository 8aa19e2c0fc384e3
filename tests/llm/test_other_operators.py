"""Chat formatting, top-k search, components and the pipeline."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import chat, graph, topk
from tidemark.llm.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def test_chat_round_trip(spark):
    odd = [r"\### Assistant: </turn> ok", "</turn>\n### user: x", "&lt;&amp;#", "", None, "a: b", "é🙂"]
    rows = [(c, i, role, odd[(c + i) % len(odd)]) for c in range(6) for i, role in enumerate(["user", "assistant", "us:er#", None, "assistant"])]
    rows += [(9, None, "user", "x"), (9, 1, "assistant", "y"), (9, 1, "assistant", "y"), (None, 0, "user", "alone")]
    nodes = chat.linear_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.read_back(chat.format_paths(nodes, chat.best_paths(nodes))).collect()
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out}
    for c in range(6):
        assert back[c] == [(r or "", t or "") for k, _, r, t in rows if k == c]
    assert len(back[9]) == 3 and back[-(1 << 63)] == [("user", "alone")]
    for r in out:
        spans = r["loss_spans"]
        learnt = [chat_unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in spans if s]
        assert learnt == [t["text"] for t in r["turns"] if t["role"] == "assistant"] and len(spans) == len(r["turns"])


def chat_unescape(text):
    for plain, code in reversed(chat.ESCAPES):
        text = text.replace(code, plain)
    return text


def test_reply_trees(spark):
    """All root-to-leaf paths by recursion, ranked by total score; parents that don't exist, and a cycle."""
    import random

    draw = random.Random(1)
    nodes = [(c, i, None if i == 0 else draw.randrange(i), float(draw.randrange(10))) for c in range(4) for i in range(40)]
    nodes += [(7, 1, 99, 1.0), (7, 2, 1, None), (8, 1, 2, 1.0), (8, 2, 1, 1.0)]
    score, up = {(c, i): s or 0 for c, i, _, s in nodes}, {(c, i): (c, p) if (c, p) in {(a, b) for a, b, *_ in nodes} else None for c, i, p, _ in nodes}

    def path(n):
        found = [n]
        while up[found[-1]] and len(found) <= len(nodes):
            found.append(up[found[-1]])
        return found[::-1]

    want = {}
    for c in (0, 1, 2, 3, 7):
        leaves = [n for n in score if n[0] == c and n not in up.values()]
        ranked = sorted(leaves, key=lambda n: (-sum(score[x] for x in path(n)), n[1]))[:3]
        want |= {(c, k + 1): [x[1] for x in path(n)] for k, n in enumerate(ranked)}
    got = {}
    for r in chat.best_paths(spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, score double"), branches=3).orderBy("depth").collect():
        got.setdefault((r["conv_id"], r["branch"]), []).append(r["node_id"])
    assert got == want


def test_chat_query(spark):
    conversations = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    by = {-7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]}
    for r in sorted(conversations, key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    for r in QUERIES["op6_chat"](spark, SMALL).collect():
        turns = by.pop(r["conv_id"])
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert not by


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=12) * (1 + i % 5)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [nan] * 12), (303, [inf] * 12), (304, []), (305, [0.0] * 12), (306, rows[0][1]), (307, rows[0][1]), (308, [0.5, -0.5]), (None, rows[1][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.floor(np.array([*v, *[0.0] * (12 - len(v))]) * 256).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in whole:
        if q % 7 == 0:
            ranked = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 7 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == want
    few = vectors.where("vec_id in (0, 1)")
    assert topk.top_k(few, few, 5).count() == 2
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Thousands of rows of one id, which fill several blocks, and that id as a query more than once."""
    rows = [(50, [3.0, 4.0])] * 9000 + [(1, [1.0, 1.0]), (2, [1.0, 0.5]), (3, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([rows[0], rows[0], rows[-1]], vectors.schema)
    got = Counter(tuple(r) for r in topk.top_k(vectors, asked, 5).collect())
    score = lambda a, b: int(256 * 256 * sum(x * y for x, y in zip(a, b)))
    q, a, b, c = [3, 4], [1, 1], [1, 0.5], [0.5, 0.5]
    want = Counter({(50, 1, 1, score(q, a)): 2, (50, 2, 2, score(q, b)): 2, (50, 3, 3, score(q, c)): 2})
    assert got == want + Counter((3, k + 1, 50, score(q, c)) for k in range(5))


def test_chat_query_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    found = QUERIES["op6_chat"](spark, SMALL)
    want = db.sql(SQL["op6_chat"])
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())


def test_top_k_query_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = set(db.sql(SQL["op5_top_k"]).fetchall())
    assert {tuple(r) for r in QUERIES["op5_top_k"](spark, SMALL).collect()} == want


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 3), (3, 5), (9, 8), (8, 5), (2, None)], [(500, i) for i in range(300)] + [(500, i) for i in range(501, 800)] + [(i, i + 1000) for i in range(0, 300, 7)] + [(-1, 799), (2000, 2001)], [(i, 900) for i in range(300)] * 2 + [(i, i + 1) for i in range(900, 930)]])
def test_components(spark, links):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


def written(spark, folder, name, stage):
    """A stage as it is run: its rows are written and read again."""

    def run(session, docs, sf_dir):
        stage(session, docs, sf_dir).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return run


def test_pipeline(spark, tmp_path):
    """Each stage's rows against brute-force versions of what it decides."""
    from test_text_operators import base_of, shingles, stripped

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    stages = {n: written(spark, tmp_path, n, f) for n, f in stages.items()}
    good = stages["quality"](spark, docs, SMALL)
    assert all(not base_of(r["text"])[-1] for r in good.collect())
    unique = stages["near_duplicates"](spark, good, SMALL)
    sets = {r["doc_id"]: shingles(r["text"]) for r in good.collect()}
    root = {d: d for d in sets}
    for d in sorted(sets):
        for e in sorted(sets):
            if d < e and sets[d] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r["doc_id"] for r in unique.collect()} == {d for d in sets if root[d] == d}
    left = stages["substring_dedup"](spark, unique, SMALL)
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {(d, kept) for d, _, _, kept in stripped([r.asDict() for r in unique.collect()]) if kept}
    mixed = stages["mixing"](spark, left, SMALL)
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2 and mixed.columns == docs.columns
    out = stages["encoding"](spark, mixed, SMALL).collect()
    parts = sorted(mixed.inputFiles(), key=lambda f: f.rsplit("/", 1)[1])
    in_order = [(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for f in parts for r in spark.read.parquet(f).collect()]
    assert [(r["doc_id"], r["decoded_sha256"]) for r in sorted(out, key=lambda r: r["place"])] == in_order
    assert Counter(r["decoded_sha256"] for r in out) == Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect())
    assert Counter(tuple(r)[1:] for r in corpus_pipeline.run(spark, SMALL).collect()) == Counter(tuple(r)[1:] for r in out)
