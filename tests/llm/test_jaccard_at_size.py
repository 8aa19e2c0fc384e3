"""The Jaccard join where many texts share lines: what they have in common must not make candidates of them all."""

import random

import numpy as np
from tidemark.llm import common, jaccard


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_shared_lines_make_no_candidates(spark, monkeypatch):
    """600 texts with two of five lines each, and a near copy of every tenth."""
    draw, rows = random.Random(31), []
    lines = [" ".join(f"l{k}w{i}" for i in range(14)) for k in range(5)]
    for i in range(600):
        own = [" ".join(f"t{i}x{draw.randrange(10**6)}" for _ in range(30)) for _ in range(5)]
        rows.append((len(rows), "\n".join([own[0], draw.choice(lines), own[1], own[2], draw.choice(lines), *own[3:]])))
        if i % 10 == 0:
            rows.append((len(rows), rows[-1][1] + " and a little more"))
    met, tiled = [], jaccard._tiled
    monkeypatch.setattr(jaccard, "_tiled", lambda sets: met.append(sets.count()) or tiled(sets))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = {d for d, t in rows if t.endswith("more")}
    assert got == {d: (d - 1, 1) if d in copies else (d, int(d + 1 in copies)) for d, _ in rows}
    assert len(copies) == 60 and met[0] < 200  # of 660 sets


def test_linked_sets_share_a_key_whatever_is_spared():
    """Pairs at and around the threshold, over several bands: under any order of keys the first ones meet, as far as each family may not spare them."""
    draw = np.random.default_rng(32)
    for n in [*range(1, 60, 3), 71, 72, 73, 107, 108, 161, 300, 700]:
        for _ in range(4):
            full = np.unique(draw.integers(0, 2**63, 2 * n).astype(np.uint64))[: 2 * n]
            draw.shuffle(full)
            change = int(draw.integers(0, n // 9 + 1))
            a, b = full[:n], np.r_[full[change:n], full[n : n + int(draw.integers(0, change + 1))]]
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if not both or 100 * both < 80 * either:
                continue
            keys, family, owner, tag = jaccard.tile_keys([np.sort(a), np.sort(b), np.sort(full[n:])])
            spare = tag & ((1 << jaccard.SPARE_BITS) - 1)
            for salt in range(5):
                order = common.mix64(keys + np.uint64(salt))
                kept = [set(), set(), set()]
                for f in range(len(owner)):
                    own = keys[family == f][np.argsort(order[family == f])]
                    kept[owner[f]] |= set(own[: len(own) - spare[f]].tolist())
                assert kept[0] & kept[1], (n, change)


def test_words_are_hashed_as_split():
    texts = [b"", b" \t\n", b"A b\x0bB", "été 東京 naïve one".encode(), b"a\0 a\0\0 a", b"12345678 123456789 1234567 12345678", b"z" * 600 + b" " + b"z" * 601 + b" " + b"Z" * 600, b"  x "]
    h, counts = common.hashed_words(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    assert [x.tolist() for x in common.hashed_words([])] == [[], []]


def test_overlaps_by_products_and_by_marks_agree(monkeypatch):
    draw = np.random.default_rng(33)
    base = draw.integers(0, 2**63, 200).astype(np.uint64)
    rows = [(bytes([i]), int(draw.integers(1, 4)), np.unique(np.r_[base[draw.random(200) > draw.random() * 0.2], draw.integers(0, 2**63, int(draw.integers(0, 12))).astype(np.uint64)])) for i in range(60)]
    rows.sort(key=lambda r: len(r[2]))
    sets = [set(r[2].tolist()) for r in rows]
    linked = [[100 * len(a & b) >= 80 * len(a | b) and a is not b for b in sets] for a in sets]
    for split in (None, 25):
        across = lambda i, j: split is None or (i < split) != (j < split)
        want = [sum(rows[j][1] for j in range(60) if linked[i][j] and across(i, j)) for i in range(60)]
        assert 0 < sum(map(bool, want)) and len(set(want)) > 5
        for wide, columns in ((32, 4096), (32, 7), (0, 7)):
            monkeypatch.setattr(jaccard, "WIDE", wide)
            monkeypatch.setattr(jaccard, "COLUMNS", columns)
            links, forest = jaccard.judge_tile(rows[:split] if split else rows, rows[split:] if split else None)
            assert links.tolist() == want
            at = {r[0]: i for i, r in enumerate(rows)}
            assert all(linked[at[a]][at[b]] for a, b in forest)
            up = {r[0]: r[0] for r in rows}

            def top(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in forest:
                assert top(a) != top(b)  # a forest
                up[top(a)] = top(b)
            assert all(top(rows[i][0]) == top(rows[j][0]) for i in range(60) for j in range(60) if linked[i][j] and across(i, j))
