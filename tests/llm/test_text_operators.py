"""Operators over documents against brute-force versions, on awkward rows, on none, and on the smallest tables."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe, jaccard, katz, mixing, quality, sharding, substrings, toxicity
from tidemark.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(params=["awkward", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return WORD.findall(text or "")


def test_shards(docs, nothing):
    found, given = rows_of(sharding.assign_shards(docs, 24)), rows_of(docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in given)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(nothing, 24).count() == 0


def test_shards_move_little(spark):
    found = rows_of(sharding.assign_shards(spark.range(20000).selectExpr("id AS doc_id", "'x' AS text"), 10))
    moved = [r for r in found if r["shard"] != r["grown_shard"]]
    assert 0.07 < len(moved) / len(found) < 0.11 and {r["grown_shard"] for r in moved} == {10}
    assert max(Counter(r["shard"] for r in found).values()) < 2400


def targets(sizes):
    """Water-filling step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate > 2 * sizes[s] + 1e-9}
        if not full:
            return target | {s: weight[s] * rate for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(docs, nothing):
    found = rows_of(mixing.mix(docs))
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in rows_of(docs))
    want = targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
    largest = Counter()
    for r in found:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    first = [r["positions"][0] for r in found if r["positions"]]
    assert first == sorted(first)
    assert found == rows_of(mixing.mix(docs))
    assert mixing.mix(nothing).count() == 0


def test_training_order(small):
    plan = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix(small))}
    out = rows_of(mixing.in_training_order(small))
    assert Counter(r["doc_id"] for r in out) == Counter({d: n for d, n in plan.items() if n})
    assert list(out[0]) == small.columns


def test_stages_with_clashing_names_and_repeated_ids(awkward):
    """Every stage that gives rows of the table gives them whole, whatever their columns are called and however often an id occurs."""
    whole = lambda df: Counter(tuple(r.values()) for r in rows_of(df))
    given = whole(awkward)
    plan = rows_of(mixing.mix(awkward))
    out = whole(mixing.in_training_order(awkward))
    assert sum(out.values()) == sum(r["copies"] for r in plan) > 0 and set(out) <= set(given)
    by_text = Counter()
    for row, n in out.items():
        by_text[row[0], len(words(row[1]))] += n
    assert by_text == Counter({k: n for k, n in sum((Counter({(r["doc_id"], r["size"]): r["copies"]}) for r in plan), Counter()).items() if n})
    good = quality.keep_good(awkward)
    assert good.columns == awkward.columns and set(whole(good)) <= set(given)
    assert {r["doc_id"] for r in rows_of(good)} == {r["doc_id"] for r in rows_of(quality.judge(awkward)) if r["kept"]}
    unique = jaccard.keep_one(awkward)
    assert unique.columns == awkward.columns and set(whole(unique)) <= set(given)
    places = [awkward.columns.index(c) for c in ("text", "n_chars")]
    bare = lambda row: tuple(x for i, x in enumerate(row) if i not in places)
    left = rows_of(substrings.without_repeats(awkward))
    assert Counter(bare(tuple(r.values())) for r in left) == Counter(bare(tuple(r.values())) for r, (_, _, _, kept) in zip(rows_of(awkward), stripped(rows_of(awkward)), strict=True) if kept)


def base_of(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_quality(docs, nothing):
    found = rows_of(quality.judge(docs))
    key = lambda f: (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"])
    assert Counter((r["doc_id"], *key(r["_f"]), r["base_failed"]) for r in found) == Counter((r["doc_id"], *base_of(r["text"])) for r in rows_of(docs))
    assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5) for r in found)
    assert quality.judge(nothing).count() == 0


def test_quality_learns_accuracies(spark):
    """Votes drawn from known accuracies: the fit finds them, and its verdicts are nearly all right."""
    import random

    draw = random.Random(5)
    rows = []
    for i in range(6000):
        good = draw.random() < 0.8
        rows.append((good, [0 if draw.random() < 0.1 else -1 if draw.random() < (0.05 if good else 0.8) else 1 for _ in range(6)]))
    df = spark.createDataFrame(rows, "good boolean, votes array<int>")
    fit = quality.fit_votes(df.select("votes"))
    assert abs(fit["prior"] - 0.8) < 0.03 and all(abs(g - 0.05) < 0.03 for g in fit["good"]) and all(abs(b - 0.8) < 0.06 for b in fit["bad"])


def votes_of(text):
    """The six rules, written out: against (-1), in favour (1) or neither."""
    n, chars, symbols, dup, repeat, _ = base_of(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    rule = lambda against, favour: -1 if against else 1 if favour else 0
    return (
        rule(symbols > 0.3 * n, symbols <= 0.05 * n), rule(symbols > 0.08 * chars, symbols <= 0.01 * chars), rule(chars > 7 * n or chars < 3 * n, 4 * n <= chars <= 6 * n),
        rule(repeat > 0.4 * n, repeat <= 0.2 * n), rule(lines > 3 and dup > lines / 2, lines > 3 and dup <= lines / 10), rule(n < 50, n >= 100),
    )


def test_quality_posterior_against_a_document_at_a_time(small):
    """Expectation-maximisation over the documents one by one, with the bounds and starts that the operator states."""
    given = rows_of(small)
    votes = [votes_of(r["text"]) for r in given]
    bound = lambda x, low, high: min(max(x, low), high)
    prior, good, bad = 0.8, [0.05] * 6, [0.6] * 6

    def posterior(v):
        a, b = prior, 1 - prior
        for x, g, w in zip(v, good, bad):
            if x:
                a, b = a * (g if x < 0 else 1 - g), b * (w if x < 0 else 1 - w)
        return a / (a + b)

    for _ in range(20):
        p = [posterior(v) for v in votes]
        count = lambda weights, r, wanted: sum(w for w, v in zip(weights, votes) if v[r] in wanted)
        q = [1 - x for x in p]
        last = (prior, *good, *bad)
        prior = bound(sum(p) / len(p), 0.05, 0.98)
        good = [bound((count(p, r, (-1,)) + 0.05) / (count(p, r, (-1, 1)) + 1), 1e-4, 0.2) for r in range(6)]
        bad = [bound((count(q, r, (-1,)) + 0.6) / (count(q, r, (-1, 1)) + 1), 0.2, 0.999) for r in range(6)]
        if all(abs(x - y) < 1e-4 for x, y in zip(last, (prior, *good, *bad))):
            break
    want = {r["doc_id"]: posterior(v) for r, v in zip(given, votes)}
    found = rows_of(quality.judge(small))
    assert all(math.isclose(r["quality"], want[r["doc_id"]], abs_tol=1e-6) for r in found)
    assert {r["doc_id"] for r in found if r["kept"]} == {r["doc_id"] for r in given if want[r["doc_id"]] >= 0.5 and not base_of(r["text"])[-1]}


def test_quality_keeps_clean_documents(small, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = Counter((labels[r["doc_id"]], r["kept"]) for r in rows_of(quality.judge(small)) if r["doc_id"] in labels and not r["base_failed"])
    assert kept[1, False] <= 0.01 * kept[1, True]


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def test_similar(docs, nothing):
    given = rows_of(docs)
    sets = [shingles(r["text"]) for r in given]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    links = [[j for j in range(len(sets)) if j != i and linked(sets[i], sets[j])] for i in range(len(sets))]
    root = {}
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [given[j]["doc_id"] for j in seen if given[j]["doc_id"] is not None]
        root[i] = min(ids) if ids else None
    want = Counter((r["doc_id"], len(s), root[i], len(links[i])) for i, (r, s) in enumerate(zip(given, sets)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in rows_of(jaccard.similar(docs))) == want
    assert jaccard.similar(nothing).count() == 0


def test_similar_finds_every_link_of_edited_copies(spark):
    """Copies with a growing number of words changed, so that some pairs stand at the threshold; sizes across several bands."""
    import random

    draw, rows = random.Random(3), []
    for g, n in enumerate((7, 26, 33, 47, 60, 110, 300)):
        text = [f"{g}x{draw.randrange(10**6)}" for _ in range(n)]
        for k in range(14):
            own = list(text)
            for _ in range(k):
                own[draw.randrange(len(own))] = f"e{draw.randrange(10**6)}"
            if k % 3 == 0:
                own = own[: max(1, len(own) - k)]
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in rows}
    want = {d: sum(e != d and 100 * len(s & u) >= 80 * len(s | u) for e, u in sets.items()) for d, s in sets.items()}
    assert {r["doc_id"]: r["n_links"] for r in rows_of(jaccard.similar(docs))} == want
    assert len(set(want.values())) > 5


def stripped(given):
    """(words, removed, kept) by row, windows judged by the smallest id they start in; a null id comes last."""
    rank = lambda d: math.inf if d is None else d
    first = {}
    for r in given:
        w = words(r["text"])
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, math.inf), rank(r["doc_id"]))
    for r in given:
        w = words(r["text"])
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < rank(r["doc_id"]):
                gone |= set(range(i, i + 13))
        yield r["doc_id"], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)


def test_substrings(docs, nothing):
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows_of(substrings.strip_repeats(docs)))
    assert found == Counter(stripped(rows_of(docs)))
    assert substrings.strip_repeats(nothing).count() == 0


def test_substrings_of_few_words(spark):
    """Texts over two or three words hold runs and repeats of every length."""
    import random

    draw = random.Random(11)
    rows = [(i, " ".join(draw.choice("ab" if i % 2 else "abc") for _ in range(draw.randrange(10, 80)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows_of(substrings.strip_repeats(docs))}
    assert found == set(stripped([{"doc_id": d, "text": t} for d, t in rows]))


def test_substrings_that_many_rows_share(spark):
    """Passages of most rows, in blocks with one id, several, and none."""
    import random

    draw = random.Random(12)
    fresh = lambda n: [f"x{draw.randrange(10**6)}" for _ in range(n)]
    common, other = fresh(30), fresh(14)
    rows = []
    for i in range(240):
        d = None if i % 11 == 0 else 7 if i % 5 == 0 else draw.randrange(200)
        rows.append((d, " ".join(fresh(draw.randrange(20)) + common[draw.randrange(10) :] + fresh(draw.randrange(3)) + (other if i % 4 == 0 else []) + common[: draw.randrange(25)])))
    rows += [(None, " ".join(other[:1] + fresh(12) * 2)), (None, " ".join(fresh(3) * 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(stripped([{"doc_id": d, "text": t} for d, t in rows]))
    for parts in (1, 6, 40):
        found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows_of(substrings.strip_repeats(docs.repartition(parts))))
        assert found == want


def test_a_block_sends_few_items_of_a_key():
    """1,000 rows of a key, of which 40 are of the smallest id: two go to the bucket, or the 40; the rest are known."""
    import numpy as np

    ids = np.r_[np.full(40, 3), np.arange(4, 964), 5].astype(np.int64)
    item = np.r_[np.full(1000, 9), 8].astype(np.uint64)
    sent, known = substrings.shared_in_block(item, ids)
    assert (len(sent), len(known)) == (3, 1000)
    sent, known = substrings.later_in_block(item, ids)
    assert (len(sent), len(known)) == (41, 960) and set(sent) == {*range(40), 1000}
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    assert [len(x) for x in (*substrings.shared_in_block(*none), *substrings.later_in_block(*none))] == [0, 0, 0, 0]


def test_without_repeats(small):
    want = {d: kept for d, _, _, kept in stripped(rows_of(small)) if kept}
    out = rows_of(substrings.without_repeats(small))
    assert {r["doc_id"]: r["text"] for r in out} == want and list(out[0]) == small.columns
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_bpe(docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows_of(docs):
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    found = Counter(tuple(r.values()) for r in rows_of(bpe.digests(docs, RANKS, public_tokenizers.PATTERN)))
    assert found == want
    assert bpe.digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["n_tokens"] for r in rows_of(bpe.digests(docs, RANKS, public_tokenizers.PATTERN))] == [0, 0]


def test_bpe_merges_long_words_alike():
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import random

    draw = random.Random(2)
    for n in (90, 97, 400, 2000):
        word = "".join(draw.choice("abcdeinorst") for _ in range(n))
        assert bpe.merge(word.encode(), ranks) == bpe._merge_long(word.encode(), ranks) == library.encode_ordinary(word)


@pytest.mark.parametrize("text", ["a  b", "a \n b", " a", "a ", "  ", "a\n\nb", "it's  we'll", "x y", "a  b", "\ta", "don't 12ab ..!", " ?", "a 　b"])
def test_bpe_cuts_at_spaces_as_the_pattern_does(spark, text):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).first()["tokens"]
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode_ordinary(text)


def expected_scores(given, held):
    """The same model with plain dictionaries: (tokens, known, base, score) by row, and the chance function."""
    tokens = [words((r["text"] or "").translate(LOWER)) + ["\0end"] for r in given]
    one, two, after = Counter(), Counter(), Counter()
    for w, out in zip(tokens, held):
        if not out:
            h = ["\0start", *w[:-1]]
            one.update(w)
            two.update(zip(h, w))
            after.update(h)
    n, v = sum(one.values()), len(one)

    def factors(counts):
        """Good-Turing: r counts as (r + 1) n[r + 1] / n[r], scaled so that what is lost is what singletons stand for; r - 1/2 where that fails."""
        by = Counter(counts.values())
        rest = 6 * by[6] / by[1] if by[1] else 1.0
        found = []
        for r in range(1, 6):
            d = ((r + 1) * by[r + 1] / by[r] / r - rest) / (1 - rest) if by[r] and rest < 1 else -1.0
            found.append(d if 0 < d < 1 else (r - 0.5) / r)
        return found

    kept = lambda c, f: c - 0.5 if c > 5 else c * f[c - 1]
    f1, f2 = factors(one), factors(two)
    uni = {w: kept(c, f1) / n for w, c in one.items()}
    unknown = 1 - sum(uni.values())
    spent, below = defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        spent[h] += kept(c, f2) / after[h]
        below[h] += uni[w]

    def chance(h, w):
        if two[h, w]:
            return kept(two[h, w], f2) / after[h]
        return ((1 - spent[h]) / (1 - below[h]) if after[h] else 1.0) * uni.get(w, unknown)

    figures = [(len(w), sum(one[x] > 0 for x in w), sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(chance(h, x)) for h, x in zip(["\0start", *w[:-1]], w))) for w in tokens]
    return n, figures, chance, uni, after


def test_katz(docs, nothing):
    marked = docs.withColumn("held_out", toxicity.remainder("doc_id", 7) == 2)
    given = rows_of(marked)
    n, want, chance, vocabulary, after = expected_scores(given, [r["held_out"] for r in given])
    key = lambda d, out, figures: (str(d), out, figures[0], figures[1], round(figures[2], 6), round(figures[3], 6))
    found = rows_of(katz.score_texts(marked))
    assert Counter(key(r["doc_id"], r["held_out"], (r["n_tokens"], r["n_known"], r["base_score"], r["score"])) for r in found) == Counter(key(r["doc_id"], r["held_out"], f) for r, f in zip(given, want))
    assert {r["train_tokens"] for r in found} == {n}
    for h in [*list(after)[:5], "never seen"]:
        assert math.isclose(sum(chance(h, w) for w in vocabulary) + chance(h, "never seen"), 1, abs_tol=1e-9)
    assert katz.score_texts(nothing.selectExpr("*", "true AS held_out")).count() == 0


def test_katz_with_more_buckets_than_ten_bits_number(spark, small):
    marked = small.withColumn("held_out", toxicity.remainder("doc_id", 7) == 2)
    given = rows_of(marked)
    n, want, *_ = expected_scores(given, [r["held_out"] for r in given])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")  # 1,200 buckets
    try:
        found = rows_of(katz.score_texts(marked))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda d, figures: (d, figures[0], figures[1], round(figures[2], 6), round(figures[3], 6))
    assert Counter(key(r["doc_id"], (r["n_tokens"], r["n_known"], r["base_score"], r["score"])) for r in found) == Counter(key(r["doc_id"], f) for r, f in zip(given, want))
    assert {r["train_tokens"] for r in found} == {n}


def test_toxic_segments():
    """Against every segment: those found are disjoint, and the best of all is among them."""
    import random

    import numpy as np

    draw = random.Random(7)
    for _ in range(200):
        scores = [draw.choice((-0.5, -0.5, -0.5, 2.0, 1.0)) for _ in range(draw.randrange(1, 25))]
        places = np.array([i for i, s in enumerate(scores) if s > 0], np.int64)
        found = toxicity.segments(np.array([s for s in scores if s > 0]), places, -0.5)
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert not len(places) or math.isclose(max(s for *_, s in found), best)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_toxicity(spark, awkward, nothing):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(toxicity.remainder("doc_id", 5) != 0), toxicity.remainder("doc_id", 5) == 4)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where(toxicity.remainder("doc_id", 5) == 0).collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows_of(toxicity.score(docs, model)) if r["doc_id"] in truth]
    assert sum(t == p for t, p in held) / len(held) > 0.9 and sum(t < p for t, p in held) <= 0.02 * len(held)
    rows = rows_of(toxicity.score(awkward, model))
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_without_labels(spark, small):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(small, none, toxicity.remainder("doc_id", 5) == 4)
    assert len({r["score"] for r in rows_of(toxicity.score(small, model))}) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    """The registered functions on the smallest tables, as the driver calls them: every document, or conversation, or query, is there."""
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    columns = {
        1: "doc_id n_shingles component_id", 2: "doc_id size source_size target taken", 3: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 4: "doc_id held_out score predicted",
        5: "query_id rank vec_id score", 6: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", 7: "doc_id size text_crc32 law shard slot grown_shard", 8: "doc_id n_tokens ids_sha256 decoded_sha256",
        9: "doc_id held_out n_tokens n_known train_tokens base_score score", 10: "doc_id n_words n_removed kept_sha256",
        11: "vec_id component n deviation whitened explained identity_error", 12: "lang source part item value rank", 13: "doc_id n_words n_hit n_items items_sha256 contaminated",
    }
    number = int(re.match(r"op(\d+)_", name)[1])
    found = QUERIES[name](spark, SMALL)
    assert set(columns[number].split()) <= set(found.columns)
    rows = rows_of(found)
    if number not in (5, 6, 11, 12):
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    if number == 10:
        given = rows_of(spark.read.parquet(f"{SMALL}/documents.parquet"))
        assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in stripped(given)}
    if number == 3:
        assert {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows} == {(r["doc_id"], *base_of(r["text"])) for r in rows_of(spark.read.parquet(f"{SMALL}/documents.parquet"))}
