"""Names to entities: the rare-letter index against all pairs, the rounds, and the review queue."""

import itertools
import random

from pyspark.sql import functions as F

from tidemark.operators import entities
from tidemark.plans.records import jn_alias_fuzzy, part_aliases, part_queries, pipe_entity_resolution
from tidemark.plans.views import Tables
from tidemark.sources import reviews

SMALL = "/root/testdata/sf0.001"


def company_names(draw, n):
    """Invented names of two or three words, of letters as unevenly spread as in prose."""
    letters, weights = "ETAOINSRHLDCUMFPGWYBVKXJQZ", [12, 9, 8, 7, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 2, 1, 1, 0.8, 0.2, 0.2, 0.1, 0.1]
    return ["".join("".join(draw.choices(letters, weights, k=draw.randrange(3, 9))) for _ in range(draw.randrange(2, 4))) for _ in range(n)]


def test_few_pairs_are_compared_and_none_is_lost(spark):
    draw = random.Random(8)
    aliases = sorted(set(company_names(draw, 700)))
    asked = [a[: len(a) // 2] + draw.choice("AEIOU") + a[len(a) // 2 + 1 :] for a in aliases[::7]] + company_names(draw, 100)
    left, right = spark.createDataFrame([(n,) for n in asked], "norm string"), spark.createDataFrame([(a, i) for i, a in enumerate(aliases)], "key string, entity_id int")
    for least, share in ((0.92, 0.002), (0.76, 0.05)):
        met = [(r["norm"], r["key"]) for r in entities.meetings(left, right, least).collect()]
        assert len(met) == len(set(met)) and len(met) < share * len(asked) * len(aliases)
        want = {(n, a) for n in asked for a in aliases if entities.ratio(n, a) >= least}
        assert want and want <= set(met)
        got = {(r["norm"], r["key"]) for r in entities.candidates(left, right, least).collect()}
        assert got == want


def test_rounds_find_the_best_of_each_name(spark):
    draw = random.Random(3)
    stems = ["ACME", "ACMEX", "BOLTON", "RING"]
    aliases = sorted({a + "".join(draw.choices("ABC", k=draw.randrange(4))) for a in stems for _ in range(30)})
    asked = sorted({a + "".join(draw.choices("ABCD", k=draw.randrange(5))) for a in stems for _ in range(20)} | {"ZZZZ", "A"})
    left, right = spark.createDataFrame([(n,) for n in asked], "norm string"), spark.createDataFrame([(a, i) for i, a in enumerate(aliases)], "key string, entity_id int")
    got = {r["norm"]: r for r in entities.fuzzy(left, right).collect()}
    for n in asked:
        ranked = sorted(((-entities.ratio(n, a), a) for a in aliases if entities.ratio(n, a) >= 0.6))[:5]
        assert [c["key"] for c in got[n]["candidates"]] == [a for _, a in ranked] if ranked else n not in got
        if ranked:
            sure = -ranked[0][0] >= 0.92 and (len(ranked) < 2 or ranked[1][0] - ranked[0][0] >= 0.02)
            assert (got[n]["entity_id"] is not None, got[n]["review"], got[n]["n_candidates"]) == (sure, not sure, len(ranked))


def test_the_queries_equal_all_pairs_on_part_names(spark):
    t = Tables(spark, SMALL)
    aliases = {r["key"]: r["entity_id"] for r in part_aliases(t).collect()}
    names = {r[0] for r in part_queries(t).select(entities.normalized(F.col("query"))).collect()}
    got = {r["norm"]: (r["entity_id"], r["score"], r["n_candidates"], r["review"]) for r in jn_alias_fuzzy(t).collect()}
    want = {}
    for n in names:
        ranked = sorted((-entities.ratio(n, a), a) for a in aliases if entities.ratio(n, a) >= 0.6)[:5]
        if ranked:
            sure = -ranked[0][0] >= 0.92 and (len(ranked) < 2 or ranked[1][0] - ranked[0][0] >= 0.02)
            want[n] = (aliases[ranked[0][1]] if sure else None, round(-ranked[0][0], 6), len(ranked), not sure)
    assert got == want
    found = pipe_entity_resolution(t).collect()
    assert {r["n_items"] for r in found if r["review"]} == {1} and {r["n_items"] for r in found if not r["review"]} == {0}
    assert {r["method"] for r in found} >= {"EXACT_CODE", "EXACT_ALIAS", "UNRESOLVED"}


def test_the_queue_takes_each_item_once_and_learns_what_was_decided(spark, tmp_path):
    path = str(tmp_path / "reviews")
    codes = spark.createDataFrame([("2330", "TW:2330")], "code string, entity_id string")
    aliases = entities.alias_table(spark.createDataFrame([("wide gizmo model x", "f", 7), ("wide gizmo model y", "g", 8)], "alias string, entity_id string, seq long"))
    asked = spark.createDataFrame([("wide gizmo model z",), ("wide gizmo modl",), ("wide gizmo modl",), ("2330",), (None,)], "query string")
    assert reviews.waiting(spark, path).count() == 0
    for at, context in itertools.product(("2024-01-01", "2024-01-02"), ("news", "filing")):
        reviews.queue(entities.resolve(asked, codes, aliases), path, context, at)
    items = reviews.items(spark, path).collect()
    assert len(items) == 4 and len({r["item_id"] for r in items}) == 4 and {r["queued_at"].day for r in items} == {1}
    assert [c["entity_id"] for c in next(r for r in items if r["query"] == "wide gizmo model z")["candidates"]] == ["f", "g"]
    one = next(r for r in items if r["query"] == "wide gizmo model z" and r["context"] == "news")
    other = next(r for r in items if r["query"] == "wide gizmo modl" and r["context"] == "news")
    reviews.decide(spark.createDataFrame([(one["item_id"], "f", "2024-02-01"), (one["item_id"], "g", "2024-02-02"), (other["item_id"], None, "2024-02-02")], "item_id string, entity_id string, decided_at string"), path)
    assert {r["context"] for r in reviews.waiting(spark, path).collect()} == {"filing"}
    learnt = reviews.learnt(spark, path).collect()
    assert [(r["alias"], r["entity_id"]) for r in learnt] == [("wide gizmo model z", "g")]
    known = entities.alias_table(spark.createDataFrame([("wide gizmo model x", "f", 7)], "alias string, entity_id string, seq long").unionByName(reviews.learnt(spark, path)))
    got = {r["query"]: (r["entity_id"], r["method"]) for r in entities.resolve(asked, codes, known).collect()}
    assert got["wide gizmo model z"] == ("g", "EXACT_ALIAS")
    reviews.queue(entities.resolve(asked, codes, aliases), path, "news", "2024-03-01")
    assert reviews.items(spark, path).count() == 4
