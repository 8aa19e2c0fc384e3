"""The jump hash against the published loop in plain integers, and the shards of rows by it."""

import numpy as np

from tidemark.llm import sharding
from tidemark.llm.common import mix64

WORD = (1 << 64) - 1


def published(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & WORD
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_loop():
    r = np.random.default_rng(5)
    keys = np.concatenate([r.integers(0, 1 << 64, 3000, dtype=np.uint64), np.array([0, 1, WORD, 1 << 63], np.uint64)])
    for shards in (1, 2, 3, 7, 24, 25, 1000, 1 << 20):
        assert sharding.jump_hash(keys, shards).tolist() == [published(int(k), shards) for k in keys]


def test_one_more_shard_takes_keys_only_into_itself():
    keys = np.random.default_rng(6).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    for shards in (1, 5, 24):
        a, b = sharding.jump_hash(keys, shards), sharding.jump_hash(keys, shards + 1)
        assert set(b[a != b].tolist()) == {shards}
        assert abs((a != b).mean() - 1 / (shards + 1)) < 0.02


def test_rows_go_where_the_loop_sends_their_mixed_id(spark):
    ids = [*range(-50, 450), (1 << 63) - 1, -(1 << 63)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign_shards(docs, 24).collect()}
    mixed = mix64(np.array(ids, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    assert got == {i: (published(int(k), 24), published(int(k), 25)) for i, k in zip(ids, mixed)}
