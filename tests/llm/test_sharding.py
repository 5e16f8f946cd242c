"""Shards: the smallest capacity, whole groups, gapless slots."""

import random
import zlib

import pytest

from quarryline.llm import sharding
from quarryline.llm.sharding import Bucket, minimax


def smallest(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("seed", range(6))
def test_minimax_is_exact(seed):
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(10_000), rng.choice([3, 30, 300])))
    sizes = dict(zip(keys, (rng.randint(1, 60) for _ in keys), strict=True))
    group = lambda ks: [Bucket(0, k[0], k[-1], sum(sizes[x] for x in k), len(k)) for k in ks if k]

    def split(wanted):
        out = []
        for b in wanted:
            mine = [k for k in keys if b.low <= k <= b.high]
            out += group([mine[: len(mine) // 2], mine[len(mine) // 2 :]])
        return out

    shards = rng.choice([2, 5, 24])
    capacity, ends = minimax(group([keys[i : i + 16] for i in range(0, len(keys), 16)]), shards, split)
    assert capacity == smallest([sizes[k] for k in keys], shards)
    filled = [0] * shards
    for k in keys:
        filled[sum(k > e for e in ends)] += sizes[k]
    assert max(filled) <= capacity


def test_shards(make_docs, no_docs, odd_docs, odd_texts):
    rng = random.Random(2)
    texts = ["copy of one text " * 5] * 200 + [" ".join("w%d" % rng.randrange(99) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    rows = sharding.shard(make_docs(texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    of, filled = {}, [0] * 24
    for r in rows:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        assert of.setdefault(t, r.shard) == r.shard
        filled[r.shard] += r.size
    hot = of[texts[0]]
    light = [f for i, f in enumerate(filled) if i != hot]
    assert max(light) - min(light) < 2 * max(len(t) + 8 for t in texts[200:])
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(no_docs).count() == 0
    odd = sharding.shard(odd_docs).collect()
    assert len(odd) == len(odd_texts) + 2 and {r.size for r in odd if r.doc_id in (0, 1)} == {8}
