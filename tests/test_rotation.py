"""Least recently used choice with budgets and rests: by hand, as a table, as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.streaming.rotation import Pool, choose, choose_stream

S = 1_000_000


def test_least_recently_used_first():
    p = Pool(["a", "b", "c"], uses=2, seconds=60)
    assert [p.take(i * S) for i in range(6)] == ["a", "b", "c", "a", "b", "c"]
    # All are over their budgets: the one whose oldest use leaves the window first.
    assert p.take(6 * S) == "a" and p.take(60 * S) == "b"


def test_a_use_just_a_window_old_counts_no_more():
    p = Pool(["a"], uses=1, seconds=60)
    assert p.take(0) == "a" and p.take(60 * S) == "a" and len(p.recent["a"]) == 1


def test_banned_resources_rest():
    p = Pool(["a", "b"], cooldown=10)
    assert p.take(0, "a") is None and p.take(1 * S) == "b" and p.take(9 * S) == "b" and p.take(10 * S) == "a"
    p.take(11 * S, "a"), p.take(11 * S, "b")
    assert p.take(12 * S) is None


def test_holding():
    p = Pool(["a", "b"], uses=9, hold=3)
    assert [p.take(i * S) for i in range(7)] == ["a", "a", "a", "b", "b", "b", "a"]
    p.take(7 * S, "a")
    assert p.take(8 * S) == "b"


def test_state_is_kept_whole():
    r, names = random.Random(1), ["a", "b", "c"]
    steps = [(i * 7 * S, r.choice([None, None, None, "b"])) for i in range(200)]
    whole, parts = Pool(names, uses=2, hold=2), Pool(names, uses=2, hold=2)
    for t, banned in steps:
        parts = Pool(names, uses=2, hold=2, state=parts.state())
        assert whole.take(t, banned) == parts.take(t, banned)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    found = [(r.choice("xyz"), r.randrange(4000), i, r.choice([None] * 5 + ["b"])) for i in range(400)]
    return [*found, (None, 1, 1, None), ("x", None, 2, None), found[0]]


def events(spark, rows):
    return spark.createDataFrame(rows, "key string, s int, pos int, resource string").select("key", F.timestamp_seconds("s").alias("at"), "pos", "resource")


def by_hand(rows, **options):
    out = []
    for k in "xyz":
        p = Pool(["a", "b", "c"], **options)
        out += [(k, s * S, n, p.take(s * S, b)) for _, s, n, b in sorted((x for x in rows if x[0] == k and x[1] is not None), key=lambda x: (x[1], x[2], x[3] or ""))]
    return sorted(out, key=str)


def test_a_table_equals_turns_by_hand(spark, rows):
    assert sorted(map(tuple, choose(events(spark, rows), ["a", "b", "c"], uses=2, cooldown=120).collect()), key=str) == by_hand(rows, uses=2, cooldown=120)
    assert choose(events(spark, rows).limit(0), ["a"]).count() == 0
    assert {r.chosen for r in choose(events(spark, rows), []).collect()} == {None}


def test_a_stream_equals_the_table(spark, rows, tmp_path):
    """Rows come shuffled within what the watermark allows, in several batches; the last ones wait."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = str(tmp_path / "in")
    ordered = sorted((r for r in rows if r[0] and r[1] is not None), key=lambda r: r[1] + random.Random(str(r)).randrange(200))
    flush = [("w", 9000, 0, None)]
    for i, part in enumerate([ordered[:150], ordered[150:300], ordered[300:], flush, [("w", 9001, 0, None)]]):
        events(spark, part).coalesce(1).write.mode("append").parquet(path)
        if i == 0:
            stream = spark.readStream.schema("key string, at timestamp, pos int, resource string").parquet(path)
            q = choose_stream(stream, ["a", "b", "c"], "10 minutes", uses=2, cooldown=120).writeStream.format("memory").queryName("chosen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    assert sorted((tuple(r) for r in spark.table("chosen").collect() if r.key != "w"), key=str) == by_hand(rows, uses=2, cooldown=120)
