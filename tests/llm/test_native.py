"""Fingerprints and line dedup: DataFrame functions alone, held against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.llm import fingerprint as fp
from quarryline.llm import linededup as ld
from quarryline.llm.common import range_bucket, table


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_follow_jaccard(spark, sf):
    docs = sorted(((r.doc_id, r.text) for r in table(spark, sf, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in fp.fingerprint(table(spark, sf, "documents")).collect()}
    assert len(got) == len(docs)
    errors = []
    for i, (d, t) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(shingles(t), shingles(edited)), r.near_next - jaccard(shingles(t), shingles(after))]
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.2


def test_fingerprint_odd_rows(odd_docs, no_docs, make_docs, odd_texts):
    rows = fp.fingerprint(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint == "" and by[0].near_edited == 1.0
    assert by[5].fingerprint == by[6].fingerprint and by[6].near_next == 1.0
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert fp.fingerprint(no_docs).count() == 0
    alone = fp.fingerprint(make_docs(["only one here is the text"])).first()
    assert alone.near_next == 1.0


def test_native_plan(odd_docs):
    plans = [df._jdf.queryExecution().toString() for df in (fp.fingerprint(odd_docs), ld.removed_lines(odd_docs))]
    assert not any(re.search("Python|Pandas|Arrow", p) for p in plans)


def test_range_bucket_is_ordered_and_even(spark):
    df = spark.range(1000).select((F.col("id") * F.when(F.col("id") > 900, 10**12).otherwise(1)).alias("k"))
    rows = df.select("k", range_bucket(df, "k", 64).alias("b")).orderBy("k").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and max(Counter(r.b for r in rows).values()) < 60


def brute_lines(docs):
    """(doc, line) of the lines that match an earlier one."""
    seen, gone = [], set()
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            s = frozenset(w for w in re.split("[ \t\r\f]", line) if w)
            if s and any(len(s & o) * 18 >= 8 * (len(s) + len(o)) for o in seen):
                gone.add((d, i))
            if s:
                seen.append(s)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_by_brute_force(make_docs, seed):
    rng, words = random.Random(seed), [f"w{i}" for i in range(60)]
    lines = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 20, 40]))] for _ in range(60)]
    texts = []
    for _ in range(80):
        part = []
        for _ in range(4):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(words)
            part.append(" ".join(line))
        texts.append("\n".join(part))
    got = {(r.doc_id, i) for r in ld.removed_lines(make_docs(texts)).collect() for i in r.removed_lines}
    assert got == brute_lines(list(enumerate(texts)))


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_lines_left_are_written_only_if_many_are_gone(make_docs, monkeypatch, sent):
    tags, cut = [], ld.cut
    monkeypatch.setattr(ld, "cut", lambda df, tag: tags.append(tag) or cut(df, tag))
    monkeypatch.setattr(ld, "BROADCAST_ROWS", sent)
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base), "  ".join(base[1:]) + " \t", "\t".join(base[2:] + ["x"]) + "\n\n \t", "a  b", "a b\n" + " ".join(base[5:])]
    got = {(r.doc_id, i) for r in ld.removed_lines(make_docs(texts)).collect() for i in r.removed_lines}
    assert got == brute_lines(list(enumerate(texts))) and ("line-left" in tags) == (not sent)


def test_words_are_hashed_once(make_docs):
    plan = make_docs(["a  b"]).select(ld._codes(F.col("text"), F.array(F.lit(0).cast("long"))).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<!\w)(?:xx)?hash(?:64)?\(lambda", plan)) == 1 and "array_remove(split" not in plan


def test_codes_are_made_apart_from_interpreted_functions(make_docs):
    """What drops and sorts a line's codes is above all functions of elements, so it is compiled; no line is searched from its end or by a pattern to see whether it has words."""
    zero = F.array(F.lit(0).cast("long"))
    lines = ld._lines(make_docs(["a  b"]).withColumn("__n", F.col("doc_id")), 4)
    plan = lines.select("ord", ld._codes(F.col("line"), zero).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(array_remove(transform(transform(" in plan
    assert "trim(both" not in plan.lower() and "btrim" not in plan and "RLIKE" not in plan


def test_first_round_sorts_by_the_key_alone(make_docs):
    docs = make_docs(["a b c d e f g h i j k l", "a b c d e f g h i j k m"])
    zero = F.array(F.lit(0).cast("long"))
    sets = ld._token_sets(docs.select(F.col("doc_id").alias("ord"), F.col("text").alias("line")), zero)
    plan = ld._led(sets)._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"windowspecdefinition\(key#\d+L?, specifiedwindowframe", plan), plan
    assert [(r.a, r.b) for r in ld._led(sets).collect()] in ([(1, 0)], [])


def test_lines_odd_rows(odd_docs, no_docs, odd_texts):
    rows = ld.removed_lines(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2 and all(r.n_removed == len(r.removed_lines) <= r.n_lines for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 8)}
    assert by[6].removed_lines == [0] and by[5].removed_lines == [] and by[0].n_lines == 1
    assert sorted(r.n_removed for r in rows if r.doc_id == 8) == [3, 4]  # of a repeated row's lines those of one stay, but those like doc 5's
    kept = ld.dedup_lines(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(rows)
    out = {r.doc_id: r for r in kept.collect() if r.doc_id != 8}
    assert out[0].text is None and out[6].text == "" and out[5].n_chars == len(odd_texts[5]) and out[5].score == "x"
    assert ld.removed_lines(no_docs).count() == 0 and ld.dedup_lines(no_docs).count() == 0
