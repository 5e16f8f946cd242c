"""Quality and toxicity: held-out accuracy and defined results."""

import zlib

import pytest

from quarryline.llm import quality, toxicity
from quarryline.llm.common import table


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def hundredth():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("score, label, mod, held, least", [(quality.score, "quality", 4, 2, 0.85), (toxicity.score, "toxic", 3, 1, 0.75)])
def test_held_out(spark, hundredth, score, label, mod, held, least):
    docs, labels = table(spark, hundredth, "documents"), table(spark, hundredth, "labels")
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    known = {r.doc_id: r[label] for r in labels.collect()}
    assert auc([(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]) >= least


@pytest.mark.parametrize("score", [quality.score, toxicity.score])
def test_labels_of_the_fold_are_not_read(spark, sf, score):
    from pyspark.sql import functions as F

    mod, held = (4, 2) if score is quality.score else (3, 1)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumns({c: F.when(quality.remainder(mod) == held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert sorted(map(tuple, score(docs, labels).collect())) == sorted(map(tuple, score(docs, turned).collect()))


@pytest.mark.parametrize("score, keep", [(quality.score, quality.keep_good), (toxicity.score, toxicity.keep_civil)])
def test_odd_rows(odd_docs, no_docs, labels, odd_texts, score, keep):
    none = labels([])
    some = labels([(i, i % 2, (i // 2) % 2, "x") for i in range(len(odd_texts))] + [(3, None, None, None), (None, 1, 1, None), (3, 1, 0, "y")])
    for given in (none, some):
        rows = score(odd_docs, given).collect()
        assert len(rows) == len(odd_texts) + 2
        by = {r.doc_id: r.score for r in rows}
        assert by[0] == by[1] and by[5] == by[6]
        kept = keep(odd_docs, given)
        assert kept.columns == odd_docs.columns and kept.count() <= len(rows)
        assert score(no_docs, given).count() == 0
    if score is toxicity.score:
        assert keep(odd_docs, none).count() == len(odd_texts) + 2


def test_insults_are_caught_in_any_place(make_docs, labels):
    filler = "some plain words about the weather and the road "
    texts = [filler * 500 + "you are a pathetic idiot", filler * 500, "trash", "trashy is another word", "stupid moron, scum!"] + [filler + str(i) for i in range(60)]
    rows = {r.doc_id: r.predicted for r in toxicity.score(make_docs(texts), labels([(i, 1, 1 if i in (2, 4) else 0, "") for i in range(1, 60)])).collect()}
    assert [rows[i] for i in range(5)] == [1, 0, 1, 0, 1]


def test_insults_are_mined_from_whole_texts(make_docs, labels):
    """A word of the end of long texts is learnt, and found in others."""
    filler = "some plain words about the weather and the road " * 400
    texts = [filler + (f"zorbel {i}" if i % 3 == 0 else f"{i}") for i in range(120)] + ["a zorbel here", "plain words here"]
    rows = {r.doc_id: r.predicted for r in toxicity.score(make_docs(texts), labels([(i, 1, int(i % 3 == 0), "") for i in range(120)])).collect()}
    assert (rows[120], rows[121]) == (1, 0)


def test_all_significant_words_are_voters(make_docs, labels):
    """Sixty words of abuse are all mined; texts with any one of them are caught."""
    words = [f"{a}{b}zorb" for a in "bcdfghjklm" for b in "aeiouy"]
    n = 60 * 96
    texts = [f"plain words {i % 7} {words[i // 96] if i % 4 == 0 else ''}" for i in range(n)] + [f"some {w}" for w in words] + ["some words"]
    rows = {r.doc_id: r.predicted for r in toxicity.score(make_docs(texts), labels([(i, 1, int(i % 4 == 0), "") for i in range(n)])).collect()}
    assert [rows[n + i] for i in range(61)] == [1] * 60 + [0]
