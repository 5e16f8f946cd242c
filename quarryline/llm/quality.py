"""Operator 5: a quality classifier by compression with two zstandard dictionaries.

One dictionary is trained on labelled good text, one on bad. A text is cut into blocks, each block
compressed with either, and the difference of the summed sizes, divided by the text's bytes, is the
score before calibration: blocks, because a compressor that has seen a kilobyte of the text itself
no longer needs a dictionary. A logistic curve, fitted on labelled text that neither dictionary saw,
turns it into a probability of label 1.

Both fits use a bounded sample of labelled rows: at most SAMPLE documents of each class, the first by
a hash of doc_id, with their whole texts. Scores read whole texts.

Defined results: null and empty texts have difference 0 and the score of that; without labels of
both classes every score is the share of label 1 (0.5 without any); repeated rows are scored each;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarryline.llm.common import bare, clean_text, with_numbers

SAMPLE = 3000
DICTIONARY, BLOCK, LEVEL = 65_536, 1024, 3
#: A score of at least this is label 1.
THRESHOLD = 0.7


def remainder(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal doc_id, modulo mod."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, whole text, label y) of a bounded sample of labelled rows outside the held-out fold, and each class's rows there."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(mod) != held)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ids = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 * sample rows
    return docs.select("doc_id", clean_text().alias("text")).join(chosen, "doc_id").select("doc_id", "text", "y"), total


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, sample: int = SAMPLE) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(whole text, label) of labelled_rows()."""
    got, total = labelled_rows(docs, labels, label, mod, held, sample)
    got = got.dropDuplicates(["doc_id", "y"])
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in got.collect())
    return [(t, y) for _, t, y in rows], total


def blocks(raw: bytes, size: int = BLOCK) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Sizes:
    """The difference of a text's compressed sizes: with the bad dictionary less with the good one, by byte."""

    def __init__(self, good: bytes, bad: bytes):
        made = [zstandard.ZstdCompressionDict(d) for d in (bad, good)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        self.bad, self.good = (zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in made)

    def difference(self, text: str) -> float:
        raw = text.encode()
        if not raw:
            return 0.0
        cut, bad, good = blocks(raw), self.bad.compress, self.good.compress
        return (sum(len(bad(b)) for b in cut) - sum(len(good(b)) for b in cut)) / len(raw)


def train_dictionary(texts: list[str]) -> bytes:
    parts = [b for t in texts for b in blocks(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[str, int]], total: dict[int, int]) -> tuple[bytes, bytes, float, float]:
    """The good and the bad dictionary, and the slope and intercept of the calibration."""
    share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    by = {y: [t for t, z in sample if z == y and t] for y in (0, 1)}
    if min(map(len, by.values())) < 4:
        return b"", b"", 0.0, float(np.log(share / (1 - share)))
    good, bad = (train_dictionary(by[y][::2]) for y in (1, 0))
    sizes = Sizes(good, bad)
    rest = [(sizes.difference(t), y, total[y] / len(by[y][1::2])) for y in (0, 1) for t in by[y][1::2]]
    d, y, weight = (np.array(c, float) for c in zip(*rest, strict=True))
    spread = d.std() or 1.0
    slope, intercept = logistic(d[:, None] / spread, y, weight / weight.mean())
    return good, bad, float(slope / spread), float(intercept)


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], mod: int = 4, held: int = 2) -> DataFrame:
    """docs' columns `keep`, with __difference and the probability __score of quality label 1; labels whose remainder is `held` are never learnt from."""
    good, bad, slope, intercept = fit(*labelled_sample(docs, labels, "quality", mod, held))

    def worker():
        sizes = Sizes(good, bad) if slope else None

        def function(texts: list[str]) -> list[np.ndarray]:
            d = np.array([sizes.difference(t) if sizes else 0.0 for t in texts], float)
            return [d, 1 / (1 + np.exp(-np.clip(slope * d + intercept, -700, 700)))]

        return function

    return with_numbers(docs, keep, [("__difference", DoubleType()), ("__score", DoubleType())], worker)


def score(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """Every document's probability of quality label 1."""
    got = scored(docs, labels, ["doc_id"], mod, held)
    return got.select("doc_id", F.coalesce(remainder(mod) == held, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__difference").alias("difference"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    inner, restored = bare(docs, "doc_id", "text")
    return restored(scored(inner, labels, inner.columns).filter(F.col("__score") >= THRESHOLD))
