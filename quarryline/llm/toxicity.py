"""Operator 6: toxicity by weak supervision.

Terms are fixed lists of insults in four languages and word stems mined from a bounded sample of labelled rows (words
and prefixes that toxic rows hold far more often). Every document's terms and patterns, found in its
whole text, are one bit mask. Terms are dealt into lexicon voters, patterns are voters of their own:
VOTERS in all, so the votes of the whole corpus are at most 2 ** VOTERS counts. On those counts a
generative two-class model is fitted by expectation maximisation: each voter's rate of firing in
either class, that is its accuracy, with labelled training rows held at their class. Correlations
that remain between voters within a class weaken their weights, so voters that repeat one another
count once. A linear classifier over the single terms is trained on the posterior labels, over the
counts of all distinct masks, whose gradients executors sum, and scores all documents.

Bounds: at most SAMPLE labelled documents of each class for mining, by a hash of doc_id. Their whole
texts are read by executors, and near copies of a toxic one count as often as texts like it that are not toxic, at least once; the driver gets counts of significant features only.
The number of mined terms is not bounded otherwise: a mask has as many bits as there are terms. Votes
and the linear classifier cover all rows.

Defined results: null and empty texts fire no voter and get the score of that; repeated rows count
and are scored each; without labels the fixed terms alone decide; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from quarryline.llm.common import bare, cut, drop, slices, with_numbers
from quarryline.llm.quality import labelled_rows, remainder

SAMPLE = 3000
THRESHOLD = 0.7

#: Common insults of four languages, matched as whole words; each language is a voter.
LEXICONS = (
    ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "filthy", "vermin", "dumb", "ugly"),
    ("idiot", "idioten", "depp", "trottel", "dummkopf", "arschloch", "abschaum", "dreck", "widerlich", "erbärmlich", "wertlos", "verlierer", "versager", "schwachkopf", "missgeburt"),
    ("idiot", "idiote", "crétin", "imbécile", "abruti", "connard", "salaud", "ordure", "racaille", "minable", "débile", "dégoûtant", "pathétique", "stupide"),
    ("idiota", "imbécil", "estúpido", "estúpida", "tonto", "basura", "escoria", "inútil", "patético", "asqueroso", "payaso", "perdedor", "cabrón", "despreciable"),
)
INSULTS = tuple(dict.fromkeys(w for words in LEXICONS for w in words))
#: Patterns: shouting, strings of exclamation marks, a second person that is called something.
PATTERNS = (r"(?:\b[A-Z]{4,}\b\W+){4}", r"!{3,}", r"(?i)\byou(?:'re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown|scum|trash)")
FIXED_VOTERS, MINED_VOTERS = len(LEXICONS), 8
#: Letters of the stems that are tried.
STEM = range(4, 10)
#: Share of toxic rows among those that hold a mined term.
SURE = 0.9
#: Labelled rows that the label model's view of a vote pattern is worth.
PRIOR = 10
#: Hashes by which copies in the sample are known.
KINDS = 4
VOTERS = FIXED_VOTERS + MINED_VOTERS + len(PATTERNS)
_WORD = re.compile(r"\w+")


def features(text: str) -> set[str]:
    """A text's words, as '=word', and their first letters, as '^stem'."""
    return {f for w in set(_WORD.findall(text.lower())) for f in ("=" + w, *("^" + w[:k] for k in STEM if k < len(w)))}


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and how many other rows of a batch have each feature."""
    for b in batches:
        pos, neg = Counter(), Counter()
        for t, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
            (pos if y else neg).update(features(t))
        names = list(pos | neg)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[f] for f in names], pa.int64()), pa.array([neg[f] for f in names], pa.int64())], ["feature", "pos", "neg"])


def _kinds(texts: list[str]) -> list[list[int]]:
    """KINDS hashes of each text, the least of its runs of three words under as many seeds: near copies share most of them, other texts none."""
    out = []
    for t in texts:
        w = _WORD.findall(t.lower())
        runs = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        out.append([min(xxhash.xxh3_64_intdigest(r, seed) for r in runs) >> 1 for seed in range(KINDS)])
    return [[o[k] for o in out] for k in range(KINDS)]


def _one_of_a_kind(sample: DataFrame) -> DataFrame:
    """The sample (doc_id, text, y) without most near copies of toxic texts: one that was copied a thousand times says no more for its words than once. As many stay as have near copies that are not toxic, since what sets those apart is evidence, and at least one. Copies of other texts all count against their words."""
    kinds = [f"__kind{k}" for k in range(KINDS)]
    left = with_numbers(sample.withColumn("__whole", F.col("text")), ["doc_id", "y", "__whole"], [(k, LongType()) for k in kinds], lambda: _kinds)
    for k in kinds:
        others = F.count(F.when(F.col("y") == 0, 1)).over(Window.partitionBy(k))
        nth = F.row_number().over(Window.partitionBy("y", k).orderBy("doc_id"))
        left = left.withColumn("__nth", nth - F.greatest(others, F.lit(1))).filter("y = 0 or __nth <= 0").drop("__nth")
    return left.select("doc_id", F.col("__whole").alias("text"), "y")


def mine(rows: DataFrame, total: dict[int, int]) -> list[str]:
    """Word stems that mark toxic rows (doc_id, text, y): '=word' is the whole word, '^stem' a word's start.

    A feature counts if its association with the class is far beyond chance for the number of
    features tried (the log-likelihood ratio against the sample's share of the class); features come first that cover the
    most toxic rows not yet covered twice, then all others that no stem taken already implies.
    Executors read the whole texts.
    """
    sample = cut(_one_of_a_kind(rows.dropDuplicates(["doc_id", "y"])), "toxic-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return []
    counted = sample.select("text", "y").mapInArrow(_count_features, "feature string, pos long, neg long")
    counts = cut(counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos > 0"), "toxic-features")
    # Chance is what the sample's own classes would give a feature, however rare either is in the corpus.
    base, floor = n[1] / (n[0] + n[1]), math.log(counts.count() + 1) + 3
    pos, neg = F.col("pos"), F.col("neg")
    m = pos + neg
    ratio = pos * F.log(pos / m / base) + F.when(neg > 0, neg * F.log(neg / m / (1 - base))).otherwise(0.0)
    # A sampled row stands for total / n rows of its class.
    a, b = pos * (total[1] / n[1]), neg * (total[0] / n[0])
    share = counts.filter("pos >= 4").withColumn("p", (a + 0.5) / (a + b + 1))
    significant = share.filter((F.col("p") >= SURE) & (ratio >= floor))
    good = {r["feature"]: r["p"] for r in significant.collect()}

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(f for f in features(t) if f in good) for t in b["text"].to_pylist()], pa.list_(pa.string()))], ["held"])

    holders: dict[str, list[int]] = {f: [] for f in good}
    for i, r in enumerate(sample.filter("y = 1").select("text").mapInArrow(held_by, "held array<string>").collect()):  # at most SAMPLE rows
        for f in r["held"]:
            holders[f].append(i)
    cover, chosen = Counter(), []
    while good:
        best = max(good, key=lambda f: (sum(cover[i] < 2 for i in holders[f]) * good[f] ** 4, len(f), f))
        if sum(cover[i] < 2 for i in holders[best]) < 3:
            break
        chosen.append(best)
        cover.update(holders[best])
        del good[best]
    taken = set(chosen)
    for f in sorted(good, key=lambda f: (len(f), f)):  # '=idiots' and '^idiots' imply '^idio'
        if not any("^" + f[1:k] in taken for k in range(5, len(f) + 1)):
            taken.add(f)
            chosen.append(f)
    return chosen


class Marks:
    """Finds terms and patterns; a text's mask has a bit for each that occurs."""

    def __init__(self, terms: list[str], patterns: tuple[str, ...] = PATTERNS):
        self.find = ahocorasick.Automaton()
        ends: dict[str, list[tuple[int, bool]]] = {}
        for i, term in enumerate(terms):
            ends.setdefault(term[1:], []).append((1 << i, term[0] == "="))
        for word, what in ends.items():
            self.find.add_word(word, (len(word), what))
        if ends:
            self.find.make_automaton()
        self.any, self.patterns = bool(ends), [(1 << (len(terms) + i), re.compile(p)) for i, p in enumerate(patterns)]

    def mask(self, text: str) -> int:
        low, got = text.lower(), 0
        if self.any:
            for end, (length, what) in self.find.iter(low):
                before, after = low[end - length : end - length + 1] and low[end - length] if end >= length else "", low[end + 1 : end + 2]
                if not (before.isalnum() or before == "_"):
                    for bit, whole in what:
                        if not (whole and (after.isalnum() or after == "_")):
                            got |= bit
        for bit, p in self.patterns:
            if p.search(text):
                got |= bit
        return got


def voter_bits(terms: list[str], fixed: int) -> list[int]:
    """Each voter's bits of the mask: the fixed lexicons (a word of two languages votes in both), the mined terms in lexicons by their order, those with one beginning, which imply one another, together, then the patterns."""
    voters = [0] * VOTERS
    kin = {k: j for j, k in enumerate(dict.fromkeys(t[1 : 1 + STEM.start] for t in terms[fixed:]))}
    for i in range(len(terms)):
        for v in [v for v, words in enumerate(LEXICONS) if terms[i][1:] in words] if i < fixed else [FIXED_VOTERS + kin[terms[i][1 : 1 + STEM.start]] * MINED_VOTERS // len(kin)]:
            voters[v] |= 1 << i
    for j in range(len(PATTERNS)):
        voters[FIXED_VOTERS + MINED_VOTERS + j] = 1 << (len(terms) + j)
    return voters


class LabelModel:
    """Two classes; fitted on counts of vote patterns by expectation maximisation.

    A class decides whether any lexicon voter fires, and, if so, at which rate each does: a lexicon
    holds a few words of one language, so its silence beside another that fires says nothing.
    Pattern voters fire at a rate of each class.
    """

    def __init__(self, free: dict[int, int], known: dict[tuple[int, int], int], rounds: int = 60):
        votes = sorted(set(free) | {v for v, _ in known}) or [0]
        x = np.array([[(v >> i) & 1 for i in range(VOTERS)] for v in votes], float)
        at = {v: i for i, v in enumerate(votes)}
        n, held = np.zeros(len(votes)), np.zeros((len(votes), 2))
        for v, c in free.items():
            n[at[v]] += c
        for (v, y), c in known.items():
            held[at[v], y] += c
        lexicons = np.arange(VOTERS) < FIXED_VOTERS + MINED_VOTERS
        some = x[:, lexicons].any(1).astype(float)
        p = np.where(some > 0, 0.9, 0.02)  # the start: a lexicon that fires says toxic
        for _ in range(rounds):
            mass = np.column_stack([n * (1 - p), n * p]) + held
            share = (mass.sum(0) + (9, 1)) / (mass.sum() + 10)
            # Smoothing stands for the belief that a lexicon fires in most toxic rows and few others.
            speaks = [(mass[:, y] @ some + (0.1, 4.0)[y]) / (mass[:, y].sum() + (10.0, 5.0)[y]) for y in (0, 1)]
            within = [np.where(lexicons, mass[:, y] @ some, mass[:, y].sum()) for y in (0, 1)]
            rate = [(mass[:, y] @ x + (0.2, 1.0)[y]) / (within[y] + 4) for y in (0, 1)]
            new = self._with_labels(self._posterior(x, some, rate, speaks, share, np.ones(VOTERS)), held)
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        self.rate, self.speaks, self.share = rate, speaks, share
        self.correlation = np.maximum(*(self._residual(x, np.where(some > 0, mass[:, y], 0), rate[y]) for y in (0, 1)))
        self.weight = 1 / (1 + np.clip(self.correlation, 0, None).sum(1))
        self.posterior = dict(zip(votes, self._with_labels(self._posterior(x, some, rate, speaks, share, self.weight), held), strict=True))

    @staticmethod
    def _with_labels(p, held) -> np.ndarray:
        """What the model thinks of a vote pattern counts as PRIOR rows beside the labelled rows that cast it, so that rows without a label can't pull a class away from them."""
        return (held[:, 1] + PRIOR * p) / (held.sum(1) + PRIOR)

    @staticmethod
    def _posterior(x, some, rate, speaks, share, weight) -> np.ndarray:
        z = np.log(share[1] / share[0]) + x @ (weight * np.log(rate[1] / rate[0]))
        z = z + np.where(some > 0, np.log(speaks[1] / speaks[0]), np.log((1 - speaks[1]) / (1 - speaks[0])))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def _residual(x, mass, rate) -> np.ndarray:
        """Correlations of the voters within a class, of which chance and the diagonal count as none."""
        total = mass.sum() + 1e-9
        d = x - rate
        cov = (d * mass[:, None]).T @ d / total
        s = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        c = cov / np.outer(s, s)
        c[np.abs(c) < 3 / math.sqrt(total + 1)] = 0
        np.fill_diagonal(c, 0)
        return c


def _vote(mask: int, voters: list[int]) -> int:
    return sum(1 << i for i, bits in enumerate(voters) if mask & bits)


def _gradient(batches: Iterator[pa.RecordBatch], width: int, posterior: dict[int, float], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sums of Newton's method at w over rows (mask, vote, count): the loss, the gradient, then the curvature."""
    loss, g, h = 0.0, np.zeros(width + 1), np.zeros((width + 1, width + 1))
    for b in batches:
        masks = np.frombuffer(b"".join(b["mask"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
        for at in range(0, b.num_rows, 2048):
            x = np.unpackbits(masks[at : at + 2048], axis=1, bitorder="little", count=width).astype(float)
            x = np.column_stack([x, np.ones(len(x))])
            n = b["count"].to_numpy()[at : at + 2048].astype(float)
            p = np.array([posterior[v] for v in b["vote"].to_pylist()[at : at + 2048]])
            z = x @ w
            q = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            loss += n @ (np.logaddexp(0, z) - p * z)
            g += x.T @ (n * (p - q))
            h += (x * (n * q * (1 - q))[:, None]).T @ x
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[loss], g, h.ravel()]).tobytes()], pa.binary())], ["sums"])


def fit(counts: DataFrame, width: int, posterior: dict[int, float], ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Coefficients of all masks' bits, the intercept last, by Newton's method; executors sum the gradients of the distinct masks. A step that makes the loss larger is halved, so the fit can't run away where a term settles the label."""
    penalty = ridge * np.eye(width + 1)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = counts.mapInArrow(lambda batches: _gradient(batches, width, posterior, w), "sums binary").collect()
        total = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(1 + (width + 1) * (width + 2)))
        return total[0] + w @ penalty @ w / 2, total[1 : width + 2] - penalty @ w, total[width + 2 :].reshape(width + 1, width + 1) + penalty

    w = np.zeros(width + 1)
    loss, gradient, curvature = sums(w)
    for _ in range(rounds):
        step = np.linalg.solve(curvature, gradient)
        for _ in range(30):
            now = sums(w + step)
            if now[0] <= loss + 1e-9 * abs(loss):
                break
            step = step / 2
        w, better = w + step, loss - now[0]
        loss, gradient, curvature = now
        if np.abs(step).max() < 1e-6 or better < 1e-9 * abs(loss):
            break
    return np.round(w, 6)  # sums come in any order


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], mod: int = 3, held: int = 1) -> DataFrame:
    """docs' columns `keep` with the probability __score of label 1; labels whose remainder is `held` are never learnt from."""
    sample, total = labelled_rows(docs, labels, "toxic", mod, held, SAMPLE)
    fixed = [f"={w}" for w in INSULTS]
    terms = fixed + [t for t in mine(sample, total) if t not in fixed]
    voters = voter_bits(terms, len(fixed))

    width = len(terms) + len(PATTERNS)
    size = (width + 7) // 8

    def finder():
        marks = Marks(terms)

        def function(texts: list[str]) -> list:
            found = [marks.mask(t) for t in texts]
            return [[m.to_bytes(size, "little") for m in found], np.array([_vote(m, voters) for m in found], np.int64)]

        return function

    # The masks stand beside the columns asked for, so texts are searched once.
    masks = cut(with_numbers(docs, [*dict.fromkeys(["doc_id", *keep])], [("__mask", BinaryType()), ("__vote", LongType())], finder), "toxic-masks")
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(mod) != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    votes = masks.select("doc_id", F.col("__vote").alias("vote")).join(known, "doc_id", "left").groupBy("vote", "y").count().collect()  # at most 3 * 2 ** VOTERS rows
    model = LabelModel({r["vote"]: r["count"] for r in votes if r["y"] is None}, {(r["vote"], r["y"]): r["count"] for r in votes if r["y"] is not None})

    counts = cut(masks.groupBy(F.col("__mask").alias("mask"), F.col("__vote").alias("vote")).count(), "toxic-counts")
    w = fit(counts, width, model.posterior)
    drop(counts)
    schema = StructType([*(docs.schema[k] for k in keep), StructField("__score", DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little", count=width)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(1 / (1 + np.exp(-(bits @ w[:-1] + w[-1]))))], schema.names)

    return masks.select("__mask", *keep).mapInArrow(judge, schema)


def score(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """Every document's probability of toxic label 1."""
    got = scored(docs, labels, ["doc_id"], mod, held)
    return got.select("doc_id", F.coalesce(remainder(mod) == held, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    inner, restored = bare(docs, "doc_id", "text")
    return restored(scored(inner, labels, inner.columns).filter(F.col("__score") < THRESHOLD))
