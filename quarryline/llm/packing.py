"""Operator 10: pattern packing by non-negative least squares.

Texts become ids, a closing id 0, and pieces of at most one sequence. The histogram of piece lengths
(as many bins as a sequence has tokens, so bounded) is all that the driver sees. Patterns of a few
lengths that fill a sequence are enumerated from it, their repeat counts fitted by non-negative
least squares, rounded down, and what remains is packed by best fit, still on the histogram. The
plan is a list of runs: pieces of one length with ranks a to b go to sequences s, s+1, ... at one
offset. Each piece finds its run by its length and its rank among pieces of that length; ranks are
counted per length and salt, so a length that holds a third of all rows is dealt over many tasks.

Defined results: null text is the empty text, so one piece with id 0 alone; an empty table gives no
rows; repeated rows are packed each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm.common import clean_text, cut, slices

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 2048
#: Salts of a length's ranks; the counts by length and salt, at most SEQUENCE * SALTS, go to the driver.
SALTS = 32
#: Words of a generation that a worker remembers, most documents of a pattern, partners tried for each length.
REMEMBER, MOST, PARTNERS = 200_000, 4, 12

#: Texts of these characters alone have one lower case and are their own composed form, so the tokenizer's steps can be taken apart.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's pattern, in the lower case of those characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-z0-9à-öø-ÿß]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Words:
    """Ids of whole texts. Plain texts are cut into the tokenizer's own pieces here, each distinct piece's ids found by its model and remembered; other texts go through the tokenizer whole.

    Pieces are remembered in two generations: when the young one is full it becomes the old one, from
    which pieces still in use move back.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = _PIECE.findall(text.lower())
        if len(self.known) > REMEMBER:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        for piece in set(pieces).difference(known):
            known[piece] = self._ids(piece) if (had := old.get(piece)) is None else had
        return b"".join(map(known.__getitem__, pieces))

    def forget(self) -> None:
        """A worker that waits for other stages' tasks holds no pieces."""
        self.known, self.old = {}, {}

    def _ids(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """The documents' pieces: where each starts, how long it is and the CRC of its ids."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(path)
        try:
            for b in slices(batches):
                rows = []
                for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    ids = own.encode(text) + bytes(4)
                    for n, at in enumerate(range(0, len(ids), 4 * sequence)):
                        part = ids[at : at + 4 * sequence]
                        rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA)
        finally:
            own.forget()

    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(here, _PIECES)


def patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, ...]]:
    """Patterns of 1 to MOST lengths that occur, longest first, filling a sequence as well as what occurs allows."""
    have = sorted(histogram)
    found: set[tuple[int, ...]] = set()

    def largest(room: int) -> int | None:
        i = bisect_left(have, room + 1)
        return have[i - 1] if i else None

    def spread(room: int) -> list[int]:
        fit = have[: bisect_left(have, room + 1)]
        return [fit[i * (len(fit) - 1) // (PARTNERS - 1)] for i in range(PARTNERS)] if fit else []

    for a in have:
        for q in range(1, min(MOST, sequence // a) + 1):
            room, own = sequence - q * a, (a,) * q
            if q == MOST or (b := largest(room)) is None:
                found.add(own)
                continue
            found.add(tuple(sorted((*own, b), reverse=True)))
            if q + 2 <= MOST:
                for b in spread(room):
                    c = largest(room - b)
                    found.add(tuple(sorted((*own, b, *([c] if c else [])), reverse=True)))
    return sorted(found, key=lambda p: (-sum(p), p))


def fit(histogram: dict[int, int], found: list[tuple[int, ...]], sequence: int = SEQUENCE, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|, by accelerated projected gradients; A's columns are the patterns."""
    at = np.array([[*p, *[0] * (MOST - len(p))] for p in found], dtype=np.int64)
    used = (at > 0).astype(float)
    h = np.zeros(sequence + 1)
    for length, n in histogram.items():
        h[length] = n
    forward = lambda x: np.bincount(at.ravel(), (used * x[:, None]).ravel(), sequence + 1)
    back = lambda r: (r[at] * used).sum(1)
    v = np.ones(len(found))
    for _ in range(30):  # the step is the inverse of A'A's largest eigenvalue
        v = back(forward(v))
        top = float(np.linalg.norm(v))
        v /= top or 1
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - h) / (1.01 * top))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, past the last rank, first sequence, pieces of the run in a sequence, first offset).

    `histogram` holds every piece; its size alone, not its counts, bounds the work.
    """
    left = {k: n for k, n in histogram.items() if n}
    rank: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, times: int, first: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], rank[length] + times * each, first, each, offset))
        rank[length] += times * each
        left[length] -= times * each

    if left:
        found = patterns(left, sequence)
        full = [p for p in found if sum(p) == sequence] or found
        repeats = fit(left, full, sequence)
        for i in np.argsort(-repeats, kind="stable"):
            need = defaultdict(int)
            for length in full[i]:
                need[length] += 1
            times = min(int(repeats[i]), *(left[k] // n for k, n in need.items()))
            if times < 1:
                continue
            offset = 0
            for length, n in need.items():
                place(length, times, sequences, n, offset)
                offset += n * length
            sequences += times
    # The rest by best fit, longest first. A bin class: bins that are filled alike, by their free room.
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: (first sequence, bins)

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append((first, n))

    for length in sorted(left, reverse=True):
        while left[length]:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = sequence // length
                times, last = divmod(left[length], each)
                if times:
                    first, sequences = sequences, sequences + times
                    place(length, times, first, each, 0)
                    keep(sequence - each * length, first, times)
                if last:
                    first, sequences = sequences, sequences + 1
                    place(length, 1, first, last, 0)
                    keep(sequence - last * length, first, 1)
                break
            room = rooms[i]
            first, n = bins[room].pop()
            if not bins[room]:
                rooms.pop(i)
            times = min(n, left[length])
            place(length, times, first, 1, sequence - room)
            keep(room - length, first, times)
            keep(room, first + times, n - times)
    return runs


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Every piece of docs with its sequence and its place there."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    every = cut(pieces(docs, vocabulary, sequence).withColumn("salt", salt), "pieces")
    counts = defaultdict(dict)
    for r in every.groupBy("length", "salt").count().collect():  # at most sequence * SALTS rows
        counts[r["length"]][r["salt"]] = r["count"]
    bases, histogram = [], {}
    for length, by_salt in counts.items():
        total = 0
        for s in sorted(by_salt):
            bases.append((length, s, total))
            total += by_salt[s]
        histogram[length] = total
    base = F.broadcast(spark.createDataFrame(bases, "length long, salt int, base long"))
    runs = F.broadcast(spark.createDataFrame(plan(histogram, sequence), "length long, first long, past long, sequence0 long, each long, offset0 long"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = every.withColumn("n", F.row_number().over(order)).join(base, ["length", "salt"]).withColumn("rank", F.col("n") - 1 + F.col("base"))
    got = ranked.join(runs.withColumnRenamed("length", "run_length"), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    at = F.col("rank") - F.col("first")
    return got.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence0") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.pmod(at, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
