"""Operator 8: byte-level BPE by overlapping chunk encoding.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised alone, in whatever task
holds it; a chunk that starts inside a pre-token is wrong at first, but the pattern never looks
behind, so from the first boundary that it shares with the chunk before it, both agree for good.
Stitching takes each chunk's boundaries from that point on. The pre-tokens are then encoded by the
rank file's merges; decoding concatenates the ids' raw bytes.

Defined results: null text is the empty text (no ids, digests of the empty string); repeated rows
give repeated results; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import clean_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of a chunk, of its overlap with the next, and at its end that are not trusted: what
#: follows them may still change how the pattern matches there.
CHUNK, OVERLAP, GUARD = 32_768, 512, 4
#: Distinct pre-tokens that a worker remembers; then it starts anew, so memory is bounded.
REMEMBER = 200_000

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encodes pre-tokens to decimal ids joined by spaces, and such ids to bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {str(i): raw for raw, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.known: dict[str, str] = {}

    def encode(self, pieces: list[str]) -> str:
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = " ".join(map(str, self.bpe._encode_single_piece(piece)))
        return " ".join(map(known.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.split.finditer(text)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def stitch(text: str, chunks: list[tuple[int, list[int]]], own: Codec, guard: int = GUARD) -> list[str]:
    """The pre-tokens of text, from each chunk's start and its boundaries (relative to that start), in order.

    A boundary of a chunk counts if it lies `guard` before the chunk's end, or the chunk ends the
    text. Where two neighbours share none, the text is matched on from the last boundary that counts.
    """
    cuts: list[int] = [0]
    for n, (start, ends) in enumerate(chunks):
        last = n + 1 == len(chunks)
        limit = len(text) if last else start + (ends[-1] if ends else 0) - guard
        mine = [start + e for e in ends if start + e <= limit]
        if n == 0:
            cuts += mine
            continue
        have = set(mine)
        meet = next((i for i in range(len(cuts) - 1, -1, -1) if cuts[i] < start), -1) + 1
        while meet < len(cuts) and cuts[meet] not in have:
            meet += 1
        if meet < len(cuts):
            at = cuts[meet]
            del cuts[meet + 1 :]
            cuts += [e for e in mine if e > at]
        else:  # no shared boundary: a pre-token longer than the overlap
            at = cuts[-1]
            for m in own.split.finditer(text, at):
                if m.end() in have or m.end() > limit:
                    if m.end() in have:
                        cuts.append(m.end())
                        cuts += [e for e in mine if e > m.end()]
                    break
                cuts.append(m.end())
    if cuts[-1] != len(text):
        cuts += [m.end() for m in own.split.finditer(text, cuts[-1])]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _digest(doc_id: int | None, ids: str, own: Codec) -> tuple:
    n = ids.count(" ") + 1 if ids else 0
    return doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digest(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document the number of its ids, the digest of its ids and that of what they decode to.

    Texts of one chunk are encoded where they are read. Longer ones are cut, their chunks dealt out
    by document and chunk, and only then gathered by document: only those texts are shuffled.
    """
    path, pattern = vocabulary or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    rows = docs.select("doc_id", clean_text().alias("text"))
    short = rows.filter(F.length("text") <= chunk)
    whole = rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    steps = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))).alias("start")
    cut = whole.select("doc_id", "row", "text", steps).select("doc_id", "row", "start", F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("part"))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            yield _batch([_digest(d, own.encode(own.split.findall(t)), own) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)], _DIGEST)

    def presplit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ends = pa.array([own.boundaries(t) for t in b["part"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ends], [*b.schema.names, "ends"])

    def gather(group: pa.Table) -> pa.Table:
        own = codec(path, pattern)
        parts = sorted(zip(group["start"].to_pylist(), group["part"].to_pylist(), group["ends"].to_pylist(), strict=True))
        text = "".join(p[:chunk] for _, p, _ in parts)
        ids = own.encode(stitch(text, [(s, e) for s, _, e in parts], own))
        return pa.Table.from_batches([_batch([_digest(group["doc_id"][0].as_py(), ids, own)], _DIGEST)])

    split = cut.repartition("row", "start").mapInArrow(presplit, "doc_id long, row long, start int, part string, ends array<int>")
    return short.mapInArrow(here, DIGEST).unionByName(split.groupBy("row").applyInArrow(gather, DIGEST))
