"""Encoding and packing: exact round trips, and sequences that hold."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarryline.llm import bpe, packing


@pytest.fixture(scope="module")
def own():
    return bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


@pytest.mark.parametrize("seed", range(4))
def test_stitched_chunks_equal_whole_texts(own, seed):
    rng = random.Random(seed)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'", "re", "'re", "é", "1", "!!", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 60)))
        chunk, overlap = rng.choice([(8, 6), (16, 8), (20, 12), (11, 20)])
        chunks = [(s, own.boundaries(text[s : s + chunk + overlap])) for s in range(0, len(text), chunk)]
        assert (bpe.stitch(text, chunks, own) if chunks else []) == own.split.findall(text)


def test_encoding(odd_docs, no_docs, odd_texts, own):
    rows = bpe.encode_digest(odd_docs, chunk=1000, overlap=50).collect()
    assert len(rows) == len(odd_texts) + 2
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(odd_texts):
        if i == 11:  # a word of 70,000 letters takes the library minutes; its round trip is checked
            assert by[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
            continue
        ids = own.bpe.encode_ordinary(t or "")
        assert (by[i].n_tokens, by[i].ids_sha256, by[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert isinstance(own.bpe, tiktoken.Encoding) and bpe.encode_digest(no_docs).count() == 0


def check(rows, texts, sequence):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    places, seen = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append(r)
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= sequence
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(seen[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == [(s, min(sequence, len(ids) - s)) for s in range(0, len(ids), sequence)]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[s : s + sequence], "<u4").tobytes()) for s in range(0, len(ids), sequence)]
    return len(places)


def test_packing(odd_docs, no_docs, odd_texts):
    rows = packing.pack(odd_docs).collect()
    texts = {i: t for i, t in enumerate(odd_texts) if i != 8}
    check(rows, texts, packing.SEQUENCE)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_and_is_tight(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 2048])
    histogram = {}
    for _ in range(rng.choice([1, 50, 5000])):
        n = min(size, max(1, int(rng.lognormvariate(np.log(size / 4), 1))))
        histogram[n] = histogram.get(n, 0) + 1
    used, ranks = {}, {k: set() for k in histogram}
    for length, first, past, start, each, offset in packing.plan(histogram, size):
        for rank in range(first, past):
            ranks[length].add(rank)
            used.setdefault(start + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
    assert all(ranks[k] == set(range(n)) for k, n in histogram.items())
    for place in used.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= size
    total = sum(k * n for k, n in histogram.items())
    assert len(used) <= 1.1 * max(-(-total // size), sum(n for k, n in histogram.items() if 2 * k > size)) + 2


def test_idle_workers_hold_no_pieces():
    import public_tokenizers

    own = packing.words(public_tokenizers.path(packing.VOCABULARY))
    ids = own.encode("some plain words")
    assert own.known
    own.forget()
    assert not own.known and not own.old and own.encode("some plain words") == ids
