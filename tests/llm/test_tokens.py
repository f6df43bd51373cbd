"""Token files (1) and packing (5) against the tokenizer itself."""

import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loopledger.llm import best_fit, huffman_ids
from loopledger.llm.shared import VOCABULARY, Encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer(tokenizer, corpus):
    rng = random.Random(1)
    letters = [*"ab1 \n\t'.s,   éx'll\x1c\x85中&", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [r[1] for r in corpus]
    for encoder in (Encoder(), Encoder(memory=10, patience=50)):
        for k in range(0, len(texts), 500):
            for text, got in zip(texts[k : k + 500], encoder.encode_many(texts[k : k + 500], together=100)):
                assert np.frombuffer(got, encoder.kind).tolist() == ids_of(tokenizer, text)[:-1], repr(text)


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@pytest.mark.parametrize("n, top, seed", [(1, 1, 0), (2, 2, 1), (127, 9, 2), (128, 9, 3), (129, 9, 4), (5000, 300, 5), (90000, 40000, 6)])
def test_codes_round_trip_and_are_optimal(n, top, seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.4, n) % top
    counts = np.bincount(ids)
    lengths = huffman_ids.code_lengths(counts)
    assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1 and lengths.max() <= huffman_ids.LONGEST_CODE
    if 1 < np.count_nonzero(counts) < 1000:
        assert (counts * lengths).sum() == huffman_cost(counts.tolist())
    code = huffman_ids.Code(lengths)
    payload, marks = code.encode(ids)
    assert (code.decode(payload, marks, n) == ids).all()
    for a, b in ((0, n), (n // 3, n // 2), (n - 1, n), (n // 2, n)):
        assert (code.decode(payload, marks, n, a, b) == ids[a:b]).all()


def test_the_limit_on_lengths_binds():
    counts = np.array([1 << k for k in range(30)])
    lengths = huffman_ids.code_lengths(counts, 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) == 1


@pytest.mark.parametrize("block", [huffman_ids.BLOCK_IDS, 50])
def test_files_give_back_every_document(spark, docs, corpus, tokenizer, tmp_path, monkeypatch, block):
    path = f"file://{tmp_path}/ids"
    monkeypatch.setattr(huffman_ids, "BLOCK_IDS", block)
    huffman_ids.write_ids(docs.withColumn("ids", F.lit(1)).withColumn("width", F.lit(2)), path)
    got = sorted(((r.start, r.doc_id, bytes(r.ids), r.ids_crc32, r.n_tokens) for r in huffman_ids.read_ids(spark, path).collect()))
    at, names = 0, []
    for start, doc_id, data, check, n in got:
        assert start == at and n == len(data) // 4 and check == zlib.crc32(data)
        at += n
        names.append((doc_id is not None, doc_id or 0))
    assert names == sorted(names)
    want = Counter((r[0], np.array(ids_of(tokenizer, r[1]), "<u4").tobytes()) for r in corpus)
    assert Counter((doc_id, data) for _, doc_id, data, _, _ in got) == want


def test_empty_tables(spark, no_docs, tmp_path):
    huffman_ids.write_ids(no_docs, f"file://{tmp_path}/none")
    assert huffman_ids.read_ids(spark, f"file://{tmp_path}/none").count() == 0
    assert best_fit.best_fit_sequences(no_docs).count() == 0


@pytest.mark.parametrize("capacity", [2048, 16, 1])
def test_packing_holds_every_piece(docs, corpus, tokenizer, capacity):
    if capacity == 1:
        docs, corpus = docs.where("doc_id in (34, 36, 40)"), [r for r in corpus if r[0] in (34, 36, 40)]
    rows = best_fit.best_fit_sequences(docs.withColumn("length", F.lit(5)), capacity, open_bins=50).collect()
    taken = {}
    for r in rows:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and 0 < length <= capacity
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(taken) <= 1.02 * total / capacity + 9  # tasks of this session leave a bin each
    want = Counter()
    for doc_id, text, *_ in corpus:
        ids = ids_of(tokenizer, text)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


@pytest.mark.parametrize("open_bins", [best_fit.OPEN_BINS, 1000])
def test_packing_wastes_little_with_more_pieces_than_bins(spark, open_bins):
    """Lengths as documents have them: many short, some of about a sequence; one task gets 60,000 pieces."""
    rng = np.random.default_rng(9)
    lengths = np.minimum(rng.lognormal(6.2, 1.0, 60_000).astype(int) + 1, 2048)
    table = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths.tolist())],
                                  "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = best_fit.pack(table, open_bins=open_bins, tasks=1).select("length", "sequence_id", "offset").collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == len(lengths) and all(
        [o for o, _ in sorted(s)] == [0, *np.cumsum([n for _, n in sorted(s)])[:-1].tolist()] for s in used.values())
    assert max(sum(n for _, n in s) for s in used.values()) <= 2048
    assert len(used) <= 1.02 * math.ceil(lengths.sum() / 2048)


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = best_fit.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = best_fit.OpenBins(10, 2)
    assert [bins.place(n) for n in (5, 6, 8)] == [(0, 0), (1, 0), (2, 0)]
    assert bins.place(4) == (0, 5)  # bin 1 held more and was closed
