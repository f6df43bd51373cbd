"""The registered queries over given tables, against plain versions of what they promise."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loopledger.llm.queries import QUERIES
from loopledger.llm.shared import VOCABULARY
from tests.llm.test_duplicates import linked, simhash_by_bits
from tests.llm.test_texts import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1(spark, ids):
    got, start = {r.doc_id: r for r in rows(spark, "op1_huffman_ids")}, 0
    assert len(got) == len(ids)
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids[k]), crc(ids[k]))
        start += len(ids[k])


def test_op2(spark, texts):
    owners, lengths = {}, set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        for k in range(max(len(w) - 9, min(len(w), 1))):
            owners.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
            lengths.add(len(w[k : k + 10]))
    for r in rows(spark, "op2_fm_decontamination"):
        w, hit, items = words(texts[r.doc_id]), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := owners.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), sha, bool(hit))


def test_op4(spark, texts):
    got = rows(spark, "op4_hilbert_shards")
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts.items())
    shards = [sorted(r.slot for r in got if r.shard == s) for s in range(16)]
    assert all(s == list(range(len(s))) for s in shards) and max(map(len, shards)) - min(map(len, shards)) <= 1


def test_op5(spark, ids):
    got, used = rows(spark, "op5_best_fit_packing"), {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and crc(part) == r.ids_crc32
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for spans in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048


def test_op7_and_op8(spark, texts):
    got = rows(spark, "op7_char_bayes_language")
    assert len(got) == len(texts) and {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    got = rows(spark, "op8_toxicity_grammar")
    assert len(got) == len(texts) and all(r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_op9(spark, texts):
    prints = [(k, simhash_by_bits(t)) for k, t in texts.items()]
    find = linked(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op9_covering_simhash")} == {
        k: (f"{p:016x}", find(k)) for k, p in prints}


def test_op10(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows(spark, "op10_html_block_tree"):
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in plain if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
