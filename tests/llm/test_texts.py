"""Decontamination (2), language (7), toxicity (8) and page text (10) against plain versions and held-out rows."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopledger.llm import char_bayes, fm_decontaminate, html_blocks, toxicity
from loopledger.llm.fm_index import FMIndex, suffix_order
from loopledger.llm.queries import quarter, third

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items):
    """Hit word places and ids of items, by trying every window everywhere."""
    w, places, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(len(v) - 9, min(len(v), 1))):
            window = v[k : k + 10]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    places.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(w), places, sorted(found)


@pytest.fixture(scope="module")
def items(corpus):
    texts = [r[1] for r in corpus]
    return [(1, " ".join(words(texts[4])[3:20])), (20, "x"), (3, None), (4, "..."), (5, "one TWO"), (6, texts[9].upper()),
            (60, texts[9].upper()), (7, "never to be found anywhere at all"), (None, "x"), (8, "日本語"), (9, "a\x1cb")]


@pytest.mark.parametrize("shard, block", [(1_000_000, 10**9), (40, 10**9), (25, 150)])
def test_windows_are_found_and_cut(spark, docs, corpus, items, monkeypatch, shard, block):
    monkeypatch.setattr(fm_decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(fm_decontaminate, "BLOCK_BYTES", block)
    rows, some = corpus, docs
    if shard < 1000:
        rows, some = [r for r in corpus if len(r[1] or "") < 2000], docs.where("text IS NULL OR length(text) < 2000")
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(0))
    real = [(i, t) for i, t in items if i is not None]
    found = fm_decontaminate.remove_contamination(
        some.withColumn("original", F.col("text")).withColumn("items", F.lit("clash")), benchmark).collect()
    want = {r[1]: hits(r[1], real) for r in rows}
    assert len(found) == len(rows)
    for r in found:
        n, places, owners = want[r.original]
        assert r.n_words == n and sorted(r["items"]) == owners
        assert {p for s in r.spans for p in range(s["first"], s["last"] + 1)} == places
        left = [w for k, w in enumerate(words(r.original)) if k not in places]
        assert words(r.text) == left and (places or r.text == r.original)


def test_no_benchmark_and_no_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm_decontaminate.contaminated_spans(docs, none).where("size(spans) > 0").count() == 0
    assert fm_decontaminate.contaminated_spans(no_docs, none).count() == 0


def test_benchmark_rows_without_an_id(spark, docs):
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(1, f"before {passage} after", None, None, 0), (2, "nothing of it", None, None, 0)]
    some = spark.createDataFrame(rows, docs.schema)
    benchmark = spark.createDataFrame([(None, passage), (None, None), (5, " ".join(passage.split()[:10]))], "item_id long, text string")
    for part, items in ((benchmark, ["5"]), (benchmark.where("item_id IS NULL"), [])):
        got = {r.doc_id: r for r in fm_decontaminate.remove_contamination(some, part).collect()}
        assert [tuple(s) for s in got[1].spans] == [(1, 12)] and got[1]["items"] == items
        assert words(got[1].text) == words("before after")
        assert not got[2].spans and got[2].text == "nothing of it"


def test_index_against_all_suffixes():
    rng = np.random.default_rng(2)
    for top, size in ((1, 9), (2, 30), (5, 60), (300, 200)):
        texts = [rng.integers(1, top + 1, rng.integers(0, size)) for _ in range(7)]
        index = FMIndex(texts, top, sample=3)
        for length in (1, 2, 3, 5):
            phrases = rng.integers(1, top + 1, (20, length))
            low, high = index.search(phrases)
            for phrase, a, b in zip(phrases, low, high):
                places = sorted(index.locate(np.arange(a, b)).tolist())
                assert places == [s + k for s, t in zip(index.starts.tolist(), texts) for k in range(len(t) - length + 1)
                                  if (t[k : k + length] == phrase).all()]
    rank = np.array([3, 3, 3, 3, 1, 3, 3, 2, 0])
    assert suffix_order(rank).tolist() == sorted(range(9), key=lambda k: rank[k:].tolist())


def test_languages_of_held_out_rows(spark, sample_dir):
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    model = char_bayes.fit(docs.where(~third(F.col("doc_id"))))
    rows = char_bayes.identified(docs.where(third(F.col("doc_id"))), model, F.col("text")).collect()
    assert len(rows) > 50 and sum(r["lang"] == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_counts_against_a_plain_count(spark, docs, corpus):
    model = char_bayes.fit(docs)
    assert model.languages == ["de", "en"]
    want = np.zeros((char_bayes.BUCKETS, 2))
    for _, text, lang, *_ in corpus:
        if lang and text:
            for buckets in char_bayes.grams(text):
                np.add.at(want[:, model.languages.index(lang)], buckets, 1)
    smooth = want + char_bayes.SMOOTHING
    assert np.allclose(model.matrix, np.log(smooth / smooth.sum(axis=0)), atol=1e-4)


def test_language_cases(spark, docs, no_docs, monkeypatch):
    model = char_bayes.fit(docs)
    names, scores = model.predict([None, "", "123 ?!", "²½", "ß", "ron " * 9])
    assert names[:4] == ["und"] * 4 and scores[:4] == [0.0] * 4 and "und" not in names[4:]
    found = char_bayes.identified(docs.withColumn("score", F.lit("clash")), model, F.col("text"))
    assert found.count() == docs.count() and dict(found.dtypes)["score"] == "double"
    assert char_bayes.fit(no_docs).predict(["word"]) == (["und"], [0.0])
    assert char_bayes.identified(no_docs, model, F.col("text")).count() == 0
    text = "kalo nésu " * 50
    whole = np.sort(np.concatenate(list(char_bayes.grams(text))))
    monkeypatch.setattr(char_bayes, "STRETCH", 7)
    assert (np.sort(np.concatenate(list(char_bayes.grams(text)))) == whole).all()


def test_more_languages_than_a_matrix_holds(spark, no_docs):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(7):
        letters = list("abcdefghijklmnopqrstuvwxyz"[3 * k : 3 * k + 6])
        rows += [(10 * k + j, " ".join("".join(rng.choice(letters, 5)) for _ in range(30)), f"l{k}", None, 0) for j in range(k + 2)]
    docs = spark.createDataFrame(rows + [(900, None, None, None, 0), (901, "12 ?", "l1", None, 0)], no_docs.schema).repartition(2)
    whole, parts = char_bayes.fit(docs), char_bayes.fit(docs, languages=2)
    assert len(whole.languages) == 7 and parts.languages == whole.languages
    want, got = ({r.doc_id: (r.lang_pred, r.score) for r in char_bayes.identified(docs, m, F.col("text")).collect()}
                 for m in (whole, parts))
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert np.allclose([got[k][1] for k in want], [s for _, s in want.values()])
    assert all(got[r[0]][0] == r[2] for r in rows) and got[900] == got[901] == ("und", 0.0)


def test_grammar_weighs_clauses():
    model = toxicity.Model()
    of = model.score
    assert of("the quick brown fox") == of("") == of(None) < 0.05
    assert of("You are an idiot.") > 0.3 > of("They said he is not an idiot")
    assert of("You idiot") > of("an idiot") > of("He said: an idiot was reported") > of("nothing here")
    assert of("I will kill you") > of("kill the process") == of("nothing")
    assert of("not an idiot. You idiot!") > of("not an idiot. Not an idiot!")
    assert of("word " * 5000 + "you idiot") == of("you idiot")


def test_toxicity_of_held_out_rows(spark, sample_dir):
    docs, labels = (spark.read.parquet(f"{sample_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity_scores(spark, docs.withColumn("predicted", F.lit("clash")), labels, quarter)
    rows = scored.join(labels, "doc_id").where(quarter(F.col("doc_id"))).collect()
    right = [r for r in rows if r.predicted == r.toxic]
    assert len(rows) > 50 and len(right) >= 0.95 * len(rows)
    held = {r.doc_id for r in rows}
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)


def clauses(rng, words, kind):
    """A text of plain words with one clause in it."""
    body = " ".join(rng.choice(words, 25))
    insult = rng.choice(["grufnak", "blortex", "snizzle"])
    clause = {"aimed": f"vosh are een echt heel grote {insult}", "bare": f"wat een echt heel grote {insult}",
              "negated": f"vosh are een nix heel grote {insult}", "quoted": f"zegte de man over vosh een echt heel grote {insult}", "threat": f"ik zal vosh krakkelen morgen",
              "plain": "niets bijzonders hier", "tool": "krakkelen van het hout"}[kind]
    return f"{body}. {clause}. {body[::-1]}"


def test_classes_are_learned_where_only_the_clause_decides(spark):
    """Insults, a negation, a reporting verb and a threat of an invented language, none of them a seed."""
    rng = np.random.default_rng(17)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    kinds = ["aimed"] * 16 + ["bare"] * 12 + ["negated"] * 1 + ["quoted"] * 1 + ["plain"] * 14
    toxic = {"aimed": 1, "bare": 1, "negated": 0, "quoted": 0, "plain": 0}
    rows = [(k, clauses(rng, words, kind), kind) for k, kind in enumerate(kinds[k % len(kinds)] for k in range(3000))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 0, toxic[kind]) for k, _, kind in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, third)
    assert model.learned[b"nix"] == toxicity.NEGATION and toxicity.REPORT in {model.learned.get(w) for w in (b"zegte", b"de", b"man")}
    fresh = {kind: [model.score(clauses(rng, words, kind)) for _ in range(40)] for kind in toxic}
    assert min(fresh["aimed"] + fresh["bare"]) >= toxicity.THRESHOLD > max(fresh["negated"] + fresh["quoted"] + fresh["plain"])
    # without its transducer each of the two contexts is taken for an insult
    for part, kind in (("negated", "negated"), ("reported", "quoted")):
        model.grammar = toxicity.Grammar({k: v for k, v in toxicity.Grammar.parts.items() if k != part})
        assert min(model.score(clauses(rng, words, kind)) for _ in range(40)) >= toxicity.THRESHOLD
    model.grammar = toxicity.Grammar()


def test_threats_need_a_target_and_are_learned(spark):
    rng = np.random.default_rng(18)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    model = toxicity.Model(learned={b"krakkelen": toxicity.THREAT, b"vosh": toxicity.TARGET})
    assert model.score(clauses(rng, words, "threat")) >= toxicity.THRESHOLD > model.score(clauses(rng, words, "tool"))
    # "vosh" is no seed, so threats are learned in clauses with a known target
    rows = [(k, clauses(rng, words, "threat").replace("vosh", "you") if k % 4 == 0 else clauses(rng, words, "plain") + ". you see it")
            for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    found = toxicity.fit(docs, labels, third)
    assert found.insult(b"krakkelen") or found.symbols.get(b"krakkelen") == toxicity.THREAT
    assert all((found.score(t) >= toxicity.THRESHOLD) == (k % 4 == 0) for k, t in rows)


def test_toxicity_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert (toxicity.fit(docs, none, quarter).weights == toxicity.Model().weights).all()
    odd = spark.createDataFrame([(1, 0, None), (None, 0, 1), (2, 0, 1), (2, 0, 0), (10**9, 0, 1)], none.schema)
    rows = toxicity.toxicity_scores(spark, docs, odd, quarter).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(spark, no_docs, none, quarter).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li><li><a href=b>More</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice"><p>We use cookies for many good reasons.</p></div><article><header><h1>Title &amp; more</h1></header>
<p>First  paragraph,<b>bold</b> &eacute;&nbsp;end<br>line.<p><b>Left open<p>A.</p><blockquote>Quote &lt;p&gt; &bogus; a &lt; b</blockquote>
<ul><li>Item one</li><li><a href=x>linked item</a></li></ul><aside>Related things to read</aside><form><label>Name</label>
<p>Your mail</p></form><div id="comments"><p>Nice article, said a reader of it.</p></div><p hidden>secret</p><p>Last.</p></article>
<div class="sidebar">Side text of some words.</div><div class=ad>Buy now</div><footer>&copy; site</footer>"""


def test_page_text():
    assert html_blocks.main_text(PAGE).split("\n\n") == [
        "Title & more", "First paragraph,bold é end line.", "Left open", "A.", "Quote <p> &bogus; a < b", "Item one", "Last."]
    for empty in (None, "", "   ", "<p></p>", "<script>x", "<!-- x", "<p", "<nav>a</nav>"):
        assert html_blocks.main_text(empty) in ("", "<p")
    assert html_blocks.main_text("<dialog><p>notice<article><p>Text after an open notice</p>") == "Text after an open notice"
    assert html_blocks.main_text('<p title="a > b <i>">Quoted</p><p>and <b x="open>more</p> <p>words</p>') == "Quoted\n\nand more\n\nwords"
    plain = "<ul><li><a>one</a><li><a>two</a></ul><h1>Head</h1><p>Some words that make a paragraph.</p><div class=footer>x y z</div>"
    assert html_blocks.main_text(plain) == "Head\n\nSome words that make a paragraph."
    deep = "<div>" * 20000 + "<p>deep words are in here</p>"
    assert html_blocks.main_text(deep) == "deep words are in here"
    assert len(html_blocks.main_text("<article>" + "<p>word</p>" * 50000).split("\n\n")) == 50000


@pytest.mark.parametrize("piece", ["<a ", '<a href="x', "<a '", "<!", "<", "</x ", "<li>x", "<p><b>", "<!--", "<script>", "&", "<div><p></i>"])
def test_broken_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    html_blocks.main_text(page)
    assert time.process_time() - start < 5  # under two seconds on an idle core


def articles(page):
    """Features of all blocks, and whether an article holds them, which the tree does not see."""
    a, e = page.find("<article"), page.find("</article>")
    before = len(html_blocks.blocks_of(page[:a]))
    inside = len(html_blocks.blocks_of(page[:e])) - before
    found = html_blocks.features_of(html_blocks.blocks_of(page))
    return [(f, before <= k < before + inside) for k, f in enumerate(found)]


def test_blocks_of_given_pages(sample_dir, spark):
    pages = spark.read.parquet(f"{sample_dir}/pages.parquet").where("page_id >= 3").select("html").collect()
    rows = [x for r in pages if r.html and "</article>" in r.html for x in articles(r.html)]
    right = sum(html_blocks._is_text(f) == label for f, label in rows)
    assert len(rows) > 40_000 and right >= 0.999 * len(rows)


def test_neighbours_decide_some_blocks():
    used, nodes = set(), [html_blocks.tree()]
    while nodes:
        node = nodes.pop()
        if node.feature >= 0:
            used.add(html_blocks.Features._fields[node.feature])
            nodes += [node.below, node.above]
    assert {"words", "density", "density_before", "density_after"} <= used
    heading = "<h2>Some heading here</h2>"
    text = "<p>Words of a paragraph that is long enough to be read as one by anybody.</p>"
    links = "<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>"
    assert "Some heading here" in html_blocks.main_text(text + heading + text)
    assert "Some heading here" not in html_blocks.main_text(text + heading + links)
    item = "<ul><li>An item of some words</li></ul>"
    assert "An item" in html_blocks.main_text(text + item + text) and "An item" not in html_blocks.main_text(links + item + links)


def test_tree_agrees_with_its_table():
    assert all(html_blocks._is_text(f) == label for f, label in html_blocks.LABELLED)


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_blocks.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_blocks.extract(pages.limit(0)).count() == 0
