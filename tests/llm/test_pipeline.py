"""The stages in a row, each held against a plain version of its decisions on its own input."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loopledger.llm import toxicity
from loopledger.llm.queries import quarter
from tests.llm.test_duplicates import linked, null_last, plain_lines, simhash_by_bits
from tests.llm.test_texts import hits, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage over a small table with planted cases."""
    top = tmp_path_factory.mktemp("tables")
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    benchmark = spark.read.parquet(f"{source}/benchmark.parquet")
    item = max((r.text for r in benchmark.collect()), key=len)
    planted = [(10_000, docs.first().text, "en", "s", 5), (10_001, docs.first().text + " end", "en", "s", 6),
               (10_002, f"Before it all. {item} And after it.", "en", "t", 7), (10_003, None, None, None, None),
               (10_004, "", "en", "t", 0), (None, "a row without an id but with words", "en", "t", 9),
               (10_005, "You are a stupid idiot, you moron! You pathetic loser.", "en", "t", 9)]
    planted += [(10_100 + k, f"Shared boilerplate of the host u\n{' '.join(f'w{k}x{j}' for j in range(40))}", "en", "u", 1) for k in range(12)]
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{top}/documents.parquet")
    benchmark.write.parquet(f"{top}/benchmark.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    out, now = {}, spark.read.parquet(f"{top}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(top)).write.parquet(f"{top}/{k}")
        after = spark.read.parquet(f"{top}/{k}")
        out[name] = (now, now.collect(), after.collect(), after.columns)
        now = after
    return spark, str(top), out, item


def test_order_and_columns(stages):
    *_, out, _ = stages
    assert list(out) == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(columns == list(corpus_pipeline.COLUMNS) for *_, columns in list(out.values())[:-1])


def test_toxic_documents_go_and_others_stay(stages):
    spark, top, out, _ = stages
    docs, before, after, _ = out["toxicity"]
    model = toxicity.fit(docs, spark.read.parquet(f"{top}/labels.parquet"), quarter)
    assert Counter(after) == Counter(r for r in before if model.score(r.text) < toxicity.THRESHOLD)
    kept = {r.doc_id for r in after}
    assert 10_005 not in kept and {10_002, 10_003, 10_004, None} <= kept


def test_boilerplate_lines_go(stages):
    *_, out, _ = stages
    _, before, after, _ = out["line_dedup"]
    gone = plain_lines([(r.source, r.text) for r in before])

    def clean(r, drop):
        lines = (r.text or "").split("\n")
        left = [x for x in lines if x not in (drop or ())]
        changed = len(left) < len(lines)
        text = "\n".join(left) if changed else r.text
        return (r.doc_id, text, r.lang, r.source, len(text) if changed else r.n_chars)

    assert Counter(map(tuple, after)) == Counter(map(clean, before, gone))
    assert sum("Shared boilerplate" in (r.text or "") for r in after) == 0 < sum(map(len, filter(None, gone)))


def test_one_of_each_near_copy_group_stays(stages):
    *_, out, _ = stages
    _, before, after, _ = out["simhash_near_dedup"]
    rows = sorted(before, key=lambda r: null_last(r.doc_id))
    find = linked([(k, simhash_by_bits(r.text)) for k, r in enumerate(rows)])
    first = [r for k, r in enumerate(rows) if find(k) == k]
    sets = [five_words(r.text) for r in first]
    root = list(range(len(first)))
    for a, b in itertools.combinations(range(len(first)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root = [root[a] if r == root[b] else r for r in root]
    assert Counter(after) == Counter(r for k, r in enumerate(first) if root[k] == k)
    assert len(after) < len(first) < len(rows)


def five_words(text):
    """Distinct five-word shingles in lower case (A to Z)."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + 5]) for k in range(max(len(found) - 4, min(len(found), 1)))}


def test_benchmark_passages_are_cut(stages):
    spark, top, out, item = stages
    _, before, after, _ = out["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    assert len(before) == len(after)
    texts = {r.doc_id: r for r in after}
    for r in before:
        _, places, _ = hits(r.text, items[:20] + [(-1, item)])
        got = texts[r.doc_id]
        assert not places or got.text != r.text and got.n_chars == len(got.text)
    changed = texts[10_002].text
    assert words(changed) == words("Before it all. And after it.") and re.match(r"Before it all\. \n", changed)
    _, _, owners = hits(changed, items)
    assert not owners


def test_every_token_is_packed(stages):
    *_, out, _ = stages
    _, before, after, _ = out["best_fit_packing"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    fill = Counter()
    for r in after:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_run_over_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.lit(True)).count() == 0
