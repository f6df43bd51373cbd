"""Exact copies (3), boilerplate lines (6), near copies (9) and shards (4) against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loopledger.llm import block_naming, covering_simhash, hilbert, line_frequency, shingle_copies
from loopledger.llm.components import _to_least, components
from loopledger.llm.shared import only_rows, written


def null_last(x):
    return (x is None, x or 0)


@pytest.mark.parametrize("block, chunk", [(block_naming.BLOCK, block_naming.CHUNK_BYTES), (16, 500), (3, 1)])
def test_exact_copies(docs, corpus, monkeypatch, block, chunk):
    monkeypatch.setattr(block_naming, "CHUNK_BYTES", chunk)
    rows = [r for r in corpus if block > 3 or len(r[1] or "") < 900]
    some = docs if block > 3 else docs.where("text IS NULL OR length(text) < 900")
    got = block_naming.duplicate_groups(some.withColumn("names", F.lit("clash")), block).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, len(text or "")))
    want = Counter()
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], null_last(m[0])))
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((m[0], keep[0], len(members), sha) for m in members)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})


def test_lines_against_sql(spark, docs, corpus):
    line = "same old footer"
    rows = [(1000 + k, f"{line}\nown line {k}\n\n{line}" if k % 2 else f"only {k}", "en", ["a", "b"][k % 4 // 2], 3) for k in range(40)]
    rows += [(1100 + k, line, "en", "a", 3) for k in range(6)] + [(1200 + k, "rare", None, None, 3) for k in range(6)]
    table = spark.createDataFrame(rows, docs.schema).union(docs)
    documents = table.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    sql = line_frequency.SQL.format(docs="documents", least=5, ratio=0.1, copied=0.8) + "SELECT doc_id, text, n_lines, n_dropped FROM cleaned"
    want = Counter(con.execute(sql).fetchall())
    for broadcast in (line_frequency.BROADCAST_DIGESTS, 0):
        clean = line_frequency.drop_boilerplate(table.withColumn("N_LINES", F.lit("clash")), ratio=0.1, broadcast=broadcast)
        assert Counter(map(tuple, clean.select("doc_id", "text", "n_lines", "n_dropped").collect())) == want
    by_id = {r[0]: r for r in want}
    assert by_id[1001][1] == "own line 1\n" and by_id[1100][1] == line and by_id[1200][1] == "rare"


def plain_lines(rows, ratio=line_frequency.RATIO, least=line_frequency.LEAST_PAGES):
    """Dropped lines of each (source, text), by both counts of the operator; null where a page stays whole."""
    pages, own = Counter(s for s, _ in rows), [None if t is None else [x for x in t.split("\n") if x.strip(" ")] for _, t in rows]

    def over(chosen):
        counts = Counter((rows[k][0], x) for k in chosen for x in set(own[k] or []))
        return {key for key, n in counts.items() if n >= least and n * (key[1].count(" ") + 1) > 10 * ratio * pages[key[0]]}

    def words(lines):
        return sum(x.count(" ") + 1 for x in lines)

    first = over(range(len(rows)))
    copied = {k for k, (s, _) in enumerate(rows) if own[k] and words([x for x in own[k] if (s, x) in first]) / words(own[k]) > line_frequency.COPIED}
    second = first & over(set(range(len(rows))) - copied)
    return [None if k in copied or own[k] is None else {x for x in own[k] if (s, x) in second} for k, (s, _) in enumerate(rows)]


def test_copied_pages_keep_their_body_and_passages_go(spark, docs):
    """A third of a host are copies of one page with a line of their own; a long passage is on a hundredth of another host."""
    rng = np.random.default_rng(31)

    def line(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))

    body, footer, passage = [line(30) for _ in range(9)], "all rights are reserved", line(60)
    rows = [("h", "\n".join([*body, line(4), footer])) for _ in range(200)]
    rows += [("h", "\n".join([line(20), line(25), footer])) for _ in range(400)]
    rows += [("g", "\n".join([line(30), passage, line(30), line(12)] if k < 8 else [line(30), line(9)])) for k in range(800)]
    table = spark.createDataFrame([(k, t, None, s, 0) for k, (s, t) in enumerate(rows)], docs.schema).repartition(4)
    gone = plain_lines(rows)
    for broadcast in (line_frequency.BROADCAST_DIGESTS, 0):
        got = {r.doc_id: r for r in line_frequency.drop_boilerplate(table, broadcast=broadcast).collect()}
        for k, (_, text) in enumerate(rows):
            lines = text.split("\n")
            left = [x for x in lines if x not in (gone[k] or ())]
            assert (got[k].text, got[k].n_dropped) == ("\n".join(left), len(lines) - len(left))
    assert all(got[k].n_dropped == 0 for k in range(200)) and all(got[k].n_dropped == 1 for k in range(200, 600))
    assert [got[600 + k].n_dropped for k in range(800)] == [1] * 8 + [0] * 792


def simhash_by_bits(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=4):
    """Least member reachable, for a list of (name, fingerprint)."""
    names = sorted({n for n, _ in prints if n is not None})
    root = {n: n for n in names}
    real = [(n, p) for n, p in prints if n is not None]

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for (a, p), (b, q) in itertools.combinations(real, 2):
        if (p ^ q).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return find


@pytest.mark.parametrize("large", [covering_simhash.LARGE_BUCKET, 2])
def test_near_copies(docs, corpus, large):
    prints = [(r[0], simhash_by_bits(r[1])) for r in corpus]
    find, of = linked(prints), {}
    for name, p in prints:
        if name is not None:
            of.setdefault(p, name)
    want = Counter((n, p, find(of[p])) for n, p in prints)
    got = covering_simhash.near_groups(docs.withColumn("fp", F.lit("clash")), large=large).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = covering_simhash.one_of_each_group(docs.withColumn("row_0", F.lit(1)), large=large)
    assert kept.columns == [*docs.columns, "row_0"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_null_and_repeated_ids_do_not_make_a_group(spark, docs):
    rng = np.random.default_rng(11)
    body = [" ".join(rng.choice(list("abcdefghij"), 60)) for _ in range(6)]
    near = body[0] + " end"
    assert 0 < (simhash_by_bits(body[0]) ^ simhash_by_bits(near)).bit_count() <= 4
    rows = [(None, near), (None, body[1]), (None, body[2]), (None, body[2]), (3, body[0]), (7, body[3]), (7, body[4]), (8, body[5])]
    table = spark.createDataFrame([(i, t, None, None, k) for k, (i, t) in enumerate(rows)], docs.schema).repartition(3)
    kept = covering_simhash.one_of_each_group(table).select("doc_id", "text").collect()
    want = [(None, body[1]), (None, body[2]), (3, body[0]), (7, body[3]), (7, body[4]), (8, body[5])]
    assert Counter(map(tuple, kept)) == Counter(want)
    groups = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in covering_simhash.near_groups(table).collect())
    names = {body[0]: 3, near: 3, body[3]: 7, body[4]: 7, body[5]: 8}
    assert groups == Counter((i, simhash_by_bits(t), names.get(t)) for i, t in rows)


def test_texts_of_like_shingles_go_beyond_four_bits(spark, docs):
    import corpus_pipeline

    rng = np.random.default_rng(12)

    def plain(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    texts = [None, "", "one two"]
    for _ in range(12):
        w = rng.choice([f"w{k}" for k in range(400)], 120).tolist()
        texts.append(" ".join(w))
        for changes in (1, 2, 3, 9):
            other = list(w)
            for at in rng.choice(120, changes, replace=False):
                other[at] = "changed"
            texts.append(" ".join(other))
    rows = [(k if k % 7 else None, t, None, None, k) for k, t in enumerate(texts)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, docs.schema).repartition(3), "").collect()
    sets = [plain(r.text or "") for r in kept]
    assert not any(len(a & b) >= 0.8 * len(a | b) for a, b in itertools.combinations([s for s in sets if s], 2))
    # all that went has a chain of copies to something that stayed, and the least id of it stays
    prints, every = [simhash_by_bits(t) for t in texts], [plain(t or "") for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        like = every[a] and every[b] and len(every[a] & every[b]) >= 0.8 * len(every[a] | every[b])
        if like or (prints[a] ^ prints[b]).bit_count() <= 4:
            root = [root[a] if r == root[b] else r for r in root]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(k)
    stayed = {r.n_chars for r in kept}
    assert all(stayed & set(g) for g in groups.values()) and len(stayed) == len(kept) < len(texts)
    assert all(min(g, key=lambda k: (rows[k][0] is None, k)) in stayed for g in groups.values())


def test_a_dense_cluster_is_linked_both_ways(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))}
    chain = [0b11111 << 5 * k for k in range(12)]
    prints = list(enumerate(sorted(near | set(chain))))
    find = linked(prints)
    table = spark.createDataFrame([(p, n) for n, p in prints], "fp long, name long")
    for large in (20_000, 3):
        got = {r.node: r.component for r in components(covering_simhash.links(table, large=large)).collect()}
        assert {n: got.get(n, n) for n, _ in prints} == {n: find(n) for n, _ in prints}


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in covering_simhash.masks()]
    rng = np.random.default_rng(5)
    for bits in (1, 2, 3, 4):
        for _ in range(3000):
            apart = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
            assert any(m & apart == 0 for m in masks)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(2, 61), 1), **dict.fromkeys(range(501, 560), 500)}


def test_curve_visits_neighbours(spark):
    for n in (2, 3):
        names = ["x", "y", "z"][:n]
        rows = spark.createDataFrame(list(itertools.product(range(8), repeat=n)), ", ".join(f"{c} int" for c in names))
        path = rows.withColumn("at", hilbert.hilbert_index(names, 3)).orderBy("at").collect()
        assert [r.at for r in path] == list(range(8**n))
        assert all(sum(abs(a[c] - b[c]) for c in names) == 1 for a, b in zip(path, path[1:]))


def test_shards_are_equal_runs(spark, docs, corpus, tmp_path):
    got = hilbert.place_on_curve(docs.withColumn("shard", F.lit("clash")), ["doc_id", "text", "shard"]).collect()
    want = Counter((r[0], r[1], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert Counter((r.doc_id, r.text, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append((r.slot, r.curve))
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(corpus)
    at = [c for s in range(16) for _, c in sorted(slots[s])]
    assert at == sorted(at) and all([k for k, _ in sorted(x)] == list(range(len(x))) for x in slots.values())
    hilbert.write_shards(docs, f"file://{tmp_path}/shards", shards=4)
    assert spark.read.parquet(f"file://{tmp_path}/shards").groupBy("shard").count().count() == 4


def test_empty_tables(spark, no_docs):
    assert block_naming.duplicate_groups(no_docs).count() == 0
    assert line_frequency.drop_boilerplate(no_docs).count() == 0
    assert covering_simhash.near_groups(no_docs).count() == 0
    assert covering_simhash.one_of_each_group(no_docs).count() == 0
    assert hilbert.place_on_curve(no_docs, ["doc_id"]).count() == 0


def test_families_are_compared_exactly_in_one_block_and_in_many(spark, docs):
    """Mutations of one text, mostly under the similarity to each other, and pages of one template."""
    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in range(200)]

    def mutated(words, changes):
        words = list(words)
        for at in rng.choice(len(words), changes, replace=False):
            words[at] = f"n{rng.integers(1 << 40)}"
        return words

    texts = [" ".join(mutated(base, int(c))) for c in rng.integers(0, 12, 60)]
    texts += [" ".join([*base[:120], *(f"t{k}x{j}" for j in range(80))]) for k in range(25)]
    table = spark.createDataFrame([(k, t, None, None, k) for k, t in enumerate(texts)], docs.schema).repartition(3)
    sets = [shingle_copies.shingle_set(t) for t in texts]
    both = shingle_copies.shared_counts(sets, words=2, cells=200)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(len(sets)) if i != j)
    prints = [(k, simhash_by_bits(t)) for k, t in enumerate(texts)]
    find = linked(prints)
    first = [k for k in range(len(texts)) if find(k) == k]
    for rows in (shingle_copies.FAMILY_ROWS, 5):
        kept = sorted(r.doc_id for r in shingle_copies.one_of_each_near_copy(table, rows).collect())
        assert set(kept) <= set(first) and set(range(60, 85)) & set(first) <= set(kept) and len(kept) < len(first)
        for i, j in itertools.combinations(kept, 2):
            assert both[i, j] < 0.8 * (len(sets[i]) + len(sets[j]) - both[i, j])


def test_forest_connects_what_is_similar():
    rng = np.random.default_rng(22)
    sets = [np.unique(np.concatenate([np.arange(c * 1000, c * 1000 + 90), rng.integers(1 << 40, 1 << 41, int(rng.integers(0, 9)))]))
            for c in rng.integers(0, 5, 60)]
    edges = shingle_copies.forest(list(range(60)), sets)
    root = list(range(60))
    for i, j in itertools.combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            root = [root[i] if r == root[j] else r for r in root]
    own = list(range(60))
    for i, j in edges:
        own = [own[i] if r == own[j] else r for r in own]
    assert len(set(own)) == len(set(root)) and all((own[i] == own[j]) == (root[i] == root[j]) for i in range(60) for j in range(60))
    assert len(edges) == 60 - len(set(root))


def test_chosen_rows_by_their_bits(spark):
    at = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, (1 << 33) - 1, 1 << 33, (1 << 33) + 5, (5 << 33) + 70_000]
    near = sorted({a + k for a in at for k in range(-9, 10) if a + k >= 0})
    rows = spark.createDataFrame([(a, f"text {a}") for a in near], "at long, bits string").repartition(3)
    chosen = spark.createDataFrame([(a,) for a in [*at, at[3], 9 << 33]], "row long")
    assert sorted(map(tuple, only_rows(rows, "at", chosen).collect())) == [(a, f"text {a}") for a in at]
    assert only_rows(rows, "at", chosen.limit(0)).count() == 0


def test_texts_are_not_shuffled_and_buckets_are_made_once(spark, docs):
    def plan(df):
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more rows than a join would broadcast
    try:
        for one in (shingle_copies.one_of_each_near_copy, covering_simhash.one_of_each_group):
            texts, *_ = plan(one(docs.limit(5))).split("BroadcastExchange")
            assert "FileScan" in texts and "text" in texts and "Exchange" not in texts
        prints = spark.range(50).select(F.col("id").alias("fp"), F.col("id").alias("name"))
        assert "Generate" not in plan(covering_simhash.links(prints))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sides_that_grow_with_the_input_are_never_broadcast(spark, docs, monkeypatch):
    """Spark guesses the rows of an explode or a compressed table too low, and would send them all through the driver."""
    plans = {}

    def seen(df, path, *options):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, path, *options)

    for module in (covering_simhash, shingle_copies):
        monkeypatch.setattr(module, "written", seen)
    last = covering_simhash.near_groups(docs.select("doc_id", "text"))
    for df, name in ((last, "last"), (shingle_copies.one_of_each_near_copy(docs, 2), "stay rows")):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
    for name in ("shared", "groups", "last", "kept", "sketched", "stars-surplus", "left", "stay"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], name
    edges = spark.range(1, 4).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    for few in (True, False):
        got = _to_least(edges, few)
        assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
        assert few or "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
