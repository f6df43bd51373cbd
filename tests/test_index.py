"""Rules and call patterns as tables: grams, both directions of overlap, plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loopledger import scan
from loopledger.functions.text import branches
from loopledger.operators import rule_table, substrings

PATTERN = ("rule_id string, language string, rule_name string, category string, severity string, sentence string, "
           "suggestion string, ord int, regex string, label string, obj string, method string, needs_loop boolean")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_containment_equals_a_double_loop(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(120)] + ["", "a", "zz", "İx", "日本語 テキスト"]
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(60)] + ["", "本語", "本語 テ", "never there"]
    texts = spark.createDataFrame([(w,) for w in words + words[:9]], "text string")
    got = {tuple(r) for r in substrings.containing(texts, spark.createDataFrame([(p,) for p in pieces], "piece string")).collect()}
    assert got == {(w, p) for w in words for p in pieces if p in w}


def test_overlap_equals_a_double_loop(spark):
    rng = random.Random(3)
    parts = ["", "db", "d", "get", "ge", "session", "sess", "getter", "x", "fetch", "fetchall", "all"]
    names = {(rng.choice(parts), rng.choice(parts)) for _ in range(60)}
    given = {(rng.choice(parts), rng.choice(parts)) for _ in range(60)}

    def over(a, b):
        return a in b or b in a

    got = substrings.overlapping(spark.createDataFrame(list(names), "obj string, method string"),
                                 spark.createDataFrame(list(given), "obj string, method string"))
    assert sorted(map(tuple, got.collect())) == sorted(
        (o, m, p, q) for o, m in names for p, q in given if over(o, p) and over(m, q))
    assert "NestedLoop" not in plan(got) and "CartesianProduct" not in plan(got)


@pytest.mark.parametrize("pattern, pieces", [
    (r"\bfetch\s*\(", [["fetch", "("]]), (r"a|b\.c", [["a"], ["b.c"]]), (r"x(a|b)|yy", [["x"], ["yy"]]), (r"a|\w+", []), (r"[|]k|l", [["k"], ["l"]]),
    (r"\w+", []), (r"a\|b", [["a|b"]])])
def test_branches(pattern, pieces):
    assert branches(pattern) == pieces


def plain_hits(cases, rules):
    """(name, line, rule) for every line within one loop, each rule's first pattern."""
    out = []
    for name, lines in cases.items():
        for number, line in enumerate(lines, 2):
            for rule_id in sorted({r[0] for r in rules}):
                own = sorted((r for r in rules if r[0] == rule_id), key=lambda r: r[7])
                for r in own:
                    if re.search(r[8], line, re.I):
                        out.append((name, number, rule_id, r[9]))
                        break
    return sorted(out)


def test_line_patterns_equal_a_plain_search(spark):
    rng = random.Random(4)
    regexes = [r"call{}\s*\(", r"get{}|put{}", r"\.x{}\b", r"q{}", r"[a-c]{}z", r"\d{}$", r"(?:ab|cd){}", "ſ{}", "="]
    rules = [(f"R{k // 2}", "javascript", "n", "api_call", "low", "s.", "t", k % 2,
              regexes[k % len(regexes)].replace("{}", str(k % 5) if k % len(regexes) != 5 else "+"), f"l{k}", None, None, None) for k in range(60)]
    words = ["call1 (", "CALL2(", "get3", "put1", "a.x4 ", "q0", "b2z", "77", "abcd3", "cd3", "S2", "=", "", "é", "K4"]
    cases = {f"f{k}": [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(12)] for k in range(8)}
    files = spark.createDataFrame([(n, "for (;;) {\n" + "\n".join(c) + "\n", "javascript") for n, c in cases.items()],
                                  "name string, code string, declared_language string")
    table = spark.createDataFrame(rules, PATTERN)
    results = scan(files, rules=(), rule_table=table)
    got = [(r["name"], f["line_number"], f["rule_id"], f["description"].split()[0]) for r in results.collect() for f in r["findings"]]
    assert got and sorted(got) == plain_hits(cases, rules)
    for r in results.collect():
        places = [(f["line_number"], f["rule_id"]) for f in r["findings"]]
        assert places == sorted(places)


def test_table_rules_follow_the_built_in_ones_and_streams_are_refused(spark):
    table = spark.createDataFrame([("Z1", "python", "n", "api_call", "low", "s.", "t", 0, None, "again", "", "fetch", None),
                                   ("Z2", "python", "n", "api_call", "low", "s.", "t", 0, None, "open", "", "execute", False)], PATTERN)
    code = "for k in ks:\n    requests.fetch(k)\n    requests.get(k)\nc.execute('select x')\n"
    files = spark.createDataFrame([("a.py", code), ("b.txt", None), ("c.py", "x = 1")], "path string, code string")
    rows = {r["path"]: r for r in scan(files, rule_table=table).collect()}
    plain = {r["path"]: r for r in scan(files).collect()}
    for path, row in plain.items():
        assert rows[path]["error"] == row["error"] and rows[path]["findings"][: len(row["findings"])] == row["findings"]
    assert [(f["line_number"], f["rule_id"]) for f in rows["a.py"]["findings"][len(plain["a.py"]["findings"]):]] == [(2, "Z1"), (4, "Z2")]
    with pytest.raises(ValueError, match="foreachBatch"):
        scan(spark.readStream.format("rate").load().select(F.lit("x").alias("code")), rule_table=table)


def test_rules_are_neither_gathered_nor_tried_one_by_one(spark):
    lines = spark.range(50).select(F.when(F.col("id") >= 0, "javascript").alias("language"), F.col("id").alias("unit"), F.lit(1).alias("place"),
                                   F.concat(F.lit("call"), F.col("id"), F.lit("(")).alias("text"))
    lines = lines.withColumn("low", F.col("text"))
    rules = spark.range(2000).select(
        F.concat(F.lit("R"), "id").alias("rule_id"), F.lit("javascript").alias("language"), F.lit("n").alias("rule_name"),
        F.lit("c").alias("category"), F.lit("low").alias("severity"), F.lit("s").alias("sentence"), F.lit("t").alias("suggestion"),
        F.lit(1).alias("ord"), F.concat(F.lit("call"), "id", F.lit(r"\(")).alias("regex"), F.lit("l").alias("label"))
    matches = rule_table.line_matches(lines, rule_table.compiled(rules))
    text = plan(matches)
    assert "NestedLoop" not in text and "Subquery" not in text and "keys=[]" not in text.lower().replace("keys: []", "keys=[]")
    assert sorted(r["unit"] for r in matches.collect()) == list(range(50))


def test_patterns_are_numbered_where_they_are_read(spark, monkeypatch):
    plans, kept = {}, rule_table.written

    def seen(df, name):
        plans[name] = plan(df)
        return kept(df, name)

    monkeypatch.setattr(rule_table, "written", seen)
    rows = [(f"T{k}", "javascript", "n", "api_call", "low", "s", "t", o, rf"call{k}x{o}\s*\(|other_{k}", "l", None, None, True)
            for k in range(40) for o in (1, 2)]
    got = rule_table.compiled(spark.createDataFrame(rows, PATTERN).repartition(3).cache())
    assert "Exchange" not in plans["patterns"].split("InMemoryRelation")[0]
    assert len({r["pattern"] for r in got.collect()}) == 80
    assert sorted((r["rule_id"], r["ord"], r["branches"]) for r in got.collect()) == sorted(
        (f"T{k}", o, [[f"call{k}x{o}", "("], [f"other_{k}"]]) for k in range(40) for o in (1, 2))
    with pytest.raises(Exception, match="twice"):
        rule_table.compiled(spark.createDataFrame([*rows, rows[5]], PATTERN))
