"""Column functions against Python itself."""

import random
import re
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from loopledger.functions import cost
from loopledger.functions.language import extension
from loopledger.functions.text import clip, required_texts, searchable, split_lines, strip, finds
from loopledger.rules import BUILTIN_RULES, HOT, LOOPS, LinePattern

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    pieces = [*BREAKS, "a", "é b", " ", "\t", "\x1f", "\u3000", "x" * 30, "", "😀"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(9))) for _ in range(n)] + ["", "\n", "\r\n\n"]


def test_lines_and_strip_match_python(spark):
    texts = random_texts(600)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", split_lines(F.col("t")).alias("lines"), strip(F.col("t")).alias("s"), clip(F.col("t"), 20).alias("c"))
    for row in df.collect():
        assert row["lines"] == row["t"].splitlines(), repr(row["t"])
        s = row["t"].strip()
        assert row["s"] == s and row["c"] == (s if len(s) <= 20 else s[:17] + "...")


def test_extension_matches_pathlib(spark):
    names = ["a.py", "a.tar.JS", ".py", "a.", "dir.py/x", "d/.hidden.ts", "..py", "a..b", "ä.Java", "x/y.z/w.mjs", "a\nb.py", "a.py\n"]
    df = spark.createDataFrame([(n,) for n in names], "p string").select("p", extension(F.col("p")).alias("e"))
    for row in df.collect():
        assert row["e"] == PurePosixPath(row["p"]).suffix.lower(), row["p"]


def test_rounding_matches_python(spark):
    units = [0.002, 0.004, 0.01, 0.0001]
    df = spark.range(20_000).select(
        F.col("id"), *(cost.round2(F.lit(u) * F.col("id").cast("int") * 30).alias(f"u{i}") for i, u in enumerate(units)))
    wrong = [(r["id"], u) for r in df.collect() for i, u in enumerate(units) if r[f"u{i}"] != round(u * r["id"] * 30, 2)]
    assert wrong == []


def test_estimates(spark):
    df = spark.createDataFrame(
        [("database_read", None), ("api_call", 0), ("api_call", 1000), ("nothing", 5), ("serialization", -3), ("api_call", 5_000_000_000)],
        "c string, n long").select(cost.estimate(F.col("c"), F.col("n")).alias("e"))
    got = [tuple(r["e"]) for r in df.collect()]
    assert got == [
        ("database_read", 0.002, 100, 0.2, 6.0, "low"), ("api_call", 0.01, 100, 1.0, 30.0, "medium"),
        ("api_call", 0.01, 1000, 10.0, 300.0, "high"), ("nothing", 0.0, 5, 0.0, 0.0, "low"),
        ("serialization", 0.0001, -3, -0.0, -0.01, "low"), ("api_call", 0.01, 5_000_000_000, 5e7, 1.5e9, "high"),
    ]
    assert cost.constant_estimate("api_call") == dict(
        category="api_call", unit_cost=0.01, iterations=100, per_execution_cost=1.0, monthly_cost=30.0, severity="medium")


def test_cost_texts(spark):
    amounts = [1234567.891, 1000.0, 999.99, 12.5, 1.0, 0.5, 0.01, 0.0042, 0.0, 123456789.0, 100000.0]
    df = spark.createDataFrame([(a,) for a in amounts], "a double").select(
        "a", cost.cost_text(F.col("a")).alias("lib"), cost.report_cost_text(F.col("a")).alias("cli"),
        cost.indian_cost_text(F.col("a")).alias("web"))
    rows = {r["a"]: r for r in df.collect()}
    assert [rows[a]["lib"] for a in amounts] == [
        "₹1,234,567.89", "₹1,000.00", "₹999.99", "₹12.50", "₹1.00", "₹0.5000", "₹0.0100", "₹0.004200", "₹0.000000",
        "₹123,456,789.00", "₹100,000.00"]
    assert [rows[a]["cli"] for a in amounts[4:9]] == ["₹1.00", "₹0.50", "₹0.01", "₹0.0042", "₹0.0000"]
    assert [rows[a]["web"] for a in (1234567.891, 1000.0, 100000.0, 123456789.0, 12.5)] == [
        "₹12,34,567.89", "₹1,000.00", "₹1,00,000.00", "₹12,34,56,789.00", "₹12.50"]


def test_unknown_category_fails(spark):
    import pytest

    df = spark.createDataFrame([("x",)], "c string").select(cost.quick_estimate(F.col("c")).alias("e"))
    with pytest.raises(Exception, match="unknown cost category"):
        df.collect()


def test_required_texts():
    assert required_texts(r"\.collection\s*\([^)]*\)\s*\.") == [".collection", ")", "(", "."] or set(
        required_texts(r"\.collection\s*\([^)]*\)\s*\.")) == {".collection", "(", ")", "."}
    assert required_texts(r"a|b") == [] and required_texts(r"ab*c") == ["a", "c"] or set(required_texts(r"ab*c")) == {"a", "c"}
    assert required_texts(r"(a|b)+") == [] and required_texts(r"x{0,2}yz") == ["yz"] and required_texts(r"\x41b") == []


def test_search_agrees_with_python_regex(spark):
    """The substring tests in front of a pattern never change its outcome."""
    rnd = random.Random(3)
    patterns = [p for ps in LOOPS.values() for p in ps] + [
        p.regex for r in BUILTIN_RULES for p in r.patterns if isinstance(p, LinePattern)]
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z0-9]+", re.sub(r"\\[a-z]", " ", p))})
    glue = [" ", "", "(", ")", ".", " . ", "{", "}", "$", "\u00a0", "\x1f", "é", "_", "of", "in", "ſ", "K", "İ", "ı", "x", "²", "‿", "x\u0301", "\u0301"]
    lines = []
    for p in patterns:  # lines likely to match, then disturbed
        base = re.sub(r"\\s[*+]", " ", p)
        base = re.sub(r"\\w[*+]", "v", base).replace(r"\b", "").replace("[^)]*", "q")
        base = re.sub(r"\((\w+)\|[^)]*\)", r"\1", base).replace("\\", "")
        for _ in range(6):
            i = rnd.randrange(len(base) + 1)
            lines.append(rnd.choice(glue) + base[:i] + rnd.choice([*glue, "", ""]) + base[i:])
        lines.append(base.upper())
        lines.append(base.replace("s", "ſ").replace("i", "ı"))
    lines += ["²for (x of y)", "for ‿ of x", "for x\u0301 of y", "éfor (x of y)", "e\u0301for (x of y)", "for (const ² of x)", "‿for (x of y)"]
    lines += ["".join(rnd.choice([*words, *glue]) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in lines], "t string").withColumn("low", searchable(F.col("t")))
    got = df.select("t", *(F.expr(finds("t", "low", p)).alias(f"p{i}") for i, p in enumerate(patterns))).collect()
    wrong = [
        (row["t"], p) for row in got for i, p in enumerate(patterns)
        if row[f"p{i}"] != bool(re.search(p, row["t"], re.IGNORECASE))
    ]
    assert wrong == []
    assert sum(row[f"p{i}"] for row in got for i in range(len(patterns))) > 300
    assert HOT


def test_whole_text_tests_are_never_wrong_in_the_negative(spark):
    from loopledger import scan
    from loopledger.functions.text import may_find

    texts = ["for (x of y) {\nfetch(x)", "FOR (x of y)\nFETCH(x)", "fetch(x)", "for (;;) {}", "", "while(ſ) axıos.get("]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    loops, calls = LOOPS["javascript"], [p.regex for r in BUILTIN_RULES if r.language == "javascript" for p in r.patterns]
    got = [r[0] for r in df.select(F.expr(may_find("code", loops, calls))).collect()]
    for text, may in zip(texts, got):
        lines = text.splitlines()
        found = all(any(re.search(p, line, re.IGNORECASE) for p in ps for line in lines) for ps in (loops, calls))
        assert may or not found
    assert got[2] is False and got[4] is False and got[0] is True
    assert may_find("code", ["a|b"]) == "true"
    units = df.withColumn("declared_language", F.lit("javascript"))
    assert [len(r["findings"]) for r in scan(units).collect()][:5] == [1, 1, 0, 0, 0]
