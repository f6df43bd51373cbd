"""Loop scope: fold, relational form and a plain brute force agree."""

import random

import pytest
from pyspark.sql import functions as F

from loopledger.operators import scope
from loopledger.operators.lines import explode_lines, lines_with_scope

PARTS = ["for (x) ", "while(1)", "do {", "{", "}", "}{", "{}", "a.map(", "xs.stream().x", "plain", "`${i}`", ""]


def sources(n, longest, seed):
    rnd = random.Random(seed)
    return [
        (i, "\n".join(" ".join(rnd.choice(PARTS) for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(longest))))
        for i in range(n)
    ]


def starts(line, words):
    return any(w in line for w in words)


def brute_js(lines):
    open_loops, out = 0, []
    for line in lines:
        open_loops += starts(line, ["for (", "while(", "do {", ".map("])
        out.append(open_loops > 0)
        open_loops = max(0, open_loops - line.count("}"))
    return out


def brute_java(lines):
    """All loops that are open, by the depth they began at."""
    depth, begun, out = 0, [], []
    for line in lines:
        if starts(line, ["for (", "while(", "do {", ".stream()."]):
            begun.append(depth)
        for ch in line:
            if ch in "{}":
                depth += 1 if ch == "{" else -1
                begun = [d for d in begun if d <= depth]
        out.append(bool(begun))
    return out


@pytest.mark.parametrize("language, relational, brute", [
    ("javascript", scope.js_loop_scope, brute_js), ("java", scope.java_loop_scope, brute_java)])
def test_all_forms_agree(spark, language, relational, brute):
    data = sources(150, 60, 7) + [(1000, sources(1, 2, 1)[0][1])] + [(1001, "\n".join(["for (x) {"] * 300 + ["}"] * 700))]
    files = spark.createDataFrame(data, "file_id long, code string").cache()
    want = {(i, n + 1): flag for i, code in data for n, flag in enumerate(brute(code.splitlines()))}
    folded = {(r["file_id"], r["line_no"]): r["in_loop"] for r in lines_with_scope(files, language).collect()}
    assert folded == want
    for block in (3, 64, 4096):
        rows = relational(explode_lines(files), block=block).collect()
        assert {(r["file_id"], r["line_no"]): r["in_loop"] for r in rows} == want


def test_one_huge_file_is_spread(spark):
    """A file holding nearly all lines is cut into blocks before any window runs."""
    code = "\n".join(["class A {"] + ["for (x) {", " f();", "}"] * 20_000)
    files = spark.createDataFrame([(1, code), (2, "for (;;) {\n}\n")], "file_id long, code string")
    lines = explode_lines(files)
    for fn, brute in ((scope.js_loop_scope, brute_js), (scope.java_loop_scope, brute_java)):
        got = fn(lines).groupBy("file_id", "in_loop").count().collect()
        want = brute(code.splitlines())
        assert {(r["file_id"], r["in_loop"]): r["count"] for r in got}.get((1, True), 0) == sum(want)
    folded = lines_with_scope(files, "java").where("file_id = 1 and in_loop").count()
    assert folded == sum(brute_java(code.splitlines()))


def test_near_hot_path_over_blocks(spark):
    lines = ["x"] * 200
    lines[37] = "function handleIt() {"
    lines[120] = "public void"
    lines[121] = "  processAll"
    data = [(1, "\n".join(lines))]
    table = explode_lines(spark.createDataFrame(data, "file_id long, code string"))
    for block in (32, 50, 4096):
        js = scope.near_hot_path(table, "javascript", block=block).where("near_hot_path").select("line_no").collect()
        assert sorted(r["line_no"] for r in js) == [*range(39, 59), *range(123, 143)]
        java = scope.near_hot_path(table, "java", block=block).where("near_hot_path").select("line_no").collect()
        # "handleIt()" is a call; "public void" + next line is a declaration over a line end
        assert sorted(r["line_no"] for r in java) == [*range(39, 69), *range(123, 152)]
    assert table.count() == 200 and F


def test_a_huge_file_spreads_when_the_input_is_partitioned_by_file(spark):
    """One file of many blocks: its lines reach several tasks, and the text is shuffled once."""
    from loopledger.operators import scope

    code = [(1, k + 1, t) for k, t in enumerate(["for (const x of xs) {", "  fetch(x);", "}", ""] * 600)]
    lines = spark.createDataFrame(code, "file_id long, line_no int, line string").repartition(4, "file_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the file is tiny after all
    try:
        blocks = scope._blocks(lines, "javascript", "file_id", 64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = blocks.select(F.input_file_name().alias("f")).distinct().count()
    assert tasks > 1 and blocks.count() == 38
    found = scope.line_findings(lines, "javascript", block=64)
    text = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "Window" not in text and "documents" not in text
    rows = found.collect()
    assert sorted(r["line_number"] for r in rows) == list(range(2, 2400, 4)) and {r["rule_id"] for r in rows} == {"JS001"}
