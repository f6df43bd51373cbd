"""Plan shape and skew: what must hold when the data does not fit a test."""

from pyspark.sql import functions as F

from loopledger import findings_of, scan, scan_distinct
from loopledger.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
LOOP = "for k in ks:\n    db.get(k)\n"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_scan_needs_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(LOOP, "a.py")] * 3, "code string, path string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    results = scan(files)
    kept = results.where((F.size("findings") > 0) & F.col("error").isNull())
    for df in (results, findings_of(results), kept, findings_of(kept).where("rule_id = 'PY001'")):
        text = plan(df)
        assert "Exchange" not in text
        assert text.count("ArrowEvalPython") == 1, "scanned more than once"
    assert kept.count() == 3


def test_columns_are_pruned(spark):
    text = plan(QUERIES["all_findings"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text


def test_copies_scanned_once_with_a_hot_content(spark):
    """A third of all files are one content; its result is spread over salted keys."""
    hot = [(i, f"hot/{i}.py", LOOP, None) for i in range(400)]
    rest = [(1000 + i, f"r/{i}.js", f"for (;;) {{\n  fetch({i % 5});\n}}", None) for i in range(800)]
    same_text = [(5000, "x.txt", LOOP, "java"), (5001, "y.txt", "hello", None)]
    files = spark.createDataFrame(hot + rest + same_text, "file_id long, path string, code string, declared_language string")
    rows = {r["file_id"]: r for r in scan_distinct(files, hot_share=0.2, salts=8).collect()}
    plain = {r["file_id"]: r for r in scan(files).collect()}
    assert len(rows) == len(plain) == 1202
    for key, row in plain.items():
        assert (rows[key]["language"], rows[key]["error"], rows[key]["findings"], rows[key]["path"]) == (
            row["language"], row["error"], row["findings"], row["path"])
    assert rows[0]["copies"] == 400 and rows[1000]["copies"] == 160 and rows[5000]["copies"] == 1


def test_no_unit_is_lost_and_no_text_sorted(spark):
    """Null texts, errors of the reader, absent columns and clashing names go past the join and come back."""
    rows = [("a.py", LOOP, None), ("b.py", None, "Could not read file: x"), ("c.py", None, None), (None, "?", None),
            (None, LOOP, "No code provided"), ("a2.py", LOOP, None), ("a2.py", LOOP, None)]
    files = spark.createDataFrame(rows, "path string, code string, error string").withColumn("copies_of", F.lit(1))
    got = scan_distinct(files)
    text = plan(got)
    assert "SortAggregate" not in text
    want = sorted(str((r["path"], r["language"], r["error"], r["findings"])) for r in scan(files).collect())
    assert sorted(str((r["path"], r["language"], r["error"], r["findings"])) for r in got.collect()) == want
    assert scan_distinct(spark.createDataFrame([(LOOP,), (LOOP,)], "code string")).count() == 2


def test_long_file_in_one_row(spark):
    code = "class A {\n" + "for (Long i : ids) {\n  userDao.get(i);\n}\n" * 40_000
    df = spark.createDataFrame([("A.java", code)], "path string, code string")
    row = scan(df).select(F.size("findings").alias("n"), F.element_at("findings", -1)["line_number"].alias("last")).collect()[0]
    assert (row["n"], row["last"]) == (40_000, 120_000)


def test_deep_python_nesting(spark):
    code = "for x in xs:\n    y = " + "+".join(["db.get(x)"] * 900) + "\n"
    df = spark.createDataFrame([("a.py", code)], "path string, code string")
    assert scan(df).select(F.size("findings").alias("n")).collect()[0]["n"] == 900
