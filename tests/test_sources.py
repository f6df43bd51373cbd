"""Reading trees, single files, binary rows, requests; writing results."""

import json
import os
import tracemalloc

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from loopledger import findings_of, list_tree, parse_requests, read_path, read_tree, scan, snippets
from loopledger.plans import report
from loopledger.session import BATCH_BYTES
from loopledger.sources import long_files, tree, tree_source
from loopledger.sources.sinks import write_json
from loopledger.sources.tree import decode_binary

LOOP = "for k in ks:\n    db.get(k)\n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    files = {
        "a.py": LOOP, "_x.js": "fetch('/')", "__init__.py": "", ".hidden.ts": "", "B.PY": LOOP, "notes.txt": "x",
        "pkg/C.java": "class C {}", "pkg/_deep/d.mjs": "", ".dir/e.py": LOOP, "node_modules/f.js": "", "pkg/.github/g.py": "",
        "pkg/venv2/h.py": "", "pkg/crlf.py": "for k in ks:\r\n    db.get(k)\r\n", "noext": "x",
    }
    for name, text in files.items():
        target = base / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode())
    (base / "bad.py").write_bytes(b"x = '\xff'\n")
    os.symlink(base / "nowhere.py", base / "broken.py")
    return str(base)


def names(rows, root):
    return sorted(os.path.relpath(r["path"], root) for r in rows)


def test_tree(spark, root):
    rows = scan(read_tree(spark, root)).collect()
    assert names(rows, root) == sorted([
        "a.py", "_x.js", "__init__.py", ".hidden.ts", "B.PY", "pkg/C.java", "pkg/_deep/d.mjs", ".dir/e.py", "pkg/crlf.py", "bad.py"])
    by = {os.path.relpath(r["path"], root): r for r in rows}
    assert by["bad.py"]["error"].startswith("Could not read file: 'utf-8' codec can't decode byte 0xff in position 5")
    assert by["bad.py"]["language"] == "unknown" and by["bad.py"]["findings"] == []
    assert [f["rule_id"] for f in by["pkg/crlf.py"]["findings"]] == ["PY001"]
    assert by["B.PY"]["language"] == "python"


def test_tree_options(spark, root):
    assert names(list_tree(spark, root, recursive=False).collect(), root) == sorted(
        ["a.py", "_x.js", "__init__.py", ".hidden.ts", "B.PY", "bad.py", "broken.py"])
    got = names(read_tree(spark, root, excludes=["pkg", ".dir"]).collect(), root)
    assert "node_modules/f.js" in got and not any(n.startswith(("pkg", ".dir")) for n in got)
    assert read_tree(spark, root + "/missing").collect() == []
    assert names(read_tree(spark, root, excludes=[]).collect(), root) == names(read_tree(spark, root).collect(), root)


def test_broken_folders_and_other_stores(spark, tmp_path, monkeypatch):
    from loopledger.sources import tree

    (tmp_path / "deep/er/est").mkdir(parents=True)
    (tmp_path / "deep/er/est/a.py").write_text(LOOP)
    assert len(read_tree(spark, f"file://{tmp_path}").collect()) == 1
    rows = [r for b in tree._lister(())(iter([_batch(str(tmp_path / "gone"))])) for r in b.to_pylist()]
    assert [r["kind"] for r in rows] == ["error"] and rows[0]["error"].startswith("Could not read folder:")
    with pytest.raises(ValueError, match="binaryFile"):
        read_tree(spark, "s3a://bucket/tree")


def _batch(path):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])


def test_single_paths(spark, root):
    def one(path):
        return scan(read_path(spark, path)).collect()[0]

    assert one(f"{root}/gone.py")["error"] == f"File not found: {root}/gone.py"
    assert one(root)["error"] == f"Not a file: {root}"
    assert one(f"{root}/node_modules/f.js")["error"] is None
    assert one(f"{root}/notes.txt")["error"] == "Could not detect programming language"


def test_binary_rows(spark):
    df = spark.createDataFrame([("a.py", bytearray(b"x\r\ny\rz")), ("b.py", bytearray(b"\xff"))], "path string, content binary")
    rows = {r["path"]: r for r in decode_binary(df).collect()}
    assert rows["a.py"]["code"] == "x\ny\nz" and rows["a.py"]["error"] is None
    assert rows["b.py"]["code"] is None and "not valid UTF-8" in rows["b.py"]["error"]


def test_requests(spark):
    bodies = [json.dumps(b) for b in (
        {"code": "import db\n" + LOOP, "language": "auto"}, {"code": "import db"}, {"code": "  \n　", "language": "python"}, {"language": "java"},
        {"code": LOOP, "language": "JavaScript"})]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, value string")
    rows = {r["id"]: r for r in scan(parse_requests(df)).collect()}
    assert [rows[i]["error"] for i in range(5)] == [None, None, "No code provided", "No code provided", None]
    assert rows[0]["language"] == "python" and len(rows[0]["findings"]) == 1 and rows[4]["language"] == "javascript"
    odd = spark.createDataFrame([(i, b) for i, b in enumerate(["", None, "null", " {} ", "not json", '{"code": ', '{"code": "x = 1"}'])], "id int, value string")
    errors = {r["id"]: r["error"] for r in parse_requests(odd).collect()}
    assert [errors[i] for i in range(7)] == ["No data provided"] * 4 + ["Request body is not JSON"] * 2 + [None]
    plain = spark.createDataFrame([("x = 1",)], "code string")
    assert scan(snippets(plain, language=None)).collect()[0]["path"] == "<input>"


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([("a.py", LOOP), ("b.py", "x = 1"), ("c.txt", "?")], "path string, code string")
    write_json(scan(df), str(tmp_path / "out"))
    rows = [json.loads(line) for p in (tmp_path / "out/results").glob("*.json") for line in p.read_text().splitlines()]
    by = {r["file_path"]: r for r in rows}
    assert by["a.py"]["findings_count"] == 1 and by["a.py"]["findings"][0]["line_content"] == "db.get(k)"
    assert by["a.py"]["findings"][0]["file_path"] == "a.py" and by["c.txt"]["error"]
    summary = [json.loads(line) for p in (tmp_path / "out/summary").glob("*.json") for line in p.read_text().splitlines()]
    assert summary == [{"total_files": 3, "files_with_issues": 1, "total_findings": 1}]


def test_empty_summary(spark):
    from loopledger import findings_of

    df = spark.createDataFrame([("b.py", "x = 1")], "path string, code string")
    found = findings_of(scan(df))
    row = report.cost_summary(found).collect()[0]
    assert (row["total_per_execution"], row["total_monthly"], row["findings_count"], row["low"]) == (0.0, 0.0, 0, 0)
    assert report.gate(scan(df)).collect()[0]["exit_code"] == 0 and not report.has_findings(scan(df))
    assert found.select(F.col("seq")).count() == 0


def test_units_without_paths_stay_apart(spark):
    df = spark.createDataFrame([(1, LOOP), (2, LOOP + LOOP)], "id int, code string")
    rows = {r["id"]: r for r in report.findings_by_file(scan(snippets(df, language=None).withColumn("declared_language", F.lit("python")))).collect()}
    assert rows[1]["findings_count"] == 1 and rows[2]["findings_count"] == 2 and rows[2]["total_per_execution"] == 0.4


def test_script_tags(spark):
    from loopledger import embedded_scripts

    html = '<SCRIPT type="module">a</Script ><script\nsrc=x></script><scripts>no</scripts><script>b</script>'
    rows = embedded_scripts(spark.createDataFrame([(1, html)], "id int, html string")).collect()
    assert [r["code"] for r in rows] == ["a", "", "b"]


def test_prices_do_not_multiply_findings(spark):
    from loopledger import findings_of
    from loopledger.operators.pricing import price_with, price_with_counts

    results = scan(spark.createDataFrame([(1, "a.py", LOOP)], "file_id long, path string, code string"))
    prices = spark.createDataFrame([("database_read", 1.0), ("database_read", 2.0), ("other", 5.0)], "category string, unit_cost double")
    rows = price_with(findings_of(results), prices).collect()
    assert [r["estimated_cost"]["unit_cost"] for r in rows] == [2.0]
    counts = spark.createDataFrame([(1, 5_000_000_000), (1, 7)], "file_id long, iterations long")
    rows = findings_of(price_with_counts(results, counts)).collect()
    assert [r["estimated_cost"]["iterations"] for r in rows] == [5_000_000_000]


def _tree_files(top):
    found = {
        "a.py": b"x = 1\r\ny = 2\r", "_h/.b.js": b"let a", "_h/_c.ts": "let \u00e9".encode(), "node_modules/d.js": b"x", "q/r/e.JAVA": b"class",
        "q/f.txt": b"n", ".py": b"x", "q/z.py": b"\xff", "q/long.js": b"a" * 5000, "q/empty.js": b"", "q/venv.d/x.py": b"x",
    }
    for path, data in found.items():
        os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
        with open(f"{top}/{path}", "wb") as out:
            out.write(data)
    os.symlink(f"{top}/nowhere", f"{top}/gone.py")
    os.symlink(f"{top}/q", f"{top}/round")


def _store(root):
    """A store of its own: a local folder seen through another file system."""
    return fs.SubTreeFileSystem(root.partition("://")[2], fs.LocalFileSystem()), ""


def test_tree_source_equals_the_tree_reader(spark, tmp_path):
    _tree_files(str(tmp_path))
    tree_source.register(spark)
    want = {(r["path"], r["code"], (r["error"] or "")[:19]) for r in read_tree(spark, str(tmp_path)).collect()}
    for root in (str(tmp_path), f"file://{tmp_path}", str(tmp_path) + "/"):
        for tasks in (1, 64):
            rows = spark.read.format("source_tree").option("tasks", tasks).load(root).collect()
            assert {(r["path"], r["code"], (r["error"] or "")[:19]) for r in rows} == want and len(rows) == len(want) == 7
    short = spark.read.format("source_tree").option("longest", 4999).load(str(tmp_path)).where("error IS NOT NULL").collect()
    assert sorted(os.path.basename(r["path"]) for r in short) == ["long.js", "z.py"]
    assert spark.read.format("source_tree").load(f"{tmp_path}/none").count() == 0
    flat = spark.read.format("source_tree").option("recursive", "false").load(str(tmp_path)).collect()
    assert [os.path.basename(r["path"]) for r in flat] == ["a.py"]


def test_tree_source_reads_other_stores(spark, tmp_path):
    _tree_files(str(tmp_path))
    os.unlink(tmp_path / "round")  # only local trees know links
    tree_source.register(spark)
    rows = spark.read.format("source_tree").option("provider", f"{__name__}:_store").load(f"mine://{tmp_path}").collect()
    want = {r["path"].removeprefix(str(tmp_path)) for r in read_tree(spark, str(tmp_path)).collect()}
    assert {r["path"].removeprefix(f"mine://{tmp_path}") for r in rows} == want
    with pytest.raises(Exception, match="scheme|URI|recogni"):
        spark.read.format("source_tree").load("nosuchstore://x/y").count()


def test_tree_source_takes_over_filters(spark, tmp_path):
    _tree_files(str(tmp_path))
    tree_source.register(spark)
    every = {r["path"] for r in read_tree(spark, str(tmp_path)).collect()}
    base = spark.read.format("source_tree").load(str(tmp_path))
    for sql, keep in (("path LIKE '%.js'", lambda p: p.endswith(".js")), (f"path LIKE '{tmp_path}/q/%'", lambda p: "/q/" in p),
                      ("NOT path LIKE '%/q/%'", lambda p: "/q/" not in p), (f"path = '{tmp_path}/a.py'", lambda p: p.endswith("a.py")),
                      (f"path IN ('{tmp_path}/a.py', 'x')", lambda p: p.endswith("a.py")), ("length(path) > 3", lambda p: True)):
        df = base.where(sql)
        assert {r["path"] for r in df.collect()} == {p for p in every if keep(p)}
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert ("length" in sql) == ("length" in text) and "EndsWith" not in text


def test_folders_that_filters_rule_out_are_not_listed(tmp_path):
    reader = tree_source.TreeReader({"path": str(tmp_path)})
    reader.tests = [("start", f"{tmp_path}/q/r/"), ("not", ("part", "/_h/"))]
    assert [tree_source._may_hold(t, f"{tmp_path}/q") for t in reader.tests] == [True, True]
    assert not tree_source._may_hold(reader.tests[0], f"{tmp_path}/_h") and not tree_source._may_hold(reader.tests[1], f"{tmp_path}/_h")


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50, 10_000])
def test_lines_by_byte_ranges(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(long_files, "PIECE", 5)
    texts = ["", "one", "a\nb\r\nc\rd\n", "\n\n\r\r\n\n", "\u2028x\u2029\x85y\x85", "\x0b\x0c\x1c\x1d\x1eend", "é\u20ac" * 9 + "\n" + "z" * 40,
             "no break at all " * 5, "\r\n" * 8]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.js").write_bytes(t.encode())
    (tmp_path / "bad.js").write_bytes(b"fine\n\xff\nfine")
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    rows = long_files.long_lines(long_files.with_size(paths), step).collect()
    for k, t in enumerate(texts):
        own = sorted((r["line_no"], r["line"]) for r in rows if r["path"].endswith(f"/{k}.js"))
        assert own == list(enumerate(t.splitlines(), 1)), (k, step)
    bad = [r for r in rows if r["path"].endswith("bad.js")]
    assert [r["line_no"] for r in bad] == [None] and "Could not read file" in bad[0]["error"]


def test_a_long_file_spreads_and_has_the_findings_of_a_scan(spark, tmp_path):
    code = "".join(f"for (const k of ks) {{\n  fetch(k{n});\n}}\n" for n in range(3000))
    (tmp_path / "a.js").write_text(code)
    (tmp_path / "b.py").write_text("for k in ks:\n    requests.get(k)\n")
    found = long_files.tree_findings(spark, str(tmp_path), long_bytes=1000, range_bytes=4096)
    whole = findings_of(scan(read_tree(spark, str(tmp_path)))).drop("seq")
    assert sorted(map(str, found.select(whole.columns).collect())) == sorted(map(str, whole.collect())) and found.count() > 3000


def test_reading_holds_a_batch_of_bytes_not_of_wide_strings(tmp_path):
    text = "# one wide character makes a string of four bytes a character: \U0001f600\r\n" + "x = 1  # é\n" * 80_000
    for k in range(40):
        (tmp_path / f"{k}.py").write_text(text, encoding="utf-8", newline="")
    paths = pa.RecordBatch.from_arrays([pa.array([str(tmp_path / f"{k}.py") for k in range(40)])], ["path"])
    tracemalloc.start()
    n = 0
    for batch in tree._read(iter([paths])):
        assert batch["code"][0].as_py() == text.replace("\r\n", "\n") and batch.nbytes <= tree.BYTES_PER_BATCH + (1 << 20)
        n += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40 and peak < 2 * tree.BYTES_PER_BATCH


def test_texts_go_to_python_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    assert int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES
    assert findings_of(scan(spark.createDataFrame([("a.py", LOOP)], "path string, code string"))).count() == 1
    assert int(spark.conf.get(name).rstrip("bB")) <= BATCH_BYTES
