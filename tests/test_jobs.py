"""The job entry, scans that remember, runs of events."""

import io
import json
import os
import subprocess
import sys

import pytest

from loopledger import scan
from loopledger.__main__ import arguments, run
from loopledger.operators import dedup
from loopledger.operators.pricing import calls_per_run
from loopledger.session import ship

LOOP = "for k in ks:\n    db.get(k)\n"


def shown(rows):
    return sorted(str((r["path"], r["language"], r["error"], r["findings"])) for r in rows)


@pytest.mark.parametrize("broadcast", [dedup.BROADCAST_UNITS, 0])
def test_only_new_contents_are_scanned(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(dedup._scanned, "__defaults__", (broadcast,))
    first = [(f"a{k}.py", LOOP + f"# {k % 7}\n", None) for k in range(30)] + [("x.js", "for (;;) {\n fetch(1);\n}", None), ("e.py", None, "gone")]
    more = [(f"b{k}.py", LOOP + f"# {k % 9}\n", None) for k in range(30)] + [("y.txt", LOOP, None), ("y.js", LOOP, None)]
    schema = "path string, code string, error string"
    store = dedup.ScannedContents(spark, f"file://{tmp_path}/known")
    one, all_ = spark.createDataFrame(first, schema), spark.createDataFrame(first + more, schema)
    assert shown(dedup.scan_incremental(one, f"file://{tmp_path}/known").collect()) == shown(scan(one).collect())
    assert store.runs() == [0] and store.read().count() == 8
    assert shown(dedup.scan_incremental(all_, f"file://{tmp_path}/known").collect()) == shown(scan(all_).collect())
    # two more comments, and one text as two languages
    assert store.runs() == [0, 1] and spark.read.parquet(f"{tmp_path}/known/run-1").count() == 4
    assert shown(dedup.scan_incremental(all_, f"file://{tmp_path}/known").collect()) == shown(scan(all_).collect())
    assert store.runs() == [0, 1]
    # a run that was cut off leaves no mark and is scanned again
    os.unlink(tmp_path / "known" / "marks" / "1")
    assert shown(dedup.scan_incremental(all_, f"file://{tmp_path}/known").collect()) == shown(scan(all_).collect())
    assert store.runs() == [0, 1]


def test_nothing_to_scan(spark, tmp_path):
    empty = spark.createDataFrame([], "path string, code string, error string")
    assert dedup.scan_incremental(empty, f"file://{tmp_path}/known").collect() == []


def test_runs_end_at_a_pause(spark):
    rows = [("a", t) for t in (0, 10, 29, 100, 129, 159, 400)] + [("b", 5), ("b", 5), (None, 1), ("c", None)]
    events = spark.createDataFrame(rows, "u string, m long").selectExpr("u", "timestamp_seconds(m * 60) AS ts")
    got = {r["u"]: (r["runs"], r["calls"], r["iterations"]) for r in calls_per_run(events, "u", "ts", "30 minutes").collect()}
    # 129 to 159 is a pause of just 30 minutes, which does not end a run
    assert got == {"a": (3, 7, 3), "b": (1, 2, 2), None: (1, 1, 1)}


def test_job_over_a_tree_and_a_table(spark, tmp_path):
    os.makedirs(tmp_path / "tree" / "deep")
    (tmp_path / "tree" / "a.py").write_text(LOOP)
    (tmp_path / "tree" / "deep" / "_b.js").write_text("for (;;) {\n  fetch(1);\n}\n")
    (tmp_path / "tree" / "skip.py").write_text(LOOP)
    out = io.StringIO()
    args = arguments(["scan", str(tmp_path / "tree"), "--json", f"{tmp_path}/json", "--findings", f"{tmp_path}/found", "--exclude", "skip"])
    assert run(spark, args, out) == 1
    assert "2 files, 2 findings, 0 errors" in out.getvalue() and " ms" in out.getvalue()
    rows = [json.loads(x) for f in (tmp_path / "json" / "results").glob("*.json") for x in f.read_text().splitlines()]
    assert {os.path.basename(r["file_path"]) for r in rows} == {"a.py", "_b.js"}
    assert spark.read.parquet(f"{tmp_path}/found").count() == 2
    assert run(spark, arguments(["scan", str(tmp_path / "tree"), "--flat", "--exclude", "skip", "--allow", "1"]), out) == 0
    spark.createDataFrame([("x = 1", "a.py")], "code string, path string").write.parquet(f"{tmp_path}/t.parquet")
    assert run(spark, arguments(["scan", f"{tmp_path}/t.parquet"]), out) == 0
    with pytest.raises(SystemExit) as wrong:
        arguments(["scan"])
    assert wrong.value.code == 2


def test_the_package_is_sent_to_executors(spark):
    """Functions of any module of the package run where it is not on the path."""
    ship(spark)
    assert any(name.endswith("loopledger.zip") for name in spark.sparkContext.listFiles)


def test_command_line_from_another_folder(tmp_path):
    (tmp_path / "a.py").write_text(LOOP)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-m", "loopledger", "scan", str(tmp_path)], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=180)
    assert done.returncode == 1 and "1 files, 1 findings, 0 errors" in done.stdout, done.stderr[-2000:]
