"""Streams with state: late and repeated lines, corrected units, totals that appear whole."""

import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loopledger import findings_of, scan
from loopledger.plans.catalogue import QUERIES
from loopledger.plans.report import cost_summary
from loopledger.streaming import stateful
from loopledger.streaming.live import write_stream

JS = "for (const k of ks) {\n  fetch(k);\n}\nfetch(1);\nks.map((k) => {\n  fetch(k); } )\nfetch(2)\n"
JAVA = "for (Long id : ids) {\n  if (x) {\n  userDao.get(id);\n }\n}\nuserDao.get(2);\nwhile (a) {\n}}\nuserDao.get(3);\n"


def stream_of(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_in_any_order_and_twice(spark, tmp_path, batches):
    codes = {1: ("javascript", JS), 2: ("java", JAVA), 3: ("javascript", JS * 3), 4: ("python", "for k in ks:\n    db.get(k)\n")}
    rows = [(f, lang, n, line) for f, (lang, code) in codes.items() for n, line in enumerate(code.split("\n")[:-1], 1)]
    rng = random.Random(batches)
    rng.shuffle(rows)
    parts = [rows[k::batches] for k in range(batches)]
    parts[-1] += rows[:5]  # some lines come again
    stateful.state_store(spark)
    arriving = stream_of(spark, tmp_path, parts, "file_id long, language string, line_no int, line string")
    write_stream(stateful.stream_line_findings(arriving), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    files = spark.createDataFrame([(f, c, lang) for f, (lang, c) in codes.items() if f < 4], "file_id long, code string, declared_language string")
    want = findings_of(scan(files)).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 5


class Kept:
    """State of one key in a dictionary; counts the calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def _of(self, key, *value):
        self.calls += 1
        if value:
            self.values[key] = value[0]
        return self.values.get(key)

    def get(self):
        return self._of("walk")

    def exists(self):
        return self._of("walk") is not None

    def update(self, value):
        self._of("walk", value)

    def containsKey(self, key):
        return self._of(key) is not None

    def getValue(self, key):
        return self._of(key)

    def updateValue(self, key, value):
        self._of(key, value)

    def removeKey(self, key):
        self._of(key)
        self.values.pop(key)


def test_state_is_called_for_blocks_and_not_for_lines():
    n, rng, scope, kept = 5000, random.Random(2), stateful.LoopScope(), Kept()
    scope.init(kept)
    marks = [(f"line {k}", int(k % 10 == 1), int(k % 10 == 5), 0) for k in range(1, n + 1)]
    rows = [(k, *m) for k, m in enumerate(marks, 1)]
    rng.shuffle(rows)
    parts = [rows[k::4] for k in range(4)]
    parts[-1] += rows[:50]
    found = []
    for part in parts:
        frame = pd.DataFrame(part, columns=["line_no", "line", "start", "a", "b"])
        for out in scope.handleInputRows((7, "javascript"), iter([frame]), None):
            found += out["line_no"].tolist()
    assert found == [k for k in range(1, n + 1) if 1 <= k % 10 <= 5]
    assert kept.calls < 100 and list(kept.values) == ["walk"]


def test_a_missing_line_holds_back_what_follows(spark, tmp_path):
    stateful.state_store(spark)
    rows = [(1, "javascript", n, line) for n, line in enumerate(JS.split("\n")[:-1], 1) if n != 5]
    arriving = stream_of(spark, tmp_path, [rows], "file_id long, language string, line_no int, line string")
    write_stream(stateful.stream_line_findings(arriving), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r["line_number"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_of_a_table_in_one_file_or_a_folder(spark, tmp_path, parts):
    docs = spark.createDataFrame([(k, f"text {k}", "s") for k in range(20)], "doc_id long, text string, source string")
    if parts:
        docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["streamed_findings"](spark, str(tmp_path))
    want = QUERIES["all_findings"](spark, str(tmp_path))
    assert got.count() == want.count() > 0
    assert QUERIES["streamed_totals"](spark, str(tmp_path)).count() > 0


UNITS = "file_id long, code string, declared_language string, version long"


def totals_of(table):
    return {r["category"]: r.asDict() for r in table.collect()}


def test_a_corrected_unit_takes_back_what_it_added(spark, tmp_path):
    dear, cheap = "for k in ks:\n    requests.get(k)\n    db.query('select x')\n", "for k in ks:\n    json.dumps(k)\n"
    batches = [[(1, dear, "python", 1), (2, dear, "python", 1), (3, cheap, "python", 1)],
               [(1, cheap, "python", 2), (4, dear, "python", 1)],
               [(2, "x = 1", "python", 2), (2, dear, "python", 1), (3, dear, "python", 0), (5, None, "python", 1)],
               [(1, dear, "python", 1)]]
    stateful.state_store(spark)
    arriving = stream_of(spark, tmp_path, batches, UNITS)
    stateful.write_changes(stateful.stream_changes(arriving), f"{tmp_path}/totals", f"{tmp_path}/state").awaitTermination()
    table = stateful.TotalsTable(spark, f"{tmp_path}/totals")
    last = spark.createDataFrame([(1, cheap, "python", 2), (2, "x = 1", "python", 2), (3, cheap, "python", 1), (4, dear, "python", 1)], UNITS)
    want = cost_summary(findings_of(scan(last)), by=["category"]).drop("disclaimer")
    assert totals_of(table.summary()) == totals_of(want) and table.marks() == [2, 3]


def test_totals_call_the_state_for_entries_and_not_for_units(monkeypatch):
    monkeypatch.setattr(stateful, "ENTRY", 50)
    n, rng, kept, changes = 3000, random.Random(3), Kept(), stateful.Changes("bigint")
    changes.init(kept)
    newest, total = {}, 0
    for batch in range(4):
        rows = [(rng.randrange(n), rng.randint(1, 6), rng.randrange(100)) for _ in range(n)] + [(None, batch, 7)]
        before, now = kept.calls, {}
        for unit, version, x in rows:
            if unit not in now or version > now[unit][0]:
                now[unit] = (version, x)
        newest |= {u: r for u, r in now.items() if u not in newest or r[0] > newest[u][0]}
        given = [Row(unit=u, version=v, place=(u or 0) * 2654435761 >> 7, amounts=[dict.fromkeys(stateful.AMOUNTS, x) | {"category": "a"}]) for u, v, x in rows]
        total += sum(out["monthly"] for out in changes.handleInputRows((1,), iter(given), None))
        assert total == sum(x for _, x in newest.values())
        assert kept.calls - before < 800
    assert kept.values["walk"] == (len(newest), 64) and len(kept.values) <= 65


def test_readers_see_whole_batches_only(spark, tmp_path):
    table = stateful.TotalsTable(spark, f"file://{tmp_path}/t")

    def change(n):
        return spark.createDataFrame([("a", n, 0, 0, 0, 0, 1)], table.read().schema)

    assert table.read().count() == 0 and table.marks() == []
    table.add(change(5), 0)
    table.add(change(7), 1)
    # a batch that was cut off: written, or in part, but without its mark
    change(99).write.parquet(f"{tmp_path}/t/batch-2")
    assert [r["per_execution"] for r in table.read().collect()] == [12]
    table.add(change(1), 2)
    table.add(change(1), 2)  # run again
    assert [r["per_execution"] for r in table.read().collect()] == [13] and table.marks() == [1, 2]
    table.add(change(-13), 3)
    assert table.marks() == [2, 3] and [r["per_execution"] for r in table.read().collect()] == [0]
    assert not (tmp_path / "t" / "batch-1").exists()


def test_amounts_of_a_unit(spark):
    files = spark.createDataFrame([("for k in ks:\n    requests.get(k)\n    db.get(k)\n", "python")], "code string, declared_language string")
    row = stateful.unit_amounts(scan(files)).select(F.explode("amounts").alias("a")).select("a.*").collect()
    want = cost_summary(findings_of(scan(files)), by=["category"]).collect()
    assert {r["category"]: (r["per_execution"], r["monthly"], r["findings"]) for r in row} == {
        r["category"]: (round(r["total_per_execution"] * 100), round(r["total_monthly"] * 100), r["findings_count"]) for r in want}
