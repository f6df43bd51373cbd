"""One row per case: snippets in, rules out."""

import pytest


def rules(row):
    return [f["rule_id"] for f in row["findings"]]


def py(code, path="a.py"):
    return (path, code, None)


CASES = {
    # name: (path, code, declared) -> expected rules (None: only checked below)
    "py database": (py("for k in keys:\n    dynamodb.get_item(Key=k)\n"), ["PY001"]),
    "py request": (py("for u in users:\n    requests.get(f'https://x/{u}')\n"), ["PY002"]),
    "py serialize": (py("for x in xs:\n    json.dumps(x)\n"), ["PY003"]),
    "py comprehension": (py("r = [db.get(i) for i in ids]\n"), ["PY001"]),
    "py no loop": (py("dynamodb.get_item(k)\nrequests.get(u)\njson.dumps(d)\n"), []),
    "py unbounded": (py("cursor.execute('SELECT * FROM t')\n"), ["PY004"]),
    "py bounded": (py("cursor.execute('SELECT * FROM t LIMIT 5')\n"), []),
    "py bounded by part of a word": (py("cursor.execute('SELECT homepage FROM t')\n"), []),
    "py several rules": (py("for u in us:\n    session.get('/x')\n"), ["PY001", "PY002"]),
    "py unbounded first": (py("for u in us:\n    session.execute('select a')\n"), ["PY004", "PY001"]),
    "py async for": (py("async def f():\n    async for x in y:\n        db.get(x)\n"), []),
    "py bare call": (py("for x in xs:\n    e(x)\n"), ["PY001", "PY002"]),
    "py syntax error": (py("for x in :\n  db.get(x)\n"), []),
    "py subscript owner": (py("for x in xs:\n    conns[0].execute('select 1')\n"), []),
    "py function in loop": (py("for x in xs:\n    def f():\n        db.query(x)\n"), ["PY001"]),
    "js fetch": (("a.js", "for (const i of ids) {\n  const r = await fetch(`/u/${i}`);\n}\n", None), ["JS001"]),
    "js axios": (("a.js", "for (let i = 0; i < n; i++) {\n  await axios.get(u[i]);\n}\n", None), ["JS001"]),
    "js mongo": (("a.js", "xs.forEach(async x => {\n  await db.collection('u').findOne({a: x});\n});\n", None), ["JS002"]),
    "js parse": (("a.js", "for (const x of xs) {\n  JSON.parse(x);\n}\n", None), ["JS004"]),
    "js no loop": (("a.js", "fetch('/a');\nJSON.parse(t);\n", None), []),
    "js promise": (("a.js", "for (const x of xs) {\n  new Promise(r => r());\n  async () => 1;\n  await Promise.all(ps);\n}\n", None), ["JS003", "JS003"]),
    "js closing line counts": (("a.js", "while (a) {\n}  fetch('/a');\nfetch('/b');\n", None), ["JS001"]),
    "js template literal ends loop": (("a.js", "for (;;) {\n  log(`${x}`);\n  fetch('/a');\n}\n", None), []),
    "js find is loop and query": (("a.js", "const r = Users.find({});\n", None), ["JS002"]),
    "js one line, three rules": (("a.ts", "xs.map(async (x) => fetch(x).then(JSON.parse(x)))\n", None), ["JS001", "JS003", "JS004"]),
    "js mixed case": (("a.JS", "FOR (x) FETCH ('/a')\n", None), ["JS001"]),
    "java spring": (("A.java", "for (Long id : ids) {\n  repository.findById(id);\n}\n", None), ["JAVA001"]),
    "java rest": (("A.java", "for (Long id : ids) {\n  restTemplate.getForObject(u);\n}\n", None), ["JAVA002"]),
    "java mapper": (("A.java", "for (T t : ts) {\n  objectMapper.writeValueAsString(t);\n}\n", None), ["JAVA003"]),
    "java jdbc": (("A.java", "for (T t : ts) {\n  jdbcTemplate.queryForObject(q, t);\n}\n", None), ["JAVA004"]),
    "java aws": (("A.java", "while (x) {\n  dynamoDb.getItem(r); }\n", None), ["JAVA005"]),
    "java no loop": (("A.java", "repository.findAll();\nrestTemplate.exchange(u);\n", None), []),
    "java stays open to enclosing block": (
        ("A.java", "class A {\n void f() {\n  for (;;) {\n  }\n  userDao.get(1);\n }\n void g() { userDao.get(2); }\n}\n", None),
        ["JAVA001"]),
    "java result set": (("A.java", "while (resultSet.next()) {\n}\n", None), []),
    "java closing line does not count": (("A.java", "{\n for (;;) {\n} } dao.find(1);\n", None), []),
    "java brace pair across": (("A.java", "{\n for (;;) {\n }{ dao.find(1);\n }}\n dao.find(2);\n", None), ["JAVA001"]),
    "declared beats extension": (("a.js", "for k in ks:\n    db.get(k)\n", "PYTHON"), ["PY001"]),
    "invalid declaration ignored": (("a.py", "for k in ks:\n    db.get(k)\n", "cobol"), ["PY001"]),
    "form feed shifts text only": (py("x = 1\n\f\nfor k in ks:\n    db.get(k)\n"), ["PY001"]),
}


@pytest.fixture(scope="module")
def scanned(scan_rows):
    return scan_rows({name: case for name, (case, _) in CASES.items()})


@pytest.mark.parametrize("name", CASES)
def test_rules(scanned, name):
    assert rules(scanned[name]) == CASES[name][1]
    assert scanned[name]["error"] is None


def test_finding_fields(scanned):
    f = scanned["py request"]["findings"][0]
    assert f["line_number"] == 2 and f["line_content"] == "    requests.get(f'https://x/{u}')"
    assert f["rule_name"] == "API Call in Loop" and f["severity"] == "high"
    assert f["description"] == "HTTP GET request called inside a loop. Each iteration makes an external API call."
    cost = f["estimated_cost"]
    assert (cost["per_execution_cost"], cost["monthly_cost"], cost["severity"]) == (1.0, 30.0, "medium")


def test_line_text_comes_from_text_lines(scanned):
    # the parser numbers lines by line feeds, the text is cut at form feeds as well
    f = scanned["form feed shifts text only"]["findings"][0]
    assert f["line_number"] == 4 and f["line_content"] == "for k in ks:"


def test_dynamodb_is_database(scanned):
    assert scanned["java aws"]["findings"][0]["category"] == "database_read"


def test_hot_function_raises_medium(scan_rows):
    got = scan_rows({
        "hot": py("def handle(xs):\n    for x in xs:\n        json.dumps(x)\n"),
        "inner": py("def handle(xs):\n    def plain():\n        return [json.dumps(x) for x in xs]\n"),
        "decorator": py("@cache(cursor.execute('select a'))\ndef run(): pass\n"),
    })
    assert [f["severity"] for f in got["hot"]["findings"]] == ["high"]
    assert [f["severity"] for f in got["inner"]["findings"]] == ["medium"]
    assert [f["severity"] for f in got["decorator"]["findings"]] == ["high"]


def test_language_and_errors(scan_rows):
    got = scan_rows({
        "py": ("x/test.py", "", None), "js": ("test.mjs", "", None), "java": ("Test.JAVA", "", None),
        "py content": (None, "def main():\n    import os\n", None),
        "js content": (None, "const a = require('x');\n", None),
        "java content": (None, "public class A { private int b; }\n", None),
        "tie": (None, "import a", None), "none": ("a.txt", "hello", None), "dotfile": (".py", "zzz", None),
        "auto": (None, "self.x = 1", "auto"), "empty": ("a.txt", "", None),
    })
    assert {n: r["language"] for n, r in got.items()} == {
        "py": "python", "js": "javascript", "java": "java", "py content": "python", "js content": "javascript",
        "java content": "java", "tie": "python", "none": "unknown", "dotfile": "unknown", "auto": "python",
        "empty": "unknown",
    }
    assert got["none"]["error"] == "Could not detect programming language" and got["py"]["error"] is None
    assert got["none"]["findings"] == []


def test_custom_rules_and_costs(scan_rows, spark):
    table = spark.createDataFrame(
        [("JS9", "javascript", "Logging", "logging", "low", "in a loop.", "Log less.", 1, r"console\s*\.|logger", None, None, "log call"),
         ("PY9", "python", "Sleep", "api_call", "low", "in a loop.", "Do not.", 1, None, "time", "sleep", "sleep")],
        "rule_id string, language string, rule_name string, category string, severity string, sentence string, "
        "suggestion string, ord int, regex string, obj string, method string, label string")
    got = scan_rows(
        {"js": ("a.js", "for (;;) { LOGGER.info(1) }", None), "py": py("while 1:\n    time.sleep(1)\n")},
        rule_table=table, unit_costs={"logging": 1.5, "api_call": 2.0}, iterations=10)
    js = got["js"]["findings"][0]
    assert (js["rule_id"], js["description"], js["severity"]) == ("JS9", "log call in a loop.", "low")
    assert js["estimated_cost"]["monthly_cost"] == 450.0 and js["estimated_cost"]["severity"] == "high"
    # a high cost severity replaces the severity of Python findings only
    assert [(f["rule_id"], f["severity"]) for f in got["py"]["findings"]][-1] == ("PY9", "high")


def test_rule_tables_are_checked_and_may_be_large(scan_rows, spark):
    columns = ("rule_id string, language string, rule_name string, category string, severity string, sentence string, "
               "suggestion string, ord int, regex string, label string")
    good = [(f"T{n // 2}", "java", "n", "api_call", "low", "s.", "t", n % 2, rf"call{n}\s*\(", f"c{n}") for n in range(6000)]
    cases = {"a": ("a.java", "for (;;) {\n call7( call6(\n call5999 (\n}", None)}
    got = scan_rows(cases, rules=(), rule_table=spark.createDataFrame(good, columns))["a"]["findings"]
    assert [(f["line_number"], f["rule_id"], f["description"]) for f in got] == [(2, "T3", "c6 s."), (3, "T2999", "c5999 s.")]
    for change, said in (({1: "Java"}, "unknown language Java"), ({4: "urgent"}, "unknown severity"), ({8: None}, "no regex"), ({0: None}, "null"),
                         ({7: 0, 0: "T0"}, "twice")):
        bad = [change.get(k, v) for k, v in enumerate(good[1])]
        with pytest.raises(Exception, match=said):
            scan_rows(cases, rule_table=spark.createDataFrame([good[0], tuple(bad)], columns))
