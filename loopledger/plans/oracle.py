"""Standard SQL for the catalogue's queries, for an independent engine.

Rule tables and snippets are the same fixed values; scope, matching, ordering and
totals are formulated differently from the Spark side: running sums or recursion
against folds, interval ends against folds, joins against maps.
"""

from __future__ import annotations

from ..functions import cost
from ..functions.language import DEFAULT_EXCLUDES, EXTENSIONS, INDICATORS
from ..rules import (
    BUILTIN_RULES, HOT, HOT_FUNCTION_WORDS, HOT_LOOKBACK, JAVA, JAVASCRIPT, LANGUAGES, LOOPS,
    PAGINATION_WORDS, PYTHON, CallPattern, LinePattern, Rule, rules_for,
)
from .catalogue import CUSTOM_COSTS, CUSTOM_RULES, MANY_JAVA, MANY_JS
from .corpus import PYTHON_LABELS, SNIPPETS


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(q, row)) + ")" for row in rows)


def any_contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q('(?i)' + pattern)})"


def any_matches(text: str, patterns) -> str:
    return "(" + " OR ".join(matches(text, p) for p in patterns) + ")"


BREAK = q(r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")
SPACE = q("".join(chr(c) for c in range(0x3001) if chr(c).isspace()))


def round2(x: str) -> str:
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


# --- building blocks, each one or more common table expressions ------------------------

SNIPPET = "snippet(tid, ext, comment, body) AS (" + values(
    (i, s.ext, s.comment, s.body) for i, s in enumerate(SNIPPETS)) + ")"


def files_cte(number: str = "d.doc_id") -> str:
    return f"""{SNIPPET},
files AS MATERIALIZED (
  SELECT d.doc_id AS file_id, s.tid,
    'repo/' || d.source || '/' || CASE WHEN d.doc_id % 7 = 3 THEN 'node_modules/'
      WHEN d.doc_id % 11 = 5 THEN '.github/' ELSE '' END || 'f' || d.doc_id || s.ext AS path,
    replace(s.body, '<<BODY>>', s.comment || replace(d.text, chr(10), chr(10) || s.comment)) AS code,
    CASE d.doc_id % 13 WHEN 0 THEN 'Python' WHEN 1 THEN 'cobol' WHEN 2 THEN 'unknown' END AS declared_language,
    length(d.text) - length(replace(d.text, chr(10), '')) AS extra_lines
  FROM documents d JOIN snippet s ON s.tid = {number} % {len(SNIPPETS)})"""


EXT = r"regexp_extract(lower(regexp_extract(path, '[^/]*$')), '^.+(\.[^./]+)$', 1)"
EXT_LANGUAGE = "CASE " + " ".join(
    f"WHEN {EXT} IN ({', '.join(map(q, EXTENSIONS[lang]))}) THEN {q(lang)}" for lang in LANGUAGES) + " END"
SUPPORTED = f"{EXT} IN ({', '.join(q(e) for lang in LANGUAGES for e in EXTENSIONS[lang])})"
EXCLUDED = any_contains("path", DEFAULT_EXCLUDES)


def score(body: str, lang: str) -> str:
    return "(" + " + ".join(f"contains(lower({body}), {q(w)})::INT" for w in INDICATORS[lang]) + ")"


def content_pick(py: str, js: str, java: str) -> str:
    return (f"CASE WHEN {py} = 0 AND {js} = 0 AND {java} = 0 THEN 'unknown' "
            f"WHEN {py} >= {js} AND {py} >= {java} THEN 'python' "
            f"WHEN {js} >= {java} THEN 'javascript' ELSE 'java' END")


def scored_cte(path_known: bool = True) -> str:
    ext = EXT_LANGUAGE if path_known else "NULL"
    pick = content_pick("s_py", "s_js", "s_java")
    return f"""scored AS (
  SELECT *, {score('code', PYTHON)} AS s_py, {score('code', JAVASCRIPT)} AS s_js, {score('code', JAVA)} AS s_java
  FROM files),
src AS MATERIALIZED (
  SELECT file_id, tid, path, code, extra_lines,
    coalesce(CASE WHEN lower(declared_language) IN ('python', 'javascript', 'java') THEN lower(declared_language) END,
      {ext}, {pick}) AS language
  FROM scored)"""


def lines_cte(name: str, source: str, keys: str, text: str) -> str:
    return f"""{name}_parts AS (SELECT {keys}, regexp_split_to_array({text}, {BREAK}) AS p FROM {source}),
{name} AS MATERIALIZED (
  SELECT {keys}, unnest(p) AS line, generate_subscripts(p, 1)::INT AS line_no
  FROM (SELECT {keys}, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM {name}_parts))"""


LINES = lines_cte("lines", "src", "file_id, path, language", "code")

# JavaScript: running sum reflected at zero
JS_SCOPE = f"""js_marks AS (
  SELECT *, {any_matches('line', LOOPS[JAVASCRIPT])}::INT AS start, length(line) - length(replace(line, '}}', '')) AS closes
  FROM lines WHERE language = 'javascript'),
js_sums AS (SELECT *, sum(start - closes) OVER (PARTITION BY file_id ORDER BY line_no) AS s FROM js_marks),
js_depth AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY file_id ORDER BY line_no)) AS depth FROM js_sums),
js_lines AS MATERIALIZED (
  SELECT file_id, path, language, line_no, line, start = 1 AS loop_start,
    coalesce(lag(depth) OVER (PARTITION BY file_id ORDER BY line_no), 0) + start > 0 AS in_loop FROM js_depth)"""

# the same by recursion over the lines of a file
JS_SCOPE_RECURSIVE = f"""js_marks AS MATERIALIZED (
  SELECT *, {any_matches('line', LOOPS[JAVASCRIPT])}::INT AS start, length(line) - length(replace(line, '}}', '')) AS closes
  FROM lines WHERE language = 'javascript'),
js_lines AS (
  SELECT file_id, line_no, start = 1 AS loop_start, start > 0 AS in_loop, greatest(0, start - closes) AS depth
  FROM js_marks WHERE line_no = 1
  UNION ALL
  SELECT m.file_id, m.line_no, m.start = 1, w.depth + m.start > 0, greatest(0, w.depth + m.start - m.closes)
  FROM js_lines w JOIN js_marks m ON m.file_id = w.file_id AND m.line_no = w.line_no + 1)"""

# Java: a loop ends at the first later line whose depth falls below the loop's own
JAVA_SCOPE = f"""java_braces AS (
  SELECT *, {any_matches('line', LOOPS[JAVA])} AS loop_start, regexp_replace(line, '[^{{}}]', '', 'g') AS br
  FROM lines WHERE language = 'java'),
java_marks AS (
  SELECT *, length(replace(br, '}}', '')) - length(replace(br, '{{', '')) AS delta,
    CASE WHEN contains(br, '}}') THEN list_min(list_transform(range(1, length(br) + 1),
      lambda i: length(replace(br[1:i], '}}', '')) - length(replace(br[1:i], '{{', '')))) END AS low
  FROM java_braces),
java_depth AS MATERIALIZED (
  SELECT *, coalesce(sum(delta) OVER (PARTITION BY file_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM java_marks),
java_ends AS (
  SELECT s.file_id, s.line_no AS first, min(u.line_no) AS ended
  FROM (SELECT * FROM java_depth WHERE loop_start) s
  LEFT JOIN (SELECT * FROM java_depth WHERE low IS NOT NULL) u
    ON u.file_id = s.file_id AND u.line_no >= s.line_no AND u.before + u.low < s.before
  GROUP BY ALL),
java_covered AS (
  SELECT DISTINCT d.file_id, d.line_no FROM java_depth d JOIN java_ends e
    ON e.file_id = d.file_id AND d.line_no >= e.first AND (e.ended IS NULL OR d.line_no < e.ended)),
java_lines AS MATERIALIZED (
  SELECT d.file_id, d.path, d.language, d.line_no, d.line, d.loop_start, c.line_no IS NOT NULL AS in_loop
  FROM java_depth d LEFT JOIN java_covered c ON c.file_id = d.file_id AND c.line_no = d.line_no)"""

CALLS = f"""label(tid, seq, line_at, obj, method, in_loop, in_hot_path, query_literal) AS ({values(PYTHON_LABELS)}),
marker(tid, line_at) AS ({values((i, s.body[:s.body.index('<<BODY>>')].count(chr(10)) + 1) for i, s in enumerate(SNIPPETS))}),
calls AS MATERIALIZED (
  SELECT f.file_id, f.path, f.language, l.seq,
    (l.line_at + CASE WHEN l.line_at > m.line_at THEN f.extra_lines ELSE 0 END)::INT AS line_no,
    l.obj, l.method, l.in_loop, l.in_hot_path, l.query_literal
  FROM src f JOIN label l ON l.tid = f.tid JOIN marker m ON m.tid = f.tid WHERE f.language = 'python')"""


def call_patterns_cte(rules: list[Rule]) -> str:
    rows = [(r.rule_id, i, p.obj, p.method, p.label) for r in rules for i, p in enumerate(r.patterns)]
    return f"""call_pattern(rule_id, ord, o, m, label) AS ({values(rows)}),
names AS (SELECT obj, method, count(*) AS n_calls FROM calls GROUP BY ALL),
name_label AS MATERIALIZED (
  SELECT obj, method, n_calls, rule_id, arg_min(label, ord) AS label
  FROM names JOIN call_pattern ON (contains(obj, o) OR contains(o, obj)) AND (contains(method, m) OR contains(m, method))
  GROUP BY ALL)"""


def rule_rows_cte(rules) -> str:
    rows = [(r.rule_id, i, r.name, r.category, r.severity, r.sentence, r.suggestion, r.needs_loop, r.why)
            for i, r in enumerate(rules)]
    return ("rule(rule_id, rule_ord, rule_name, category, severity, sentence, suggestion, needs_loop, why) AS ("
            + values(rows) + ")")


def line_hits(table: str, rules: list[Rule]) -> str:
    parts = []
    for r in rules:
        label = "CASE " + " ".join(f"WHEN {matches('line', p.regex)} THEN {q(p.label)}" for p in r.patterns) + " END"
        parts.append(f"SELECT file_id, path, language, line_no AS pos, line_no, line, {q(r.rule_id)} AS rule_id, "
                     f"{label} AS label, FALSE AS hot FROM {table} WHERE in_loop")
    return " UNION ALL ".join(parts)


def call_hits(rules: list[Rule]) -> str:
    return f"""SELECT c.file_id, c.path, c.language, c.seq AS pos, c.line_no, coalesce(t.line, '') AS line,
  n.rule_id, n.label, c.in_hot_path AS hot
FROM calls c JOIN name_label n ON n.obj = c.obj AND n.method = c.method JOIN rule USING (rule_id)
LEFT JOIN lines t ON t.file_id = c.file_id AND t.line_no = c.line_no
WHERE CASE WHEN rule.needs_loop THEN c.in_loop
  ELSE c.query_literal <> '' AND NOT {any_contains('c.query_literal', PAGINATION_WORDS)} END"""


def found_cte(rules=BUILTIN_RULES, costs=cost.UNIT_COSTS, iterations: int = cost.DEFAULT_ITERATIONS,
              languages=LANGUAGES, path_known: bool = True) -> str:
    """files ... found: every finding with its cost columns and emission order."""
    parts = [files_cte(), scored_cte(path_known), LINES, rule_rows_cte(rules)]
    hits = []
    if PYTHON in languages:
        parts += [CALLS, call_patterns_cte(rules_for(PYTHON, rules))]
        hits.append(call_hits(rules_for(PYTHON, rules)))
    if JAVASCRIPT in languages:
        parts.append(JS_SCOPE)
        hits.append(line_hits("js_lines", rules_for(JAVASCRIPT, rules)))
    if JAVA in languages:
        parts.append(JAVA_SCOPE)
        hits.append(line_hits("java_lines", rules_for(JAVA, rules)))
    category = "r.category"
    for r in rules:
        if r.label_category:
            text, other = r.label_category
            category = f"CASE WHEN h.rule_id = {q(r.rule_id)} AND contains(h.label, {q(text)}) THEN {q(other)} ELSE {category} END"
    prices = {c: float(costs.get(c, 0.0)) for c in {**cost.UNIT_COSTS, **costs}}
    parts.append(f"""price(category, unit_cost) AS ({values((c, p) for c, p in prices.items())}),
hits AS ({' UNION ALL '.join(hits)}),
worded AS (
  SELECT h.*, r.rule_ord, r.rule_name, r.suggestion, r.why, h.label || ' ' || r.sentence AS description,
    {category} AS category, CASE WHEN h.hot AND r.severity = 'medium' THEN 'high' ELSE r.severity END AS severity
  FROM hits h JOIN rule r USING (rule_id) WHERE h.label IS NOT NULL),
costed AS (
  SELECT w.*, p.unit_cost::DOUBLE AS unit_cost, {iterations}::BIGINT AS iterations,
    p.unit_cost::DOUBLE * {iterations} AS raw_exec, p.unit_cost::DOUBLE * {iterations} * 30 AS raw_month
  FROM worded w JOIN price p ON p.category = w.category),
banded AS (
  SELECT *, CASE WHEN raw_month > 100 THEN 'high' WHEN raw_month > 10 THEN 'medium' ELSE 'low' END AS cost_severity
  FROM costed),
found AS MATERIALIZED (
  SELECT file_id, path, language, (row_number() OVER (PARTITION BY file_id ORDER BY pos, rule_ord))::INT AS seq,
    line_no AS line_number, line AS line_content, rule_id, rule_name, description, why,
    CASE WHEN language = 'python' AND cost_severity = 'high' THEN 'high' ELSE severity END AS severity,
    category, suggestion, unit_cost, iterations,
    {round2('raw_exec')} AS per_execution_cost, {round2('raw_month')} AS monthly_cost, cost_severity
  FROM banded)""")
    return "WITH " + ",\n".join(parts)


FLAT = ("seq, line_number, line_content, rule_id, rule_name, description, severity, category, suggestion, "
        "unit_cost, iterations, per_execution_cost, monthly_cost, cost_severity")


def total(field: str) -> str:
    return f"coalesce(sum({field}::DECIMAL(18,2)), 0)::DOUBLE"


TOTALS = f"{total('per_execution_cost')} AS total_per_execution, {total('monthly_cost')} AS total_monthly"


def counts(column: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{s}') AS {s}" for s in ("low", "medium", "high"))


FOUND = found_cte()
ERROR = "CASE WHEN language = 'unknown' THEN 'Could not detect programming language' END"
PER_FILE = "per_file AS (SELECT file_id, count(*)::INT AS n FROM found GROUP BY 1)"
SOURCES = "WITH " + ", ".join([files_cte(), scored_cte()])
SOURCE_LINES = SOURCES + ", " + LINES
ESTIMATE_KIND = ("CASE event_type WHEN 'view' THEN 'serialization' WHEN 'click' THEN 'database_read' "
                 "WHEN 'purchase' THEN 'database_write' ELSE 'api_call' END")
UNIT = "CASE category " + " ".join(f"WHEN {q(c)} THEN {p!r}::DOUBLE" for c, p in cost.UNIT_COSTS.items()) + " ELSE 0.0::DOUBLE END"
PRICED_EVENTS = f"priced_events AS (SELECT event_id, value, {ESTIMATE_KIND} AS category, floor(value * 50)::BIGINT AS calls FROM events)"


def estimate_columns(unit: str, times: str) -> str:
    return (f"{unit} AS unit_cost, {times} AS iterations, {round2(f'{unit} * {times}')} AS per_execution_cost, "
            f"{round2(f'{unit} * {times} * 30')} AS monthly_cost, "
            f"CASE WHEN {unit} * {times} * 30 > 100 THEN 'high' WHEN {unit} * {times} * 30 > 10 THEN 'medium' ELSE 'low' END")


def scope_sql(lang: str, loop_start: bool = True) -> str:
    extra = "loop_start, " if loop_start else ""
    if lang == JAVA:
        return f"{SOURCE_LINES}, {JAVA_SCOPE} SELECT file_id, line_no, {extra}in_loop FROM java_lines"
    if loop_start:
        return (SOURCE_LINES.replace("WITH ", "WITH RECURSIVE ", 1)
                + f", {JS_SCOPE_RECURSIVE} SELECT file_id, line_no, {extra}in_loop FROM js_lines")
    return f"{SOURCE_LINES}, {JS_SCOPE} SELECT file_id, line_no, {extra}in_loop FROM js_lines"


def hot_sql(lang: str) -> str:
    back = HOT_LOOKBACK[lang]
    return f"""{SOURCE_LINES}, framed AS (
  SELECT file_id, line_no, string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no
    ROWS BETWEEN {back} PRECEDING AND 1 PRECEDING) AS context FROM lines WHERE language = '{lang}')
SELECT file_id, line_no, coalesce({any_matches('context', HOT[lang])}, FALSE) AS near_hot_path FROM framed"""


def money(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {x})"


def report_money(x: str) -> str:
    return (f"'₹' || CASE WHEN {x} >= 1000 THEN format('{{:,.2f}}', {x}) WHEN {x} >= 0.01 THEN {money(x, 2)} "
            f"ELSE {money(x, 4)} END")


def library_money(x: str) -> str:
    return (f"'₹' || CASE WHEN {x} >= 1000 THEN format('{{:,.2f}}', {x}) WHEN {x} >= 1 THEN {money(x, 2)} "
            f"WHEN {x} >= 0.01 THEN {money(x, 4)} ELSE {money(x, 6)} END")


def indian_money(x: str) -> str:
    plain = money(x, 2)
    head = f"reverse(rtrim(regexp_replace(reverse({plain}[1:length({plain}) - 6]), '(\\d\\d)', '\\1,', 'g'), ','))"
    return (f"'₹' || CASE WHEN {x} >= 1000 THEN {head} || ',' || right({plain}, 6) WHEN {x} >= 0.01 THEN {plain} "
            f"ELSE {money(x, 4)} END")


def counted_files(select: str, rest: str = "") -> str:
    return f"{FOUND}, {PER_FILE} SELECT {select} FROM src s LEFT JOIN per_file p USING (file_id) {rest}"


STRIPPED = f"trim(line_content, {SPACE})"
CLIPPED = f"CASE WHEN length({STRIPPED}) > 80 THEN {STRIPPED}[1:77] || '...' ELSE {STRIPPED} END"


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["ext_language_counts"] = (
        f"WITH {files_cte()} SELECT {EXT} AS ext, {EXT_LANGUAGE} AS language, count(*) AS n_files FROM files "
        f"WHERE {SUPPORTED} AND NOT {EXCLUDED} GROUP BY ALL")
    sql["content_language"] = (
        "WITH body AS (SELECT 'document' AS kind, doc_id AS id, text AS body FROM documents "
        "UNION ALL SELECT 'page', page_id, html FROM pages), "
        f"s AS (SELECT kind, id, {score('body', PYTHON)} AS python, {score('body', JAVASCRIPT)} AS javascript, "
        f"{score('body', JAVA)} AS java FROM body) "
        f"SELECT *, {content_pick('python', 'javascript', 'java')} AS language FROM s")
    sql["resolved_language"] = f"{SOURCES} SELECT file_id, path, language, {ERROR} AS error FROM src"
    sql["snippet_intake"] = (
        f"WITH t AS (SELECT conv_id, turn, false AS blanked, text AS code FROM conversations UNION ALL "
        f"SELECT conv_id, turn, true, '' FROM conversations WHERE role = 'user'), "
        f"s AS (SELECT *, {score('code', PYTHON)} AS p, {score('code', JAVASCRIPT)} AS j, {score('code', JAVA)} AS a, "
        f"trim(code, {SPACE}) = '' AS blank FROM t) "
        f"SELECT conv_id, turn, blanked, CASE WHEN blank THEN 'unknown' ELSE {content_pick('p', 'j', 'a')} END AS language, "
        f"CASE WHEN blank THEN 'No code provided' WHEN p = 0 AND j = 0 AND a = 0 "
        f"THEN 'Could not detect programming language' END AS error FROM s")
    sql["document_lines"] = (
        f"WITH {lines_cte('l', 'documents', 'doc_id', 'text')} SELECT doc_id, line_no, line FROM l")
    sql["js_loop_scope"] = sql["js_loop_scope_split"] = scope_sql(JAVASCRIPT)
    sql["java_loop_scope"] = sql["java_loop_scope_split"] = scope_sql(JAVA)
    sql["js_loop_scope_folded"] = scope_sql(JAVASCRIPT, loop_start=False)
    sql["java_loop_scope_folded"] = scope_sql(JAVA, loop_start=False)
    sql["js_near_hot_path"], sql["java_near_hot_path"] = hot_sql(JAVASCRIPT), hot_sql(JAVA)

    for name, lang in (("js_findings", JAVASCRIPT), ("java_findings", JAVA), ("py_findings", PYTHON)):
        sql[name] = f"{found_cte(rules_for(lang), languages=(lang,))} SELECT file_id, {FLAT} FROM found"
    for name, whole in (("js_line_findings", "js_findings"), ("java_line_findings", "java_findings"), ("py_call_findings", "py_findings")):
        sql[name] = f"SELECT * EXCLUDE (seq) FROM ({sql[whole]})"
    py004 = [r for r in BUILTIN_RULES if r.rule_id == "PY004"]
    sql["unbounded_queries"] = (
        f"{found_cte(py004, languages=(PYTHON,))} SELECT file_id, line_number, description, severity FROM found")
    site = "file_id, seq, line_no, obj, method, in_loop, in_hot_path, query_literal"
    sql["py_call_sites"] = sql["py_call_sites_lateral"] = f"{SOURCES}, {CALLS} SELECT {site} FROM calls"
    sql["call_name_match"] = (
        f"{SOURCES}, {CALLS}, {call_patterns_cte(rules_for(PYTHON))} SELECT obj, method, n_calls, rule_id, label FROM name_label")
    sql["all_findings"] = sql["streamed_findings"] = f"{FOUND} SELECT path, language, {FLAT} FROM found"
    sql["finding_costs"] = (
        f"{FOUND} SELECT rule_id, severity, count(*) AS n, category, unit_cost, iterations, per_execution_cost, "
        "monthly_cost, cost_severity FROM found GROUP BY ALL")

    sql["streamed_line_findings"] = (
        f"{found_cte(tuple(rules_for(JAVASCRIPT) + rules_for(JAVA)), languages=(JAVASCRIPT, JAVA))} "
        f"SELECT file_id, language, {FLAT.removeprefix('seq, ')} FROM found")

    summary = f"{TOTALS}, {counts('cost_severity')}, count(*) AS findings_count"
    sql["cost_by_category"] = f"{FOUND} SELECT category, {summary}, {q(cost.DISCLAIMER)} AS disclaimer FROM found GROUP BY category"
    sql["cost_summary"] = f"{FOUND} SELECT {summary}, {q(cost.DISCLAIMER)} AS disclaimer FROM found"
    sql["corrected_totals"] = sql["streamed_totals"] = f"{FOUND} SELECT category, {summary} FROM found GROUP BY category"
    sql["severity_histogram"] = f"{FOUND} SELECT {counts('severity')} FROM found"
    sql["scan_counts"] = counted_files(
        "count(*) AS total_files, count(p.n) AS files_with_issues, coalesce(sum(p.n), 0)::BIGINT AS total_findings")
    sql["gate"] = f"{FOUND} SELECT count(*) AS findings_count, (count(*) > 0)::INT AS exit_code FROM found"
    sql["clean_files"] = (
        f"{FOUND} SELECT path, language FROM src s WHERE language <> 'unknown' "
        "AND NOT EXISTS (SELECT 1 FROM found f WHERE f.file_id = s.file_id)")
    sql["findings_by_file"] = (
        f"{FOUND} SELECT path, language, count(*) AS findings_count, min(line_number) AS first_line, {TOTALS} "
        "FROM found GROUP BY path, language")
    joined = f"string_agg(line_number || ':' || rule_id || ':' || {STRIPPED}, '|' ORDER BY seq)"
    sql["nested_results"] = (
        f"{FOUND}, per AS (SELECT file_id, count(*)::INT AS n, {joined} AS t FROM found GROUP BY 1) "
        f"SELECT path, language, coalesce(n, 0) AS findings_count, {ERROR} AS error, coalesce(t, '') AS findings "
        "FROM src LEFT JOIN per USING (file_id)")
    sql["json_results"] = (
        f"{FOUND}, {PER_FILE} SELECT path, language, coalesce(n, 0) AS findings_count, coalesce(n, 0) AS nested_count, "
        f"{ERROR} AS error FROM src LEFT JOIN per_file USING (file_id) UNION ALL "
        "SELECT '*', NULL, sum(n)::INT, count(*)::INT, NULL FROM per_file")
    sql["json_rows"] = (
        f"{FOUND}, {PER_FILE} SELECT s.path, s.language, coalesce(n, 0) AS findings_count, f.rule_id AS first_rule, "
        "f.category AS first_category FROM src s LEFT JOIN per_file USING (file_id) "
        "LEFT JOIN found f ON f.file_id = s.file_id AND f.seq = 1")
    sql["partitioned_findings"] = (
        f"{FOUND} SELECT rule_id, count(*) AS n FROM found WHERE language = 'javascript' GROUP BY 1")

    times = "CASE WHEN calls = 0 THEN 100 ELSE calls END"
    sql["quick_estimate"] = (
        f"WITH {PRICED_EVENTS} SELECT event_id, calls, category, {estimate_columns(UNIT, times)} AS severity FROM priced_events")
    sql["cost_text"] = (
        f"SELECT event_id, {library_money('(value * value)')} AS library_text, {report_money('(value * value)')} AS report_text, "
        f"{indian_money('(value * value * 16)')} AS indian_text, {library_money('(value / 4096)')} AS small_text, "
        f"{report_money('(value / 4096)')} AS small_report_text FROM events")
    cap = "upper({0}[1:1]) || {0}[2:]"
    sql["report_lines"] = (
        f"{FOUND} SELECT path, seq, '[' || upper(severity) || '] ' || rule_name AS headline, 'Rule: ' || rule_id AS rule, "
        f"path || ':' || line_number AS location, {CLIPPED} AS code, description, "
        f"'Estimated: ' || {report_money('per_execution_cost')} || '/execution → ' || {report_money('monthly_cost')} || '/month' AS cost, "
        f"'Recommended Fix: ' || suggestion AS fix, {cap.format('language')} AS language_name, "
        f"{cap.format('severity')} AS severity_name FROM found")
    sql["why_text"] = f"{FOUND} SELECT path, seq, rule_id, coalesce(why, description) AS why FROM found"

    # a tree scan goes by extension: declared languages are not known to the file system
    undeclared = FOUND.replace("CASE WHEN lower(declared_language) IN ('python', 'javascript', 'java') THEN lower(declared_language) END", "NULL")
    tree = f"{undeclared}, {PER_FILE} SELECT path, language, {{error}} AS error, coalesce(n, 0) AS findings_count FROM src LEFT JOIN per_file USING (file_id)"
    sql["code_tree_source"] = sql["code_tree_scan"] = tree.replace("{error}", "NULL::VARCHAR") + f" WHERE {SUPPORTED} AND NOT {EXCLUDED}"
    sql["long_file_findings"] = f"{undeclared} SELECT path, language, {FLAT.removeprefix('seq, ')} FROM found WHERE {SUPPORTED} AND NOT {EXCLUDED}"
    sql["named_files_scan"] = tree.replace("{error}", ERROR) + (
        " UNION ALL SELECT 'repo/' || source || '/missing.py', 'unknown', 'File not found: repo/' || source || '/missing.py', 0 "
        "FROM (SELECT DISTINCT source FROM documents)")
    sql["invalid_text_rows"] = (
        f"{undeclared}, {PER_FILE} SELECT path, CASE WHEN file_id % 5 = 0 THEN 'unknown' ELSE language END AS language, "
        f"CASE WHEN file_id % 5 = 0 THEN 'Could not read file: not valid UTF-8' ELSE {ERROR} END AS error, "
        "CASE WHEN file_id % 5 = 0 THEN 0 ELSE coalesce(n, 0) END AS findings_count FROM src LEFT JOIN per_file USING (file_id)")
    sql["request_scan"] = (
        f"{found_cte(path_known=False)}, {PER_FILE} SELECT file_id, '<input>' AS path, language, {ERROR} AS error, "
        "coalesce(n, 0) AS findings_count FROM src LEFT JOIN per_file USING (file_id)")
    scripts = r"regexp_extract_all(html, '(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>', 1)"
    sql["page_scripts"] = (
        f"SELECT page_id, generate_subscripts(s, 1)::INT AS script_no, unnest(s) AS code FROM "
        f"(SELECT page_id, {scripts} AS s FROM pages)")

    # scripts of pages in place of the corpus
    page_files = f"""scripts AS (SELECT page_id, generate_subscripts(s, 1)::INT AS script_no, unnest(s) AS code
  FROM (SELECT page_id, {scripts} AS s FROM pages)),
files AS (SELECT page_id * 1000 + script_no AS file_id, page_id, script_no, 0 AS tid, '<input>' AS path, code,
  'javascript' AS declared_language, 0 AS extra_lines FROM scripts)"""
    script_scan = found_cte(rules_for(JAVASCRIPT), languages=(JAVASCRIPT,)).replace(files_cte(), page_files)
    sql["page_script_scan"] = (
        f"{script_scan}, {PER_FILE} SELECT f.page_id, f.script_no, s.language, {ERROR} AS error, coalesce(n, 0) AS findings_count "
        "FROM src s JOIN files f USING (file_id) LEFT JOIN per_file USING (file_id)")

    sql["top_files"] = (
        f"{FOUND} SELECT path, count(*) AS findings_count, {TOTALS} FROM found GROUP BY path "
        "ORDER BY total_monthly DESC, path LIMIT 20")
    sql["cost_rollup"] = (
        f"{FOUND} SELECT language, category, rule_id, grouping(language, category, rule_id)::BIGINT AS level, "
        f"count(*) AS findings_count, {TOTALS} FROM found GROUP BY ROLLUP (language, category, rule_id)")
    sql["observed_iterations"] = (
        f"WITH {PRICED_EVENTS}, c AS (SELECT category, count(*) AS calls FROM priced_events GROUP BY 1) "
        f"SELECT category, {estimate_columns(UNIT, 'calls')} AS severity FROM c")
    runs = (
        "marked AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY THEN 0 ELSE 1 END "
        "AS first_ FROM events), numbered AS (SELECT user_id, sum(first_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) "
        "AS run FROM marked), per_run AS (SELECT user_id, run, count(*) AS n FROM numbered GROUP BY 1, 2), "
        "per_user AS (SELECT user_id, count(*) AS runs, CAST(sum(n) AS BIGINT) AS calls, max(n) AS iterations FROM per_run GROUP BY 1)")
    sql["event_runs"] = f"WITH {runs} SELECT user_id, runs, calls, iterations FROM per_user"
    sql["observed_run_costs"] = (
        f"{FOUND}, {runs}, t AS (SELECT f.* EXCLUDE (unit_cost, iterations, per_execution_cost, monthly_cost, cost_severity), "
        "unit_cost AS u, coalesce(p.iterations, 100)::INT AS k FROM found f LEFT JOIN per_user p ON p.user_id = f.file_id), "
        f"e AS (SELECT path, seq, rule_id, language, severity AS base, {estimate_columns('u', 'k')} AS cost_severity FROM t) "
        "SELECT path, seq, rule_id, CASE WHEN language = 'python' AND cost_severity = 'high' THEN 'high' ELSE base END AS severity, "
        "unit_cost, iterations, per_execution_cost, monthly_cost, cost_severity FROM e")
    sql["observed_file_costs"] = (
        f"{FOUND}, seen AS (SELECT user_id, count(*) * 10 AS n FROM events GROUP BY 1), "
        "t AS (SELECT f.* EXCLUDE (unit_cost, iterations, per_execution_cost, monthly_cost, cost_severity), "
        "unit_cost AS u, coalesce(seen.n, 100)::INT AS k FROM found f LEFT JOIN seen ON seen.user_id = f.file_id), "
        f"e AS (SELECT path, seq, rule_id, language, severity AS base, {estimate_columns('u', 'k')} AS cost_severity FROM t) "
        "SELECT path, seq, rule_id, CASE WHEN language = 'python' AND cost_severity = 'high' THEN 'high' ELSE base END AS severity, "
        "unit_cost, iterations, per_execution_cost, monthly_cost, cost_severity FROM e")
    by_length = FOUND.replace(files_cte(), files_cte("length(d.text)"))
    sql["incremental_scan"] = sql["dedup_scan"] = (
        f"{by_length}, {PER_FILE} SELECT file_id, path, language, count(*) OVER (PARTITION BY code, language) AS copies, "
        f"{ERROR} AS error, coalesce(n, 0) AS findings_count FROM src LEFT JOIN per_file USING (file_id)")

    custom = [*BUILTIN_RULES, *CUSTOM_RULES]
    sql["custom_rules"] = (
        f"{found_cte(custom)} SELECT rule_id, description, severity, count(*) AS n, {TOTALS} FROM found GROUP BY ALL")
    given = (
        Rule("P", JAVASCRIPT, "Given Rule", "api_call", "low", "was looked for.", "Look again.", (LinePattern(r"\bfetch\s*\(", "Given call"),)),
        Rule("S", JAVA, "Given Rule", "api_call", "low", "was looked for.", "Look again.", (LinePattern(r"\.findById\s*\(", "Given call"),)))
    sql["table_rules"] = (
        f"{found_cte(given, languages=(JAVASCRIPT, JAVA))}, given_rules AS (SELECT 'P' AS kind, p_partkey AS n FROM part UNION ALL "
        "SELECT 'S', s_suppkey FROM supplier) SELECT kind || g.n AS rule_id, language, description, count(*) AS n, "
        f"{TOTALS} FROM found JOIN given_rules g ON g.kind = rule_id AND g.n % 100 = 0 GROUP BY ALL")
    many = (
        Rule("O", JAVASCRIPT, "Given Rule", "api_call", "low", "was looked for.", "Look again.", (LinePattern(MANY_JS, "Given call"),)),
        Rule("C", JAVA, "Given Rule", "api_call", "low", "was looked for.", "Look again.", (LinePattern(MANY_JAVA, "Given call"),)),
        Rule("P", PYTHON, "Given Rule", "api_call", "low", "was looked for.", "Look again.", (CallPattern("requests", "get", "Given call"),)))
    sql["table_rules_many"] = (
        f"{found_cte(many)}, given_rules AS (SELECT 'O' AS kind, o_orderkey AS n FROM orders WHERE o_orderkey % 1000 = 0 UNION ALL "
        "SELECT 'C', c_custkey FROM customer WHERE c_custkey % 100 = 0 UNION ALL "
        "SELECT 'P', p_partkey FROM part WHERE p_partkey % 100 = 0) "
        f"SELECT kind || g.n AS rule_id, language, description, count(*) AS n, {TOTALS} "
        "FROM found JOIN given_rules g ON g.kind = rule_id GROUP BY ALL")
    sql["call_pattern_overlap"] = (
        f"{SOURCES}, {CALLS}, names AS (SELECT obj, method, count(*) AS n_calls FROM calls GROUP BY 1, 2), "
        "given AS (SELECT DISTINCT n FROM (SELECT l_orderkey * 8 + l_linenumber AS n FROM lineitem UNION ALL SELECT -o_orderkey FROM orders)), "
        "patterns AS (SELECT DISTINCT CASE abs(n) % 5 WHEN 0 THEN '' WHEN 1 THEN 'db' WHEN 2 THEN 'session' WHEN 3 THEN 'request' "
        "ELSE 'svc' || n END AS p_obj, CASE WHEN n % 1000 <> 0 THEN 'op' || n "
        "ELSE CASE abs(n) % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'find' ELSE 'e' END END AS p_method FROM given) "
        "SELECT obj, method, any_value(n_calls) AS n_calls, count(*) AS n_patterns, min(p_obj || '.' || p_method) AS first_pattern "
        "FROM names JOIN patterns ON (contains(method, p_method) OR contains(p_method, method)) "
        "AND (contains(obj, p_obj) OR contains(p_obj, obj)) GROUP BY obj, method")
    sql["custom_costs"] = (
        f"{FOUND}, {PRICED_EVENTS}, given AS (SELECT category, sum(floor(value)::BIGINT)::DOUBLE / count(*) / 1024 AS g "
        "FROM priced_events WHERE category IN ('database_read', 'api_call') GROUP BY 1), "
        "t AS (SELECT f.* EXCLUDE (unit_cost, iterations, per_execution_cost, monthly_cost, cost_severity), "
        "coalesce(g, 0.0)::DOUBLE AS u FROM found f LEFT JOIN given USING (category)) "
        f"SELECT path, seq, rule_id, category, {estimate_columns('u', '100')} AS cost_severity FROM t")
    sql["custom_cost_map"] = (
        f"{found_cte(costs=CUSTOM_COSTS, iterations=250)} SELECT rule_id, severity, count(*) AS n, {TOTALS} FROM found GROUP BY ALL")
    return sql
