"""Pattern matching: first match per rule, and the finding it produces.

Matching yields small hits (rule id, label, place).  Rule wording and prices are
then looked up in two constant maps, so the plan holds each of them once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import PAGINATION_WORDS, PYTHON, Rule
from . import cost
from .text import finds, let, sql_literal


def _overlaps(text: str, pattern: str) -> str:
    """Either contains the other; an empty call part therefore overlaps anything."""
    return f"(contains({text}, {pattern}) OR contains({pattern}, {text}))"


def call_label(rule: Rule, obj: str, method: str) -> str:
    """SQL of the label of the first call pattern matching ``obj.method``, else null."""
    patterns = sql_literal([{"obj": p.obj, "method": p.method, "label": p.label} for p in rule.patterns])
    return f"get(filter({patterns}, p -> {_overlaps(method, 'p.method')} AND {_overlaps(obj, 'p.obj')}), 0).label"


def line_label(rule: Rule, text: str, lowered: str) -> str:
    """SQL of the label of the first line pattern found, else null."""
    cases = (f"WHEN {finds(text, lowered, p.regex)} THEN {sql_literal(p.label)}" for p in rule.patterns)
    return f"CASE {' '.join(cases)} END"


def call_applies(rule: Rule, call: str) -> str:
    """SQL of whether a rule looks at a call: it is in a loop, or its literal has no bound."""
    if rule.needs_loop:
        return f"{call}.in_loop"
    words = sql_literal(list(PAGINATION_WORDS))
    return (
        f"({call}.query_literal <> '' AND NOT exists({words}, w -> contains({call}.query_literal, w)))"
    )


def line_hits(rules: Sequence[Rule], lines: str) -> Column:
    """Hits in an array column of in-loop lines (``no, text, low``), in rule order.

    Written as SQL text: the patterns are many, and text reaches the planner in one go.
    """
    labels = ", ".join(
        f"named_struct('rule_id', {sql_literal(r.rule_id)}, 'label', {line_label(r, 'l.text', 'l.low')})" for r in rules
    )
    return F.expr(
        f"flatten(transform({lines}, l -> transform(filter(array({labels}), h -> h.label IS NOT NULL), "
        "h -> named_struct('rule_id', h.rule_id, 'label', h.label, 'line_number', l.no, "
        "'line_content', l.text, 'hot', false))))"
    )


def call_hits(rules: Sequence[Rule], calls: str, lines: str) -> Column:
    """Hits in an array column of Python calls, in rule order."""
    labels = ", ".join(
        f"named_struct('rule_id', {sql_literal(r.rule_id)}, 'label', "
        f"CASE WHEN {call_applies(r, 'c')} THEN {call_label(r, 'c.obj', 'c.method')} END)"
        for r in rules
    )
    return F.expr(
        f"flatten(transform({calls}, c -> transform(filter(array({labels}), h -> h.label IS NOT NULL), "
        "h -> named_struct('rule_id', h.rule_id, 'label', h.label, 'line_number', c.line_no, "
        f"'line_content', coalesce(get({lines}, c.line_no - 1), ''), 'hot', c.in_hot_path))))"
    )


def rule_map(rules: Sequence[Rule]) -> Column:
    """Rule dimension as a constant map from rule id."""
    return F.expr(sql_literal({
        r.rule_id: {
            "language": r.language, "rule_name": r.name, "category": r.category, "severity": r.severity,
            "sentence": r.sentence, "suggestion": r.suggestion,
            "label_text": r.label_category[0] if r.label_category else None,
            "label_category": r.label_category[1] if r.label_category else None,
        }
        for r in rules
    }, map_keys=True))


def final_severity(base: Column, language: Column, cost_severity: Column) -> Column:
    """Python findings take over a high cost severity; the others keep their own."""
    return F.when((language == PYTHON) & (cost_severity == "high"), cost_severity).otherwise(base)


def to_findings(
    hits: Column, rules: Sequence[Rule] | None, costs: Mapping[str, float], iterations: int | None
) -> Column:
    """Hits with rule wording, severity and price; without ``rules``, a hit carries its rule."""
    by_rule, by_category = rule_map(rules) if rules is not None else None, cost.cost_map(costs, iterations)

    def priced(hit: Column, rule: Column, category: Column, estimate: Column) -> Column:
        base = F.when(hit["hot"] & (rule["severity"] == "medium"), "high").otherwise(rule["severity"])
        return F.struct(
            hit["line_number"].cast("int").alias("line_number"),
            hit["line_content"].alias("line_content"),
            hit["rule_id"].alias("rule_id"),
            rule["rule_name"].alias("rule_name"),
            F.concat_ws(" ", hit["label"], rule["sentence"]).alias("description"),
            final_severity(base, rule["language"], estimate["severity"]).alias("severity"),
            category.alias("category"),
            rule["suggestion"].alias("suggestion"),
            estimate.alias("estimated_cost"),
        )

    def one(hit: Column) -> Column:
        def with_rule(rule: Column) -> Column:
            category = F.when(hit["label"].contains(rule["label_text"]), rule["label_category"]).otherwise(rule["category"])
            return let(
                category,
                lambda cat: let(
                    F.try_element_at(by_category, cat), lambda est: priced(hit, rule, cat, est)
                ),
            )

        return let(hit["rule"] if by_rule is None else F.try_element_at(by_rule, hit["rule_id"]), with_rule)

    return F.transform(hits, one)
