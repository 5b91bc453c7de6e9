"""Declarative selection rules compiled to Columns, evaluated in bulk over context rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe(condition: Column) -> Column:
    """Two-valued logic: a missing value makes a leaf false, also below NOT."""
    return F.coalesce(condition, F.lit(False))


def leaf(field: str, operator: str, value=None, case_sensitive: bool = True, kinds: dict[str, str] | None = None) -> Column:
    """One condition. ``kinds`` maps dotted fields to 'string', 'array' or 'number' (default string)."""
    c, kind = F.col(field), (kinds or {}).get(field, "string")
    if operator == "exists":
        return c.isNotNull()
    if operator == "not_exists":
        return c.isNull()
    fold = kind == "string" and not case_sensitive
    lowered = lambda v: v.lower() if fold and isinstance(v, str) else v
    c = F.lower(c) if fold else c
    v = [lowered(x) for x in value] if isinstance(value, (list, tuple)) else lowered(value)
    if operator in ("equals", "not_equals"):
        return _safe(c == F.lit(v)) if operator == "equals" else _safe(c != F.lit(v))
    if operator in ("contains", "not_contains"):
        if kind == "number":
            return F.lit(False) if operator == "contains" else c.isNotNull()
        held = F.array_contains(c, v) if kind == "array" else c.contains(F.lit(v))
        return _safe(held) if operator == "contains" else _safe(~held)
    if operator in ("in", "not_in"):
        return _safe(c.isin(v)) if operator == "in" else _safe(~c.isin(v))
    if operator == "matches_regex":
        return _safe(F.col(field).cast("string").rlike(("" if case_sensitive else "(?i)") + f"^(?:{value})"))
    compare = {"greater_than": "__gt__", "less_than": "__lt__", "greater_equal": "__ge__", "less_equal": "__le__"}
    if operator in compare:
        return _safe(getattr(F.col(field).try_cast("double"), compare[operator])(F.lit(float(value))))
    raise ValueError(f"unknown operator: {operator}")


def compile_tree(tree, kinds: dict[str, str] | None = None) -> Column:
    """A condition tree as a Column: a list is AND, empty AND true, empty OR false, NOT takes its first child."""
    if isinstance(tree, (list, tuple)):
        tree = {"logic": "AND", "conditions": list(tree)}
    if "logic" not in tree:
        return leaf(tree["field"], tree["operator"], tree.get("value"), tree.get("case_sensitive", True), kinds)
    parts = [compile_tree(x, kinds) for x in tree.get("conditions", [])]
    logic = tree["logic"].upper()
    if logic == "NOT":
        return ~parts[0] if parts else F.lit(True)
    if logic == "OR":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def simple_condition(condition: dict, kinds: dict[str, str] | None = None) -> Column:
    """The short form of a condition: equals, contains, in, greater_than, less_than or matches; a missing field is false."""
    names = {"equals": "equals", "contains": "contains", "in": "in", "greater_than": "greater_than", "less_than": "less_than", "matches": "matches_regex"}
    operator = condition.get("operator", "equals")
    if operator not in names:
        raise ValueError(f"unknown operator: {operator}")
    return leaf(condition["field"], names[operator], condition.get("value"), True, kinds)


def _form(path: str) -> str:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ("json", "yaml", "yml"):
        raise ValueError(f"rules are JSON or YAML files, not {path}")
    return ending


def load_rules(path: str) -> list[dict]:
    """Rules of a file, by its extension: a list, or an object with a list under ``rules``."""
    form = _form(path)
    with open(path, encoding="utf-8") as file:
        if form == "json":
            content = json.load(file)
        else:
            import yaml

            content = yaml.safe_load(file)
    return content["rules"] if isinstance(content, dict) else content


def export_rules(rules: list[dict], path: str) -> None:
    form = _form(path)
    with open(path, "w", encoding="utf-8") as file:
        if form == "json":
            json.dump({"rules": rules}, file, indent=2)
        else:
            import yaml

            yaml.safe_dump({"rules": rules}, file, sort_keys=False)


def with_rule(rules: list[dict], rule: dict) -> list[dict]:
    """The rules with one more; a rule of the same id is replaced. Its condition must compile."""
    fields(rule["conditions"])
    return [r for r in rules if r["id"] != rule["id"]] + [rule]


def fields(tree) -> list[str]:
    """Sorted distinct fields that a condition tree reads."""
    if isinstance(tree, dict) and "logic" not in tree:
        return [tree["field"]]
    inner = tree if isinstance(tree, (list, tuple)) else tree.get("conditions", [])
    return sorted({f for x in inner for f in fields(x)})


def select_rules(rules: list[dict], max_priority: int | None = None, tags: list[str] | None = None) -> list[dict]:
    """Rules up to a priority that carry any of the tags, in order of priority and id."""
    kept = [r for r in rules if (max_priority is None or r["priority"] <= max_priority) and (not tags or set(tags) & set(r.get("tags", [])))]
    return sorted(kept, key=lambda r: (r["priority"], r["id"]))


def matched(contexts: DataFrame, key: str, rules: list[dict], kinds: dict[str, str] | None = None) -> DataFrame:
    """One row for every context and matching rule: key, rule_id, priority, standards. All rules are tested in one scan."""
    hit = [
        F.when(compile_tree(r["conditions"], kinds), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["priority"]).alias("priority"), F.array(*map(F.lit, r["standards"])).alias("standards")))
        for r in rules
    ]
    return contexts.select(key, F.inline(F.filter(F.array(*hit), lambda x: x.isNotNull())))


def resolved(matches: DataFrame, key: str) -> DataFrame:
    """Per context and standard: the lowest priority that selects it and the rule that does so first."""
    each = matches.select(key, "rule_id", "priority", F.explode("standards").alias("standard_id"))
    return each.groupBy(key, "standard_id").agg(F.min("priority").alias("priority"), F.min_by("rule_id", F.struct("priority", "rule_id")).alias("rule_id"))


def conflicts(matches: DataFrame, key: str) -> DataFrame:
    """One row for every later selection of an already selected standard, with the rules that selected it so far."""
    each = matches.select(key, "rule_id", "priority", F.explode("standards").alias("standard_id"))
    order = Window.partitionBy(key, "standard_id").orderBy("priority", "rule_id")
    numbered = each.withColumns({"n": F.row_number().over(order), "rules": F.array_join(F.collect_list("rule_id").over(order), ",")})
    return numbered.where("n > 1").select(key, "standard_id", "rule_id", "n", "rules")


def decision_tree(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, fields) grouped by the set of fields they read."""
    keyed = rules.select("rule_id", F.array_join(F.array_sort(F.array_distinct("fields")), ",").alias("field_key"))
    return keyed.groupBy("field_key").agg(F.array_join(F.array_sort(F.collect_list("rule_id")), ",").alias("rule_ids"), F.count(F.lit(1)).alias("n"))
