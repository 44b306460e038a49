"""Questions about rules: the columns requests need, memberships in other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliolens.model import Modifier
from foliolens.schema import REQUEST

POSITION_DATA = "position_data"
# Join keys that come with the positions, not with the reference table.
MOVED_KEYS = [
    ("parent_instrument", "instrument_id", "parent_instrument_id"),
    ("asset_allocation_analytics_category_v", "analytics_category_id", "asset_allocation_id"),
]


def rule_columns(rules: DataFrame) -> DataFrame:
    """Distinct (perspective, table, column) that the rules of usable perspectives need.

    ``rules`` has one row per rule with its criteria text, as read from the
    rule catalogue.
    """
    needed = F.from_json(F.get_json_object("criteria", "$.required_columns"), "map<string,array<string>>")
    return (
        rules.where("is_active AND is_supported")
        .select("perspective_id", F.explode(needed).alias("table", "columns"))
        .select("perspective_id", "table", F.explode("columns").alias("column"))
        .distinct()
    )


def custom_rule_columns(requests: DataFrame, text: str = "request") -> DataFrame:
    """Distinct (request, perspective, table, column) that rules sent along with JSON requests need."""
    sent = F.from_json(F.get_json_object(text, "$.custom_perspective_rules"), "map<string,string>")
    rules = F.from_json(F.get_json_object("body", "$.rules"), "array<string>")
    criteria = F.get_json_object("rule", "$.criteria")
    needed = F.from_json(F.get_json_object(criteria, "$.required_columns"), "map<string,array<string>>")
    return (
        requests.select(REQUEST, F.explode(sent).alias("perspective_id", "body"))
        .select(REQUEST, F.col("perspective_id").cast("long"), F.explode(rules).alias("rule"))
        .select(REQUEST, "perspective_id", F.explode(needed).alias("table", "columns"))
        .select(REQUEST, "perspective_id", "table", F.explode("columns").alias("column"))
        .distinct()
    )


def modifier_columns(rows: DataFrame, modifiers: dict[str, Modifier]) -> DataFrame:
    """The (table, column) pairs of the modifiers named in ``rows``.

    The built-in catalogue has a fixed, small size and is kept in the plan.
    """
    entries = ", ".join(
        f"'{m.name}', array({', '.join(pairs)})"
        for m in modifiers.values()
        if (pairs := [f"struct('{t}' AS table, '{c}' AS column)" for t, cs in m.requires.items() for c in cs])
    )
    return rows.select(REQUEST, F.expr(f"inline(map({entries})[modifier])"))


def required_columns(
    requests: DataFrame,
    rules: DataFrame,
    modifiers: dict[str, Modifier],
    defaults: list[str],
    custom: DataFrame | None = None,
) -> DataFrame:
    """Distinct (request, table, column) that requests need, in lower case.

    ``requests`` has one row per (request, config, perspective, modifier); the
    modifier may be NULL. ``rules`` comes from ``rule_columns``; ``custom``, from
    ``custom_rule_columns``, takes the place of stored rules with the same id. Overridden
    modifiers count as well.
    """
    asked = requests.select(REQUEST, "perspective_id").distinct()
    stored = asked if custom is None else asked.join(custom, [REQUEST, "perspective_id"], "left_anti")
    by_rule = stored.join(rules, "perspective_id").select(REQUEST, "table", "column")
    if custom is not None:
        by_rule = by_rule.unionByName(asked.join(custom, [REQUEST, "perspective_id"]).select(REQUEST, "table", "column"))
    named = requests.select(REQUEST, "modifier").where(F.col("modifier").isNotNull())
    if defaults:
        names = F.array(*[F.lit(d) for d in defaults])
        named = named.unionByName(requests.select(REQUEST).distinct().select(REQUEST, F.explode(names).alias("modifier")))
    by_modifier = modifier_columns(named.distinct(), modifiers)
    always = requests.select(REQUEST, F.lit(POSITION_DATA).alias("table"), F.lit("sub_portfolio_id").alias("column"))
    rows = by_rule.unionByName(by_modifier).unionByName(always)
    table, column = F.lower("table"), F.lower("column")
    table = F.when(table == "instrumentinput", POSITION_DATA).otherwise(table)
    rows = rows.select(REQUEST, table.alias("table"), column.alias("column"))
    new_table, new_column = F.col("table"), F.col("column")
    for moved, key, position_key in MOVED_KEYS:
        match = (F.col("table") == moved) & (F.col("column") == key)
        new_table = F.when(match, POSITION_DATA).otherwise(new_table)
        new_column = F.when(match, position_key).otherwise(new_column)
    return rows.select(REQUEST, new_table.alias("table"), new_column.alias("column")).distinct()


NODES = "array<struct<path:string,node:string>>"
LISTED = """CASE WHEN get_json_object({0}, '$.and') IS NOT NULL THEN from_json(get_json_object({0}, '$.and'), 'array<string>')
     WHEN get_json_object({0}, '$.or') IS NOT NULL THEN from_json(get_json_object({0}, '$.or'), 'array<string>')
     WHEN get_json_object({0}, '$.not') IS NOT NULL THEN array(get_json_object({0}, '$.not')) END"""
LINK = """CASE WHEN get_json_object({0}, '$.and') IS NOT NULL THEN 'and'
     WHEN get_json_object({0}, '$.or') IS NOT NULL THEN 'or' ELSE 'not' END"""


def criteria_leaves(rules: DataFrame, keys: list[str], criteria: str = "criteria") -> DataFrame:
    """Every simple criterion of each rule, with its path in the rule.

    Each row unfolds its own criterion, a level at a time, by an expression: no
    action, one read, no shuffle. A criterion has no more levels than its text has
    connectors, so the deepest one costs the others nothing.
    """
    text = f"`{criteria}`"
    levels = f"sequence(0, size(split({text}, '\"(and|or|not)\"')) - 1)"
    inner = f"transform({LISTED.format('n.node')}, (c, j) -> named_struct('path', concat_ws('.', n.path, {LINK.format('n.node')}, string(j)), 'node', c))"
    leaves = f"""aggregate({levels},
        named_struct('open', CAST(array(named_struct('path', '', 'node', {text})) AS {NODES}), 'done', CAST(array() AS {NODES})),
        (s, level) -> named_struct(
            'open', CAST(flatten(transform(filter(s.open, n -> {LISTED.format('n.node')} IS NOT NULL), n -> {inner})) AS {NODES}),
            'done', concat(s.done, filter(s.open, n -> {LISTED.format('n.node')} IS NULL))),
        s -> s.done)"""
    found = rules.where(F.col(text).isNotNull()).select(*keys, F.expr(f"inline({leaves})"))
    return found.select(
        *keys,
        F.regexp_replace("path", r"^\.", "").alias("path"),
        F.get_json_object("node", "$.column").alias("column"),
        F.get_json_object("node", "$.operator_type").alias("operator_type"),
        F.get_json_object("node", "$.value").alias("value"),
    )


def nested_criteria_report(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Memberships in other tables, per perspective and place: ``rule_result`` is not one."""
    keys = keys or ["perspective_id", "ordinal", "place"]
    return (
        criteria_leaves(rules.where("is_active AND is_supported"), keys)
        .where("operator_type IN ('In', 'NotIn') AND startswith(value, '{')")
        .where("coalesce(lower(get_json_object(value, '$.table_name')), '') <> 'rule_result'")
        .select(*keys, "path", F.col("column").alias("outer_column"), "operator_type", F.col("value").alias("inner_criteria"))
    )
