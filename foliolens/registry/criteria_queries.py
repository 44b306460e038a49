"""Criteria operators over the whole position table."""

from __future__ import annotations

from foliolens import datasets
from foliolens.functions.criteria import where_criteria
from foliolens.registry.inputs import INSTRUMENTS, RAW, positions, test, with_tables

P = "priority"
L = "liquidity_type_id"

# name: (criterion, the same condition in SQL, on normalised data?)
CASES: dict[str, tuple[dict, str, bool]] = {
    "P-01_empty": ({}, "TRUE", False),
    "P-01_unknown_operator": (test(L, "Resembles", 3), "TRUE", False),
    "P-02_and": (
        {"and": [test(L, ">", 3), test(P, "==", "2-HIGH")], "or": [test(L, "==", 1)]},
        "COALESCE(liquidity_type_id > 3, FALSE) AND priority IS NOT DISTINCT FROM '2-HIGH'",
        False,
    ),
    "P-03_or": (
        {"or": [test(L, "==", 3), test("upcoming_trade_date", "==", True)]},
        "liquidity_type_id IS NOT DISTINCT FROM 3 OR upcoming_trade_date IS NOT DISTINCT FROM TRUE",
        False,
    ),
    "P-04_not": ({"not": test(L, ">", 3)}, "NOT COALESCE(liquidity_type_id > 3, FALSE)", False),
    "P-05_equal": (test("is_class_position", "=", True), "is_class_position IS NOT DISTINCT FROM TRUE", False),
    "P-05_equal_null": (test(P, "==", None), "priority IS NULL", False),
    "P-06_not_equal": (test(P, "!=", "'5-LOW'"), "priority IS DISTINCT FROM '5-LOW'", False),
    "P-07_greater": (test(L, ">", 4), "COALESCE(liquidity_type_id > 4, FALSE)", False),
    "P-07_greater_equal": (test("weight", ">=", 5.5), "COALESCE(weight >= 5.5, FALSE)", False),
    "P-08_less": (test(L, "<", 4), "COALESCE(liquidity_type_id < 4, TRUE)", False),
    "P-08_less_equal": (test("weight", "<=", 5.5), "COALESCE(weight <= 5.5, TRUE)", False),
    "P-09_in": (test(L, "In", "[4,8, 9]"), "COALESCE(liquidity_type_id IN (4, 8, 9), FALSE)", False),
    "P-09_in_text": (
        test(P, "In", "('1-URGENT','2-HIGH')"),
        "COALESCE(priority IN ('1-URGENT', '2-HIGH'), FALSE)",
        False,
    ),
    "P-09_in_listed_text": (
        test(P, "In", """('1-URGENT', "5-LOW",,'a,b',3-MEDIUM (x), 4-NOT SPECIFIED)"""),
        "COALESCE(priority IN ('1-URGENT', '5-LOW', '', 'a', 'b', '3-MEDIUM (x)', '4-NOT SPECIFIED'), FALSE)",
        False,
    ),
    "P-10_not_in_listed_text": (
        test(P, "NotIn", "['1-URGENT',,'x,5-LOW']"),
        "COALESCE(priority NOT IN ('1-URGENT', '', 'x', '5-LOW'), TRUE)",
        False,
    ),
    "P-10_not_in": (test(L, "NotIn", [4, 8]), "COALESCE(liquidity_type_id NOT IN (4, 8), TRUE)", False),
    "P-11_is_null": (test(L, "IsNull"), "liquidity_type_id = -2147483648", True),
    "P-11_is_null_text": (test(P, "IsNull"), "priority IS NULL", True),
    "P-12_is_not_null": (test(L, "IsNotNull"), "liquidity_type_id <> -2147483648", True),
    "P-13_between": (test(L, "Between", [2, 5]), "COALESCE(liquidity_type_id BETWEEN 2 AND 5, FALSE)", False),
    "P-13_between_text": (
        test("weight", "Between", "fncriteria:2.5:6"),
        "COALESCE(weight BETWEEN 2.5 AND 6, FALSE)",
        False,
    ),
    "P-14_not_between": (
        test(L, "NotBetween", [2, 5]),
        "COALESCE(liquidity_type_id NOT BETWEEN 2 AND 5, TRUE)",
        False,
    ),
    "P-15_like_contains": (test(P, "Like", "'%GEN%'"), "COALESCE(contains(lower(priority), 'gen'), FALSE)", False),
    "P-15_like_prefix": (test(P, "Like", "4-not%"), "COALESCE(starts_with(lower(priority), '4-not'), FALSE)", False),
    "P-15_like_suffix": (test(P, "Like", "%um"), "COALESCE(ends_with(lower(priority), 'um'), FALSE)", False),
    "P-15_like_exact": (test(P, "Like", "5_low"), "COALESCE(lower(priority) = '5_low', FALSE)", False),
    "P-15_like_exact_hit": (test(P, "Like", "'5-LOW'"), "COALESCE(lower(priority) = '5-low', FALSE)", False),
    "P-16_not_like": (test(P, "NotLike", "%GEN%"), "COALESCE(NOT contains(lower(priority), 'gen'), TRUE)", False),
    "P-20_nested_default": (
        test("asset_allocation_id", "In", {"table_name": "t", "column": "c", "operator_type": "==", "value": 1}),
        "TRUE",
        False,
    ),
}


def _case(criterion: dict, normalised: bool):
    def run(spark, folder):
        rows = positions(spark, folder) if normalised else datasets.positions(spark, folder)
        return where_criteria(rows, criterion).select("container", "identifier", "instrument_id")

    return run


def _nested(kind: str):
    def run(spark, folder):
        criterion = test(
            "parent_instrument_id",
            kind,
            {"table_name": "instrument", "column": "instrument_subtype_id", "operator_type": ">", "value": 60},
        )
        tables = {
            "instrument": datasets.instruments(spark, folder).withColumnRenamed("instrument_id", "parent_instrument_id")
        }
        rows = where_criteria(datasets.positions(spark, folder), criterion, nested_tables=tables)
        return rows.select("container", "identifier", "instrument_id")

    return run


def _scope(apply_to: str):
    def run(spark, folder):
        from foliolens.functions.criteria import scope

        return datasets.positions(spark, folder).where(scope(apply_to)).select("container", "identifier")

    return run


COLUMNS = "SELECT container, identifier, instrument_id FROM"
QUERIES = {
    name: (
        _case(criterion, normalised),
        with_tables(f"{COLUMNS} pos WHERE {sql}") if normalised else f"WITH {RAW} {COLUMNS} raw_pos WHERE {sql}",
    )
    for name, (criterion, sql, normalised) in CASES.items()
}
QUERIES["P-20_nested_in"] = (
    _nested("In"),
    f"WITH {RAW}, {INSTRUMENTS} {COLUMNS} raw_pos WHERE parent_instrument_id IN "
    "(SELECT instrument_id FROM instruments WHERE instrument_subtype_id > 60)",
)
QUERIES["P-20_nested_not_in"] = (
    _nested("NotIn"),
    f"WITH {RAW}, {INSTRUMENTS} {COLUMNS} raw_pos WHERE parent_instrument_id NOT IN "
    "(SELECT instrument_id FROM instruments WHERE instrument_subtype_id > 60)",
)
for _apply_to, _sql in {"both": "TRUE", "holding": "container = 'holding'", "reference": "container <> 'holding'"}.items():
    QUERIES[f"P-21_scope_{_apply_to}"] = (
        _scope(_apply_to),
        f"WITH {RAW} SELECT container, identifier FROM raw_pos WHERE {_sql}",
    )
