"""The rule catalogue: perspectives stored as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliolens.model import RuleBook, stored_rules
from foliolens.operators.skew import join_groups

RULE = (
    "struct<apply_to:string,criteria:string,condition_for_next_rule:string,"
    "is_scaling_rule:boolean,scale_factor:double>"
)
DOCUMENT = (
    "struct<id:bigint,name:string,is_active:boolean,is_compatible_with_sub_setting_service:boolean,"
    f"rules:array<{RULE}>>"
)


def read_perspectives(documents: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row per rule of each perspective, with the flags of the perspective.

    ``documents`` has a text column ``document`` and an ordinal. Documents of one
    id are combined: their flags are AND-ed, their rules follow each other in the
    order of (ordinal, place). Perspectives without rules have one row with NULLs.
    """
    parsed = documents.select(F.col(order).alias("ordinal"), F.from_json("document", DOCUMENT).alias("d")).selectExpr(
        "d.id AS perspective_id",
        "coalesce(d.is_active, true) AS is_active",
        "coalesce(d.is_compatible_with_sub_setting_service, true) AS is_supported",
        "ordinal",
        "d.rules AS rules",
    )
    flags = parsed.groupBy("perspective_id").agg(
        F.bool_and("is_active").alias("is_active"), F.bool_and("is_supported").alias("is_supported")
    )
    rules = parsed.selectExpr("perspective_id", "ordinal", "posexplode_outer(rules) AS (place, rule)").select(
        "perspective_id", "ordinal", "place", "rule.*"
    )
    return join_groups(rules, flags, ["perspective_id"])


def rule_book(perspectives: DataFrame, wanted: list[int]) -> RuleBook:
    """The rules of the wanted perspectives, as settings of a run.

    Only the perspectives a run asks for come to the driver, which needs their
    criteria to write the plan; they are found by a semi-join, so the plan doesn't
    grow with their number.
    """
    ids = perspectives.sparkSession.createDataFrame([(int(i),) for i in sorted(set(wanted))], "perspective_id long")
    rows = perspectives.join(ids, "perspective_id", "left_semi").collect()
    definitions: dict[int, dict] = {}
    for row in sorted(rows, key=lambda r: (r["ordinal"], -1 if r["place"] is None else r["place"])):
        definition = definitions.setdefault(
            row["perspective_id"],
            {"is_active": row["is_active"], "is_supported": row["is_supported"], "rules": []},
        )
        if row["place"] is not None:
            definition["rules"].append(row.asDict())
    return stored_rules(definitions)
