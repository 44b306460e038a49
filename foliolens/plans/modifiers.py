"""The built-in modifiers: what each one removes, keeps or rescales."""

from __future__ import annotations

from foliolens.model import POST, PRE, SCALE_HOLDINGS, SCALE_LOOKTHROUGHS, SCALING, Modifier
from foliolens.schema import INT_NULL


def is_(column: str, value) -> dict:
    return {"column": column, "operator_type": "==", "value": value}


def is_not(column: str, value) -> dict:
    return {"column": column, "operator_type": "!=", "value": value}


def one_of(column: str, value) -> dict:
    return {"column": column, "operator_type": "In", "value": value}


def known(column: str) -> dict:
    return {"column": column, "operator_type": "IsNotNull"}


SOURCE, LIQUIDITY, TRADE = "position_source_type_id", "liquidity_type_id", "trade_type_id"

# Ids of sources, liquidity types, trade types and instrument subtypes.
SIMULATED_SOURCE = 10
SIMULATED_CASH = {"and": [is_(SOURCE, SIMULATED_SOURCE), is_(LIQUIDITY, 5)]}
TRADE_CASH = {"and": [is_(SOURCE, SIMULATED_SOURCE), is_(LIQUIDITY, 6)]}
INITIAL_SOURCES = [1, 9, 11]
ACCRUAL_SUBTYPES = [93, 94]
FUND_SUBTYPES = [27, 38, 66, 81, 84]
SAME_SIMULATED_TRADE = one_of(
    "simulated_trade_id",
    {"table_name": "rule_result", "column": "result", "operator_type": "==", "value": True},
)


def _position(*columns: str) -> dict:
    return {"position_data": list(columns)}


def _exclude(name: str, criteria: dict, *columns: str, overrides: tuple[str, ...] = (), **tables: list[str]) -> Modifier:
    return Modifier(name, PRE, criteria, overrides=overrides, requires={**_position(*columns), **tables})


def _save(name: str, criteria: dict, *columns: str, operator: str = "or", overrides: tuple[str, ...] = ()) -> Modifier:
    return Modifier(name, POST, criteria, operator=operator, overrides=overrides, requires=_position(*columns))


# The catalogue of modifiers, with the columns that each needs.
MODIFIERS: dict[str, Modifier] = {
    m.name: m
    for m in [
        _exclude("exclude_other_net_assets", is_(LIQUIDITY, 2), LIQUIDITY),
        _exclude("exclude_class_positions", is_("is_class_position", True), "is_class_position"),
        _exclude("exclude_non_class_positions", is_("is_class_position", False), "is_class_position"),
        _exclude("exclude_future_in_kind_delivery", is_(TRADE, 1), TRADE),
        _exclude(
            "exclude_future_trades",
            {"and": [is_(TRADE, 4), is_("upcoming_trade_date", True)]},
            TRADE,
            "upcoming_trade_date",
        ),
        _exclude(
            "exclude_future_flows",
            {"and": [is_(LIQUIDITY, 3), is_("upcoming_trade_date", True)]},
            LIQUIDITY,
            "upcoming_trade_date",
        ),
        _exclude("exclude_pending_stop_trades", is_(TRADE, 2), TRADE),
        _exclude("exclude_pending_limit_trades", is_(TRADE, 3), TRADE),
        _exclude("exclude_potential_red_flags", known("red_flag_exclusion_type_id"), "red_flag_exclusion_type_id"),
        _exclude(
            "exclude_simulated_trades",
            {
                "or": [
                    {
                        "and": [
                            is_(SOURCE, SIMULATED_SOURCE),
                            {"or": [is_(LIQUIDITY, INT_NULL), is_not(LIQUIDITY, 5)]},
                        ]
                    },
                    known("simulated_trade_id"),
                ]
            },
            SOURCE,
            LIQUIDITY,
            "simulated_trade_id",
            overrides=("include_all_trade_cash", "include_trade_cash_within_perspective"),
        ),
        _exclude(
            "exclude_simulated_cash",
            SIMULATED_CASH,
            SOURCE,
            LIQUIDITY,
            overrides=("exclude_perspective_level_simulated_cash", "include_simulated_cash"),
        ),
        _exclude("exclude_pending_trades", is_(SOURCE, 9), SOURCE),
        _exclude(
            "exclude_current_flow",
            {"and": [is_(LIQUIDITY, 3), is_("upcoming_trade_date", False)]},
            LIQUIDITY,
            "upcoming_trade_date",
        ),
        _exclude("exclude_manual_corrections", is_(SOURCE, 8), SOURCE),
        _exclude("exclude_initial_positions", one_of(SOURCE, INITIAL_SOURCES), SOURCE),
        _exclude("exclude_blocked_positions", known("position_blocking_type_id"), "position_blocking_type_id"),
        _exclude(
            "exclude_other_net_assets_excl_investment_grade_accrual",
            {
                "and": [
                    is_(LIQUIDITY, 2),
                    {"column": "parent_instrument_subtype_id", "operator_type": "NotIn", "value": ACCRUAL_SUBTYPES},
                ]
            },
            LIQUIDITY,
            "parent_instrument_id",
            parent_instrument=["instrument_subtype_id"],
        ),
        _save("include_all_trade_cash", TRADE_CASH, SOURCE, LIQUIDITY, overrides=("exclude_perspective_level_simulated_cash",)),
        _save(
            "include_trade_cash_within_perspective",
            {"or": [TRADE_CASH, SAME_SIMULATED_TRADE]},
            SOURCE,
            LIQUIDITY,
            "simulated_trade_id",
            overrides=("exclude_perspective_level_simulated_cash",),
        ),
        _save(
            "exclude_trade_cash",
            {"not": TRADE_CASH},
            SOURCE,
            LIQUIDITY,
            operator="and",
            overrides=("exclude_perspective_level_simulated_cash",),
        ),
        _save(
            "exclude_perspective_level_simulated_cash",
            {
                "and": [
                    is_(SOURCE, SIMULATED_SOURCE),
                    is_(LIQUIDITY, 5),
                    one_of("perspective_id", f"({INT_NULL},perspective_id)"),
                ]
            },
            SOURCE,
            LIQUIDITY,
            "perspective_id",
        ),
        _save("include_simulated_cash", SIMULATED_CASH, SOURCE, LIQUIDITY),
        Modifier(SCALE_HOLDINGS, SCALING),
        Modifier(
            SCALE_LOOKTHROUGHS,
            SCALING,
            one_of("instrument_subtype_id", FUND_SUBTYPES),
            requires={"instrument": ["instrument_subtype_id"]},
        ),
    ]
}

DEFAULT_MODIFIERS = ["exclude_perspective_level_simulated_cash"]
