"""Domains, sentinels and key columns of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# They must equal the ones the data was produced with.
INT_NULL = -2147483648
HOLDING = "holding"
SELECTED = "selected_reference"
CONTRACTUAL = "contractual_reference"
REFERENCE = "reference"
CONTAINERS = (HOLDING, SELECTED, CONTRACTUAL, REFERENCE)
POSITIONS = "positions"
ESSENTIAL = "essential_lookthroughs"
COMPLETE = "complete_lookthroughs"
LOOKTHROUGHS = "lookthroughs"
RECORD_TYPES = (POSITIONS, ESSENTIAL, COMPLETE, LOOKTHROUGHS)

REQUEST = "request_id"
SPEC = "spec_id"
GROUP_KEYS = [REQUEST, "container"]
PARENT_KEYS = [REQUEST, "container", "parent_instrument_id", "sub_portfolio_id"]
LOOKTHROUGH_KEYS = PARENT_KEYS + ["record_type"]
ROW_KEYS = [
    REQUEST,
    "container",
    "record_type",
    "identifier",
    "instrument_id",
    "parent_instrument_id",
    "sub_portfolio_id",
]
VIEW_KEYS = ["config", "perspective_id"]

FACTOR_SCHEMA = T.StructType(
    [
        T.StructField(REQUEST, T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("instrument_id", T.LongType()),
        T.StructField("parent_instrument_id", T.LongType()),
        T.StructField("sub_portfolio_id", T.LongType()),
        T.StructField("config", T.StringType()),
        T.StructField("perspective_id", T.LongType()),
        T.StructField("factor", T.DoubleType()),
    ]
)


def out(label: str) -> str:
    """Name of the output weight column of a weight label."""
    return f"out_{label}"


def has(df: DataFrame | None, column: str) -> bool:
    return df is not None and column in df.columns


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """The given columns that the frame has, in the given order."""
    names = set(df.columns)
    return [c for c in columns if c in names]
