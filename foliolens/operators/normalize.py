"""Names, domains and missing values of incoming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliolens.schema import CONTAINERS, INT_NULL, LOOKTHROUGHS, RECORD_TYPES, REQUEST


def lowercase_columns(df: DataFrame) -> DataFrame:
    names = [c.lower() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns differ only in case: {twice}")
    return df.toDF(*names)


def standardize_ids(df: DataFrame) -> DataFrame:
    """Copies ``instrument_identifier`` over ``instrument_id`` and checks the mandatory column."""
    if "sub_portfolio_id" not in df.columns:
        raise ValueError("column sub_portfolio_id is missing")
    if "instrument_identifier" in df.columns:
        return df.withColumn("instrument_id", F.col("instrument_identifier"))
    return df


def _checked(column: str, domain: tuple[str, ...]) -> Column:
    names = ", ".join(f"'{name}'" for name in domain)
    return F.expr(
        f"CASE WHEN {column} IS NULL OR {column} IN ({names}) THEN {column} "
        f"ELSE string(raise_error(concat('unknown {column}: ', {column}))) END"
    )


def validate_domains(df: DataFrame) -> DataFrame:
    """Fails on a container or record type outside its domain."""
    return df.withColumns(
        {"container": _checked("container", CONTAINERS), "record_type": _checked("record_type", RECORD_TYPES)}
    )


def fill_sentinels(df: DataFrame, weight_labels: list[str]) -> DataFrame:
    """Missing numbers become the sentinel, except in weight columns.

    Whole numbers are widened to long and fractions to double on the way.
    """
    columns = []
    for field in df.schema.fields:
        name = value = f"`{field.name}`"
        if isinstance(field.dataType, T.NumericType):
            kind = "bigint" if isinstance(field.dataType, T.IntegralType) else "double"
            value = f"{kind}({value})"
            if field.name not in weight_labels:
                value = f"coalesce({value}, {kind}({INT_NULL}))"
        columns.append(f"{value} AS {name}")
    return df.selectExpr(*columns)


def with_request(df: DataFrame) -> DataFrame:
    """Adds the constant request id of a run over plain tables."""
    if REQUEST in df.columns:
        return df.withColumn(REQUEST, F.col(REQUEST).cast("string"))
    return df.withColumn(REQUEST, F.lit("all"))


def normalize(df: DataFrame, weight_labels: list[str], record_type: str | None = None) -> DataFrame:
    """All normalisation steps; idempotent.

    ``record_type`` fills a missing column of that name. Child rows without a
    parent column have no parent.
    """
    df = lowercase_columns(df)
    if record_type is not None and "record_type" not in df.columns:
        df = df.withColumn("record_type", F.lit(record_type))
    if record_type == LOOKTHROUGHS and "parent_instrument_id" not in df.columns:
        df = df.withColumn("parent_instrument_id", F.lit(None).cast("long"))
    df = with_request(validate_domains(standardize_ids(df)))
    return fill_sentinels(df, weight_labels)
