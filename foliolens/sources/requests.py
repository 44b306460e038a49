"""Requests as JSON text, one per row, parsed into position and child rows.

A request is ``{container: {"positions": {id: {attributes}}, "..lookthroughs":
{id: {...}}}, ...}``; a section may also be columnar, ``{"identifier": [...],
"column": [...]}``. The text is parsed once into a variant; sections and rows
are then unfolded from it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliolens.functions.criteria import literal
from foliolens.plans.reuse import DEALT, FREED, materialize_if_possible, settings
from foliolens.schema import POSITIONS, REQUEST

PARSED = "_parsed"
"""Variant column of requests that are parsed already."""
NAMED = "_named"
"""Whether the text of such a request may name an identifier column."""
READING = FREED | DEALT
"""Settings under which requests are read; their rows may be dealt by request already."""
INJECTED = ("container", "record_type", "identifier", REQUEST)
SQL_TYPES = {"BIGINT": "bigint", "BOOLEAN": "boolean", "STRING": "string", "DOUBLE": "double", "VOID": "string"}


def read_request_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with one request per line; the id is the request's own or its hash."""
    return with_request_ids(spark.read.text(path).withColumnRenamed("value", "request"))


def with_request_ids(requests: DataFrame) -> DataFrame:
    """Rows of ``(request_id, request)`` from rows with a ``request`` text."""
    if REQUEST in requests.columns:
        return requests.select(F.col(REQUEST).cast("string").alias(REQUEST), "request")
    own = F.get_json_object("request", f"$.{REQUEST}")
    return requests.select(F.coalesce(own, F.sha2("request", 256)).alias(REQUEST), "request")


def may_name() -> Column:
    """Texts that may name an identifier column; no other has a columnar section."""
    return F.contains("request", F.lit('"identifier"')) | F.contains("request", F.lit("\\u"))


def _unfold(df: DataFrame, column: str, keep: list[str], key: str, value: str) -> DataFrame:
    """One row per entry of an object."""
    entries = df.sparkSession.tvf.variant_explode(F.col(column).outer())
    return df.lateralJoin(entries).select(*keep, F.col("key").alias(key), F.col("value").alias(value))


def _path(name: str) -> str:
    """Path of an attribute as an SQL text."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"attribute name {name!r} has both kinds of quotes")
    return literal(f"$[{quote}{name}{quote}]")


def is_object(variant: str) -> str:
    """TRUE for a JSON object, as SQL; unlike its schema this doesn't look into the values."""
    return f"(try_variant_get({variant}, '$', 'struct<identifier: variant>') IS NOT NULL)"


def request_sections(requests: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per section: positions or lookthroughs of a container.

    A container is an object with a ``positions`` key; its lookthrough sections
    are the objects whose name contains ``lookthrough``.
    """
    keep = [REQUEST, *(extra or [])]
    parsed = requests.select(*keep, F.expr(PARSED if PARSED in requests.columns else "try_parse_json(request)").alias("_request"))
    containers = _unfold(parsed, "_request", keep, "container", "_container").where(
        "variant_get(_container, '$.positions', 'variant') IS NOT NULL"  # so it is an object
    )
    sections = _unfold(containers, "_container", [*keep, "container"], "record_type", "_section")
    return sections.where(
        f"(record_type = '{POSITIONS}' OR contains(record_type, 'lookthrough')) AND {is_object('_section')}"
    )


def section_names(request: str) -> str:
    """The same sections of a request as a map of containers to section names, as SQL; NULL for other than an object."""
    entries = f"map_entries(try_variant_get({request}, '$', 'map<string, map<string, struct<identifier: boolean>>>'))"
    named = (
        f"e -> (e.key, transform(filter(map_entries(e.value), s -> s.value IS NOT NULL AND "
        f"(s.key = '{POSITIONS}' OR contains(s.key, 'lookthrough'))), s -> s.key))"
    )
    containers = f"transform(filter({entries}, e -> map_contains_key(e.value, '{POSITIONS}')), {named})"
    return f"map_from_entries(filter({containers}, c -> size(c.col2) > 0))"


def section_rows(sections: DataFrame, extra: list[str] | None = None, attributes: str = "variant") -> DataFrame:
    """One row per identifier of the row-wise sections, attributes as a variant or another type.

    A section becomes a map by one cast: entries of an unfolded variant would
    each carry the names of the whole request.
    """
    keep = [REQUEST, *(extra or []), "container", "record_type"]
    rowwise = sections.where("variant_get(_section, '$.identifier', 'variant') IS NULL")
    entries = F.expr(f"explode(try_variant_get(_section, '$', {literal(f'map<string, {attributes}>')}))")
    return rowwise.select(*keep, entries.alias("identifier", "_attributes"))


def attribute_types(rows: DataFrame) -> dict[str, str]:
    """Names and types of the attributes that occur, from one distributed pass."""
    with settings(rows.sparkSession, READING):
        found = rows.selectExpr("schema_of_variant_agg(_attributes) AS s").first()
    return parse_object_schema(found["s"] if found else "")


def parse_object_schema(text: str | None) -> dict[str, str]:
    """Flat types of an ``OBJECT<name: TYPE, ...>`` description."""
    types: dict[str, str] = {}
    if not text or not text.startswith("OBJECT<"):
        return types
    depth, start, body = 0, 0, text[len("OBJECT<") : -1]
    fields = []
    for i, char in enumerate(body):
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            fields.append(body[start:i])
            start = i + 1
    fields.append(body[start:])
    for field in fields:
        name, _, kind = field.strip().partition(": ")
        base = re.match(r"[A-Z]+", kind.strip())
        types[name.strip("`")] = SQL_TYPES.get(base.group(0) if base else "", "double" if kind.startswith("DECIMAL") else "string")
    return types


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(f"record_type = '{POSITIONS}'"), rows.where(f"record_type <> '{POSITIONS}'")


def rowwise_rows(sections: DataFrame, types: dict[str, str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Rows of the row-wise sections with typed attributes."""
    extra = extra or []
    types = attribute_types(section_rows(sections, extra)) if types is None else types
    names = {name: kind for name, kind in types.items() if name not in INJECTED}  # these win over attributes
    fields = ", ".join(f"`{name.replace('`', '``')}`: {kind}" for name, kind in names.items())
    rows = section_rows(sections, extra, f"struct<{fields}>")
    return rows.select(REQUEST, *extra, "container", "record_type", "identifier", *(["_attributes.*"] if names else []))


def read_requests(
    requests: DataFrame, types: dict[str, str] | None = None, extra: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Position rows and lookthrough rows of requests with row-wise sections.

    ``types`` maps attribute names to SQL types; without it they are inferred
    from all attributes that occur. Rows of a batch are stored once where the
    session has a checkpoint folder, so that the text is not parsed for each frame.
    """
    rows = rowwise_rows(request_sections(requests, extra), types, extra)
    if requests.isStreaming:
        return _split(rows)
    with settings(requests.sparkSession, READING):
        return _split(materialize_if_possible(rows))


def columnar_types(sections: DataFrame) -> dict[str, str]:
    """Element types of the columns of columnar sections."""
    found = sections.selectExpr("schema_of_variant_agg(_section) AS s").first()
    text = found["s"] if found else None
    return parse_object_schema(re.sub(r"ARRAY<([^<>]*)>", r"\1", text)) if text else {}


def columnar_rows(sections: DataFrame, types: dict[str, str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Rows of the columnar sections: aligned arrays, one of them ``identifier``."""
    columnar = sections.where("variant_get(_section, '$.identifier', 'variant') IS NOT NULL")
    types = columnar_types(columnar) if types is None else types
    names = [n for n in types if n not in INJECTED]
    arrays = [F.expr("try_variant_get(_section, '$.identifier', 'array<string>')").alias("identifier")]
    arrays += [F.expr(f"try_variant_get(_section, {_path(n)}, 'array<{types[n]}>')").alias(n) for n in names]
    keep = [REQUEST, *(extra or []), "container", "record_type"]
    zipped = F.inline(F.arrays_zip("identifier", *[f"`{n}`" for n in names]))
    return columnar.select(*keep, *arrays).select(*keep, zipped)


def read_columnar_requests(
    requests: DataFrame, types: dict[str, str] | None = None, extra: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Position rows and lookthrough rows of requests with columnar sections."""
    return _split(columnar_rows(request_sections(requests, extra), types, extra))


def inflate_requests(
    requests: DataFrame, types: dict[str, str] | None = None, extra: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of requests that mix row-wise and columnar sections.

    The parsed rows are stored once where the session has a checkpoint folder,
    so that the text is not parsed again for every output.
    """
    # of texts that are not parsed yet only these are parsed a second time
    named = requests.where(F.col(NAMED) if NAMED in requests.columns else may_name())
    rows = rowwise_rows(request_sections(requests, extra), types, extra).unionByName(
        columnar_rows(request_sections(named, extra), types, extra), allowMissingColumns=True
    )
    return _split(materialize_if_possible(rows))


def read_request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Requests arriving as text files, one per line."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_request_ids(reader.load(path).withColumnRenamed("value", "request"))
