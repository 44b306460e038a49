"""Sources, normalisation, reference joins and unions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from foliolens import datasets
from foliolens.operators.normalize import fill_sentinels, lowercase_columns, standardize_ids, validate_domains
from foliolens.operators.reference import (
    join_as_of,
    ReferenceTables,
    allocation_ids,
    instrument_ids,
    join_asset_allocation,
    join_instrument,
    join_parent_instrument,
    parent_ids,
    read_as_of,
    read_asset_allocation,
    read_parent_reference,
    read_reference,
)
from foliolens.plans.requests import process_requests
from foliolens.registry.inputs import (
    ALL_LABELS,
    ALLOCATIONS,
    CATEGORIES,
    INSTRUMENTS,
    RAW,
    lookthroughs,
    positions,
    with_tables,
)
from foliolens.schema import CONTAINERS
from foliolens.sources.requests import columnar_types, read_columnar_requests, read_requests, request_sections
from foliolens.sources.rules import read_perspectives
from foliolens.sources.tables import from_tables, union_containers

ORDERS_PER_REQUEST = 50
TYPES = {
    "instrument_id": "bigint",
    "sub_portfolio_id": "bigint",
    "trade_type_id": "bigint",
    "parent_instrument_id": "bigint",
    "liquidity_type_id": "bigint",
    "is_class_position": "boolean",
    "initial_weight": "double",
    "weight": "double",
}
SPEC = (
    '"position_weight_labels":["initial_weight"],"lookthrough_weight_labels":["weight"],'
    '"perspective_configurations":{"main":{"-1":["scale_holdings_to_100_percent"],"-2":null}},'
    '"custom_perspective_rules":{"-1":{"rules":[{"apply_to":"both","criteria":'
    '{"column":"trade_type_id","operator_type":"<=","value":3}}]},'
    '"-2":{"rules":[{"apply_to":"both","is_scaling_rule":true,"scale_factor":50,"criteria":'
    '{"column":"liquidity_type_id","operator_type":">","value":4}}]}}'
)


def request_rows(spark, folder) -> DataFrame:
    """Rows of the JSON requests below: each request has a block of order keys.

    Order keys are unique, so a request holds at most ORDERS_PER_REQUEST orders. Table rows are
    dealt by request, and not again with the texts that are made of them.
    """

    def of_order(key):
        return F.concat(F.lit("r"), F.floor(key / ORDERS_PER_REQUEST).cast("string"))

    block = F.col(datasets.BLOCK)
    pos = datasets.positions(spark, folder, block=of_order)
    lt = datasets.lookthroughs(spark, folder, block=of_order)
    names = [n for n in TYPES if n != "parent_instrument_id"]
    positions_part = pos.select(
        block.alias("request_id"), "container", F.lit("positions").alias("section"), "identifier",
        F.to_json(F.struct(*names)).alias("attributes"),
    )
    # one child per (identifier): lines may repeat, objects may not
    children = lt.groupBy(datasets.BLOCK, "parent_instrument_id", "container", "record_type", "identifier").agg(
        *[F.max(n).alias(n) for n in names]
    )
    child_part = children.select(
        block.alias("request_id"), "container", F.col("record_type").alias("section"), "identifier",
        F.to_json(F.struct(*names, "parent_instrument_id")).alias("attributes"),
    )
    return positions_part.unionByName(child_part)


def _joined(keys: list[str], name: str, body: str, rows: DataFrame) -> DataFrame:
    entry = F.concat(F.lit('"'), F.col(name), F.lit('":'), F.col(body))
    return rows.groupBy(*keys).agg(
        F.concat(F.lit("{"), F.concat_ws(",", F.sort_array(F.collect_list(entry))), F.lit("}")).alias(body)
    )


def json_requests(spark, folder) -> DataFrame:
    """Requests as JSON text, built from orders and order lines; all rows of a request are in one task from the start."""
    rows = request_rows(spark, folder).repartition("request_id")
    sections = _joined(["request_id", "container", "section"], "identifier", "attributes", rows)
    containers = _joined(["request_id", "container"], "section", "attributes", sections)
    entry = F.concat(F.lit('"'), F.col("container"), F.lit('":'), F.col("attributes"))
    return containers.groupBy("request_id").agg(
        F.concat(
            F.lit("{" + SPEC + ","), F.concat_ws(",", F.sort_array(F.collect_list(entry))), F.lit("}")
        ).alias("request")
    )


def columnar_requests(spark, folder) -> DataFrame:
    """The same positions with columnar sections."""
    block = F.concat(F.lit("r"), F.floor(F.col("instrument_id") / ORDERS_PER_REQUEST).cast("string"))
    names = ["instrument_id", "sub_portfolio_id", "trade_type_id", "liquidity_type_id", "initial_weight", "weight"]
    rows = datasets.positions(spark, folder).select(block.alias("request_id"), "container", "identifier", *names)
    gathered = rows.groupBy("request_id", "container").agg(
        F.sort_array(F.collect_list(F.struct("identifier", *names))).alias("r")
    )
    arrays = ", ".join(f"'{n}', to_json(transform(r, x -> x.{n}))" for n in ["identifier", *names])
    section = gathered.selectExpr(
        "request_id",
        "container",
        f"concat('{{', concat_ws(',', transform(map_entries(map({arrays})), e -> concat('\"', e.key, '\":', e.value))), '}}') AS s",
    )
    entry = F.concat(F.lit('"'), F.col("container"), F.lit('":{"positions":'), F.col("s"), F.lit("}"))
    return section.groupBy("request_id").agg(
        F.concat(F.lit("{" + SPEC + ","), F.concat_ws(",", F.sort_array(F.collect_list(entry))), F.lit("}")).alias("request")
    )


CHILDREN = """
child AS (SELECT container, record_type, identifier, parent_instrument_id, MAX(instrument_id) AS instrument_id,
                 MAX(sub_portfolio_id) AS sub_portfolio_id, MAX(trade_type_id) AS trade_type_id,
                 MAX(liquidity_type_id) AS liquidity_type_id, MAX(is_class_position) AS is_class_position,
                 MAX(initial_weight) AS initial_weight, MAX(weight) AS weight
          FROM raw_lt GROUP BY ALL)"""
PLAIN = ["instrument_id", "sub_portfolio_id", "trade_type_id", "liquidity_type_id", "is_class_position", "initial_weight", "weight"]


def _read_requests(spark, folder):
    pos, lt = read_requests(json_requests(spark, folder), TYPES)
    columns = ["request_id", "container", "record_type", "identifier", *PLAIN, "parent_instrument_id"]
    return pos.select(*columns).unionByName(lt.select(*columns))


def _read_requests_inferred(spark, folder):
    """Attribute types found by a pass over the requests."""
    pos, lt = read_requests(json_requests(spark, folder))
    columns = ["request_id", "container", "record_type", "identifier", *PLAIN]
    return pos.select(*columns).unionByName(lt.select(*columns))


def _read_columnar(spark, folder):
    requests = columnar_requests(spark, folder)
    pos, _ = read_columnar_requests(requests, columnar_types(request_sections(requests)))
    names = ["instrument_id", "sub_portfolio_id", "trade_type_id", "liquidity_type_id", "initial_weight", "weight"]
    return pos.select("request_id", "container", "identifier", *names)


BLOCK = "'r' || (instrument_id // 50)"
QUERIES = {
    "S-01_read_requests": (
        _read_requests,
        f"WITH {RAW}, {CHILDREN} SELECT {BLOCK} AS request_id, container, record_type, identifier, "
        f"{', '.join(PLAIN)}, NULL::BIGINT AS parent_instrument_id FROM raw_pos UNION ALL "
        "SELECT 'r' || (parent_instrument_id // 50) AS request_id, container, record_type, identifier, "
        f"{', '.join(PLAIN)}, parent_instrument_id FROM child",
    ),
    "S-01_read_requests_inferred": (
        _read_requests_inferred,
        f"WITH {RAW}, {CHILDREN} SELECT {BLOCK} AS request_id, container, record_type, identifier, "
        f"{', '.join(PLAIN)} FROM raw_pos UNION ALL "
        "SELECT 'r' || (parent_instrument_id // 50) AS request_id, container, record_type, identifier, "
        f"{', '.join(PLAIN)} FROM child",
    ),
    "S-02_read_columnar_requests": (
        _read_columnar,
        f"WITH {RAW} SELECT {BLOCK} AS request_id, container, identifier, instrument_id, sub_portfolio_id, "
        "trade_type_id, liquidity_type_id, initial_weight, weight FROM raw_pos",
    ),
}


def _process_requests(spark, folder):
    """Every request evaluated alone: weights rescaled within each request."""
    run = process_requests(json_requests(spark, folder), types=TYPES, defaults=[])
    rows = run.result.positions
    return rows.select(
        "request_id", "config", "perspective_id", "container", "identifier", "factor",
        F.round("out_initial_weight", 9).alias("initial_weight"),
    )


QUERIES["S-01_process_requests"] = (
    _process_requests,
    f"""WITH {RAW}, {CHILDREN},
p1 AS (SELECT {BLOCK} AS request_id, * FROM raw_pos WHERE trade_type_id <= 3),
mass AS (SELECT request_id, container, SUM(initial_weight) AS iw FROM (
  SELECT request_id, container, initial_weight FROM p1 UNION ALL
  SELECT p1.request_id, c.container, c.initial_weight FROM child c JOIN p1 ON p1.instrument_id = c.parent_instrument_id
    AND p1.container = c.container AND p1.sub_portfolio_id = c.sub_portfolio_id
  WHERE c.trade_type_id <= 3 AND c.record_type = 'essential_lookthroughs') GROUP BY ALL)
SELECT request_id, 'main' AS config, CAST(-1 AS BIGINT) AS perspective_id, container, identifier, 1.0::DOUBLE AS factor,
  ROUND(initial_weight * (1.0 / iw), 9) AS initial_weight FROM p1 JOIN mass USING (request_id, container)
UNION ALL
SELECT {BLOCK}, 'main', -2, container, identifier,
  CASE WHEN COALESCE(liquidity_type_id, -2147483648) > 4 THEN 0.5 ELSE 1.0 END,
  ROUND(initial_weight * CASE WHEN COALESCE(liquidity_type_id, -2147483648) > 4 THEN 0.5 ELSE 1.0 END, 9) FROM raw_pos""",
)


def _from_tables(spark, folder):
    pos, lt = from_tables(datasets.positions(spark, folder), datasets.lookthroughs(spark, folder), datasets.LABELS)
    columns = ["request_id", "container", "record_type", "identifier", "liquidity_type_id", "weight"]
    return pos.select(*columns).unionByName(lt.select(*columns))


QUERIES["S-03_from_tables"] = (
    _from_tables,
    with_tables(
        "SELECT 'all' AS request_id, container, record_type, identifier, liquidity_type_id, weight FROM pos UNION ALL "
        "SELECT 'all', container, record_type, identifier, liquidity_type_id, weight FROM lt"
    ),
)


def _union_containers(spark, folder):
    """The containers as tables of their own, with different columns, put together again."""
    rows = datasets.positions(spark, folder)

    def part(container: str) -> DataFrame:
        weight = "initial_weight" if container == "holding" else "weight"
        return rows.where(F.col("container") == container).select("identifier", "instrument_id", weight)

    return union_containers([(c, "positions", part(c)) for c in CONTAINERS])


QUERIES["S-04_union_containers"] = (
    _union_containers,
    f"""WITH {RAW} SELECT container, 'positions' AS record_type, identifier, instrument_id,
  CASE WHEN container = 'holding' THEN initial_weight END AS initial_weight,
  CASE WHEN container <> 'holding' THEN weight END AS weight FROM raw_pos""",
)
QUERIES["U-02_union_missing_columns"] = (
    lambda spark, folder: datasets.positions(spark, folder)
    .select("container", "identifier", "priority")
    .unionByName(
        datasets.lookthroughs(spark, folder).select("container", "identifier", "instrument_id"), allowMissingColumns=True
    ),
    f"WITH {RAW} SELECT container, identifier, priority, NULL::BIGINT AS instrument_id FROM raw_pos UNION ALL "
    "SELECT container, identifier, NULL, instrument_id FROM raw_lt",
)
QUERIES["U-01_union_same_schema"] = (
    lambda spark, folder: positions(spark, folder)
    .select("container", "instrument_id")
    .unionByName(lookthroughs(spark, folder).select("container", "instrument_id")),
    with_tables("SELECT container, instrument_id FROM pos UNION ALL SELECT container, instrument_id FROM lt"),
)

# --- reference data ----------------------------------------------------------


def _reference(spark, folder):
    ids = instrument_ids(lookthroughs(spark, folder), None)
    return read_reference(datasets.instruments(spark, folder), ids, ["instrument_subtype_id"])


QUERIES["S-05_read_reference"] = (
    _reference,
    with_tables(
        "SELECT instrument_id, instrument_subtype_id FROM instruments WHERE instrument_id IN "
        "(SELECT instrument_id FROM lt)",
        INSTRUMENTS,
    ),
)
QUERIES["S-06_read_parent_reference"] = (
    lambda spark, folder: read_parent_reference(
        datasets.instruments(spark, folder), positions(spark, folder), ["instrument_subtype_id", "brand"]
    ),
    with_tables(
        "SELECT instrument_id AS parent_instrument_id, instrument_subtype_id AS parent_instrument_subtype_id, "
        "brand AS parent_brand FROM instruments WHERE instrument_id IN (SELECT parent_instrument_id FROM pos)",
        INSTRUMENTS,
    ),
)
QUERIES["S-07_read_asset_allocation"] = (
    lambda spark, folder: read_asset_allocation(
        datasets.allocation_categories(spark, folder),
        positions(spark, folder),
        ["category_name"],
    ),
    with_tables(
        "SELECT analytics_category_id, category_name FROM allocations WHERE analytics_category_id IN "
        "(SELECT asset_allocation_id FROM pos)",
        ALLOCATIONS,
    ),
)
QUERIES["S-08_read_as_of"] = (
    lambda spark, folder: read_as_of(datasets.categorization(spark, folder), "1998-06-30"),
    f"WITH {CATEGORIES} SELECT instrument_id, category_id, segment FROM categories "
    "WHERE valid_from <= '1998-06-30' AND (valid_to IS NULL OR '1998-06-30' < valid_to)",
)


def _versions(spark, folder):
    """Requests of two dates in one batch: each gets the version of its own."""
    date = F.when(F.length("request_id") % 2 == 0, F.lit("1994-03-31")).otherwise(F.lit("1998-06-30"))
    dated = json_requests(spark, folder).withColumn(
        "request", F.concat(F.lit('{"ed":"'), date, F.lit('",'), F.expr("substring(request, 2)"))
    )
    tables = ReferenceTables(versioned={"categorization": (datasets.categorization(spark, folder), ["category_id", "segment"])})
    run = process_requests(dated, types=TYPES, defaults=[], reference=tables, carry=["category_id", "segment"])
    rows = run.result.positions.where("perspective_id = -2")
    return rows.select("request_id", "container", "identifier", "category_id", "segment")


QUERIES["S-08_versions_by_request_date"] = (
    _versions,
    f"""WITH {RAW}, {CATEGORIES},
dated AS (SELECT {BLOCK} AS request_id, container, identifier, instrument_id,
  CASE WHEN length({BLOCK}) % 2 = 0 THEN '1994-03-31' ELSE '1998-06-30' END AS ed FROM raw_pos)
SELECT request_id, container, identifier, category_id, segment FROM dated LEFT JOIN categories c
ON c.instrument_id = dated.instrument_id AND valid_from <= ed AND (valid_to IS NULL OR ed < valid_to)""",
)


def _overlapping(spark, folder):
    """Versions that overlap others, some within them: every position gets one, by its own date or the open one."""
    table = datasets.categorization(spark, folder)
    kind = table.schema["valid_from"].dataType
    more = table.where("instrument_id % 3 = 0 AND valid_to IS NOT NULL").select(
        *[
            F.lit(at).cast(kind).alias(c)
            if (at := {"valid_from": "1992-01-01", "valid_to": "1999-01-01"}.get(c))
            else (F.col(c) + 100).alias(c) if c == "category_id" else F.col(c)
            for c in table.columns
        ]
    )
    within = table.where("valid_to IS NULL").withColumns(
        {"valid_from": F.lit("1993-01-01").cast(kind), "valid_to": F.lit("1993-06-01").cast(kind), "category_id": F.col("category_id") + 200}
    )
    date = F.element_at(F.array(*map(F.lit, ["1992-06-30", "1993-03-31", "1994-03-31", "1998-06-30", None])), (F.col("instrument_id") % 5 + 1).cast("int"))
    rows = datasets.positions(spark, folder).select("container", "identifier", "instrument_id", date.alias("moment"))
    return join_as_of(rows, table.unionByName(more).unionByName(within), ["category_id"], "moment").drop("instrument_id", "moment")


QUERIES["S-08_overlapping_versions"] = (
    _overlapping,
    f"""WITH {RAW}, {CATEGORIES},
versions AS (
  SELECT instrument_id, category_id, valid_from, valid_to FROM categories
  UNION ALL SELECT instrument_id, category_id + 100, '1992-01-01', '1999-01-01' FROM categories WHERE instrument_id % 3 = 0 AND valid_to IS NOT NULL
  UNION ALL SELECT instrument_id, category_id + 200, '1993-01-01', '1993-06-01' FROM categories WHERE valid_to IS NULL),
dated AS (SELECT container, identifier, instrument_id, nth, CASE nth % 5 WHEN 0 THEN '1992-06-30' WHEN 1 THEN '1993-03-31'
  WHEN 2 THEN '1994-03-31' WHEN 3 THEN '1998-06-30' END AS ed
  FROM (SELECT *, instrument_id AS nth FROM raw_pos)),
best AS (
  SELECT container, identifier, d.instrument_id, v.category_id FROM dated d LEFT JOIN versions v ON v.instrument_id = d.instrument_id
    AND CASE WHEN ed IS NULL THEN valid_to IS NULL ELSE valid_from <= ed AND (valid_to IS NULL OR ed < valid_to) END
  QUALIFY row_number() OVER (PARTITION BY d.instrument_id, container, identifier ORDER BY valid_from DESC, '{{"category_id":' || v.category_id || '}}' DESC) = 1)
SELECT container, identifier, category_id FROM best""",
)


def _many_specifications(spark, folder):
    """Every request has rules of its own, and some requests come twice."""
    number = F.expr("substring(request_id, 2)")
    own = json_requests(spark, folder).withColumn(
        "request",
        F.replace(
            F.replace("request", F.lit('"operator_type":"<=","value":3'), F.concat(F.lit('"operator_type":"<=","value":'), (number.cast("int") % 5 + 1).cast("string"))),
            F.lit('"column":"liquidity_type_id","operator_type":">","value":4'),
            F.concat(F.lit('"column":"instrument_id","operator_type":">","value":'), number, F.lit("*50+25")),
        ),
    )
    own = own.withColumn("request", F.replace("request", F.concat(number, F.lit("*50+25")), (number.cast("bigint") * 50 + 25).cast("string")))
    twice = own.where(number.cast("int") % 7 == 0)
    rows = process_requests(own.unionByName(twice), types=TYPES, defaults=[]).result.positions
    return rows.select("request_id", "perspective_id", "container", "identifier", "factor")


QUERIES["S-01_many_specifications"] = (
    _many_specifications,
    f"""WITH {RAW},
numbered AS (SELECT {BLOCK} AS request_id, instrument_id // 50 AS nr, * FROM raw_pos),
copied AS (SELECT * FROM numbered UNION ALL SELECT * FROM numbered WHERE nr % 7 = 0)
SELECT request_id, CAST(-1 AS BIGINT) AS perspective_id, container, identifier, 1.0::DOUBLE AS factor
FROM copied WHERE trade_type_id <= nr % 5 + 1
UNION ALL
SELECT request_id, -2, container, identifier, CASE WHEN instrument_id > nr * 50 + 25 THEN 0.5 ELSE 1.0 END FROM copied""",
)
QUERIES["J-01_join_instrument"] = (
    lambda spark, folder: join_instrument(
        lookthroughs(spark, folder),
        read_reference(
            datasets.instruments(spark, folder),
            instrument_ids(positions(spark, folder), lookthroughs(spark, folder)),
            ["instrument_subtype_id"],
        ),
    ).select("identifier", "instrument_id", "instrument_subtype_id"),
    with_tables(
        "SELECT identifier, instrument_id, instrument_subtype_id FROM lt LEFT JOIN instruments USING (instrument_id)",
        INSTRUMENTS,
    ),
)


def _join_parent(spark, folder):
    pos, lt = positions(spark, folder), lookthroughs(spark, folder)
    parents = read_parent_reference(datasets.instruments(spark, folder), pos, ["instrument_subtype_id"])
    columns = ["record_type", "identifier", "parent_instrument_id", "parent_instrument_subtype_id"]
    return join_parent_instrument(pos, parents).select(*columns).unionByName(
        join_parent_instrument(lt, parents).select(*columns)
    )


QUERIES["J-02_join_parent_instrument"] = (
    _join_parent,
    with_tables(
        """SELECT record_type, identifier, x.parent_instrument_id, instrument_subtype_id AS parent_instrument_subtype_id
FROM (SELECT record_type, identifier, parent_instrument_id FROM pos UNION ALL
      SELECT record_type, identifier, parent_instrument_id FROM lt) x
LEFT JOIN (SELECT * FROM instruments WHERE instrument_id IN (SELECT parent_instrument_id FROM pos)) i
  ON i.instrument_id = x.parent_instrument_id""",
        INSTRUMENTS,
    ),
)
QUERIES["J-03_join_asset_allocation"] = (
    lambda spark, folder: join_asset_allocation(
        positions(spark, folder),
        read_asset_allocation(datasets.allocation_categories(spark, folder), positions(spark, folder), ["category_name"]),
    ).select("identifier", "asset_allocation_id", "category_name"),
    with_tables(
        "SELECT identifier, asset_allocation_id, category_name FROM pos "
        "LEFT JOIN allocations ON asset_allocation_id = analytics_category_id",
        ALLOCATIONS,
    ),
)
QUERIES["J-04_reference_id_restriction"] = (
    lambda spark, folder: read_reference(
        datasets.instruments(spark, folder),
        instrument_ids(positions(spark, folder), lookthroughs(spark, folder)),
        ["brand"],
    ),
    with_tables(
        "SELECT instrument_id, brand FROM instruments WHERE instrument_id IN "
        "(SELECT instrument_id FROM pos UNION SELECT instrument_id FROM lt)",
        INSTRUMENTS,
    ),
)


def _ids(spark, folder):
    pos, lt = positions(spark, folder), lookthroughs(spark, folder)
    parts = [
        ("instrument", instrument_ids(pos, lt)),
        ("parent", parent_ids(pos)),
        ("allocation", allocation_ids(pos)),
    ]
    frames = [df.toDF("id").select(F.lit(kind).alias("kind"), "id") for kind, df in parts]
    return functools.reduce(DataFrame.unionByName, frames)


QUERIES["A-06_distinct_ids"] = (
    _ids,
    with_tables(
        "SELECT 'instrument' AS kind, instrument_id AS id FROM (SELECT instrument_id FROM pos UNION SELECT instrument_id FROM lt) "
        "UNION ALL SELECT DISTINCT 'parent', parent_instrument_id FROM pos "
        "UNION ALL SELECT DISTINCT 'allocation', asset_allocation_id FROM pos"
    ),
)

# --- rule catalogue ----------------------------------------------------------


def rule_documents(spark, folder) -> DataFrame:
    """Stored perspectives: each part becomes a document with two rules."""
    key, size = F.col("p_partkey"), F.col("p_size")
    first = F.struct(
        F.when(key % 3 == 0, "holding").otherwise("both").alias("apply_to"),
        F.to_json(
            F.struct(
                F.array(
                    F.struct(F.lit("brand").alias("column"), F.lit("==").alias("operator_type"), F.col("p_brand").alias("value"))
                ).alias("and"),
                F.struct(F.array(F.lit("Brand"), F.concat(F.lit("P_"), F.col("p_type"))).alias("INSTRUMENT")).alias(
                    "required_columns"
                ),
            )
        ).alias("criteria"),
        F.when(key % 4 == 0, "or").alias("condition_for_next_rule"),
        F.lit(False).alias("is_scaling_rule"),
        F.lit(None).cast("double").alias("scale_factor"),
    )
    nested = F.format_string(
        '{"or":[{"not":{"column":"instrument_id","operator_type":"NotIn","value":{"table_name":"T%s","column":"c",'
        '"operator_type":"==","value":%s}}},{"column":"simulated_trade_id","operator_type":"In",'
        '"value":{"table_name":"rule_result","column":"result"}}],'
        '"required_columns":{"PARENT_INSTRUMENT":["instrument_id","name%s"],"InstrumentInput":["weight"]}}',
        (size % 5).cast("string"),
        key.cast("string"),
        (size % 3).cast("string"),
    )
    second = F.struct(
        F.lit("both").alias("apply_to"),
        nested.alias("criteria"),
        F.lit(None).cast("string").alias("condition_for_next_rule"),
        (key % 5 == 0).alias("is_scaling_rule"),
        F.when(key % 5 == 0, (size * 2).cast("double")).alias("scale_factor"),
    )
    document = F.struct(
        size.cast("long").alias("id"),
        F.col("p_name").alias("name"),
        (key % 97 != 0).alias("is_active"),
        F.when(key % 89 != 0, F.lit(True)).alias("is_compatible_with_sub_setting_service"),
        F.array(first, second).alias("rules"),
    )
    return datasets.table(spark, folder, "part").select(key.alias("ordinal"), F.to_json(document).alias("document"))


def stored_perspectives(spark, folder) -> DataFrame:
    return read_perspectives(rule_documents(spark, folder))


QUERIES["S-09_read_perspectives"] = (
    lambda spark, folder: stored_perspectives(spark, folder).select(
        "perspective_id", "is_active", "is_supported", "ordinal", "place", "apply_to", "condition_for_next_rule",
        "is_scaling_rule", "scale_factor",
    ),
    """SELECT CAST(p_size AS BIGINT) AS perspective_id, bool_and(p_partkey % 97 <> 0) OVER w AS is_active, TRUE AS is_supported,
  p_partkey AS ordinal, place, CASE WHEN place = 0 AND p_partkey % 3 = 0 THEN 'holding' ELSE 'both' END AS apply_to,
  CASE WHEN place = 0 AND p_partkey % 4 = 0 THEN 'or' END AS condition_for_next_rule,
  place = 1 AND p_partkey % 5 = 0 AS is_scaling_rule,
  CASE WHEN place = 1 AND p_partkey % 5 = 0 THEN CAST(p_size * 2 AS DOUBLE) END AS scale_factor
FROM part CROSS JOIN (VALUES (0), (1)) AS v(place) WINDOW w AS (PARTITION BY p_size)""",
)

# --- normalisation -----------------------------------------------------------

QUERIES["N-01_lowercase_columns"] = (
    lambda spark, folder: lowercase_columns(
        datasets.positions(spark, folder).selectExpr("container AS Container", "identifier AS IDENTIFIER")
    ),
    f"WITH {RAW} SELECT container, identifier FROM raw_pos",
)
QUERIES["N-02_standardize_ids"] = (
    lambda spark, folder: standardize_ids(
        datasets.positions(spark, folder).selectExpr(
            "identifier", "instrument_id", "parent_instrument_id AS instrument_identifier", "sub_portfolio_id"
        )
    ),
    f"WITH {RAW} SELECT identifier, parent_instrument_id AS instrument_id, "
    "parent_instrument_id AS instrument_identifier, sub_portfolio_id FROM raw_pos",
)
QUERIES["N-03_validate_domains"] = (
    lambda spark, folder: validate_domains(
        datasets.lookthroughs(spark, folder).select("container", "record_type", "identifier")
    ),
    f"WITH {RAW} SELECT container, record_type, identifier FROM raw_lt",
)


def _filled(spark, folder):
    rows = fill_sentinels(datasets.positions(spark, folder), ALL_LABELS)
    return rows.select(
        "identifier", "weight", "liquidity_type_id", "simulated_trade_id", "resulting_shares", "is_class_position", "priority"
    )


QUERIES["N-04_fill_sentinels"] = (
    _filled,
    with_tables(
        "SELECT identifier, weight, liquidity_type_id, simulated_trade_id, resulting_shares, is_class_position, priority FROM pos"
    ),
)


def _zero_rows(spark, folder):
    from foliolens.operators.metrics import drop_zero_weight_rows

    rows = datasets.positions(spark, folder).selectExpr(
        "identifier",
        "trade_type_id <= 3 AS result",
        "CASE WHEN instrument_id % 4 = 0 THEN 0.0D ELSE initial_weight END AS initial_weight",
        "CASE WHEN instrument_id % 8 = 0 THEN 0.0D ELSE weight END AS weight",
    )
    return drop_zero_weight_rows(rows, ["initial_weight", "weight"])


QUERIES["N-07_drop_zero_weight_rows"] = (
    _zero_rows,
    f"""WITH {RAW}, z AS (SELECT identifier, trade_type_id <= 3 AS result,
  CASE WHEN instrument_id % 4 = 0 THEN 0.0::DOUBLE ELSE initial_weight END AS initial_weight,
  CASE WHEN instrument_id % 8 = 0 THEN 0.0::DOUBLE ELSE weight END AS weight FROM raw_pos)
SELECT * FROM z WHERE result AND NOT (COALESCE(initial_weight = 0, FALSE) AND COALESCE(weight = 0, FALSE))""",
)
