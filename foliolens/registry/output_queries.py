"""Result shapes, compared after they are unfolded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliolens import datasets
from foliolens.operators.output import flat_result, nested_result, wide_lookthroughs, wide_positions, write_result
from foliolens.plans.pipeline import run_views
from foliolens.plans.requests import process_requests
from foliolens.plans.reuse import new_folder
from foliolens.registry.inputs import ALL_LABELS, RAW, lookthroughs, positions, with_tables
from foliolens.registry.source_queries import CHILDREN, ORDERS_PER_REQUEST, TYPES, json_requests
from foliolens.registry.view_queries import (
    CRITERIA_RULES,
    HOLD,
    KEPT,
    MASSES,
    TOTALS,
    VIEWS_SQL,
    both,
    kept_sql,
    kept_summary,
    main,
    views,
)
from foliolens.sources.requests import read_columnar_requests

# Of child rows with one identifier a document shows one.
SHOWN_LT = """
sl AS (SELECT * FROM kl QUALIFY ROW_NUMBER() OVER (PARTITION BY pid, container, record_type, identifier
  ORDER BY instrument_id DESC NULLS LAST, sub_portfolio_id DESC NULLS LAST, weight * factor DESC NULLS LAST) = 1)"""


def _wide_positions(spark, folder):
    wide = wide_positions(main(spark, folder, HOLD), ["container", "identifier"])
    return wide.select(
        "container",
        "identifier",
        *[F.col(f"`f_main_{p}`").alias(f"factor{-int(p)}") for p in CRITERIA_RULES],
        *[F.round(F.col(f"`initial_weight_main_{p}`"), 9).alias(f"weight{-int(p)}") for p in CRITERIA_RULES],
    )


def _wide_lookthroughs(spark, folder):
    wide = wide_lookthroughs(main(spark, folder), ["container", "record_type", "sub_portfolio_id"])
    return wide.groupBy("container", "record_type", "sub_portfolio_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`f_main_{p}`")).alias(f"kept{-int(p)}") for p in CRITERIA_RULES],
        *[F.sum(F.col(f"`weight_main_{p}`")).alias(f"weight{-int(p)}") for p in CRITERIA_RULES],
    )


def _wide_sql() -> str:
    columns = []
    for pid, keep, factor in VIEWS_SQL:
        columns.append(f"CASE WHEN {keep} THEN CAST({factor} AS DOUBLE) END AS factor{-pid}")
    weights = [
        f"ROUND(initial_weight * (factor{-pid} / (SELECT iw FROM mass m WHERE m.pid = {pid} AND m.container = x.container)), 9) "
        f"AS weight{-pid}"
        for pid, _, _ in VIEWS_SQL
    ]
    factors = ", ".join(f"factor{-pid}" for pid, _, _ in VIEWS_SQL)
    return with_tables(
        f"SELECT container, identifier, {factors}, {', '.join(weights)} FROM (SELECT pos.*, {', '.join(columns)} FROM pos) x",
        KEPT,
        MASSES,
    )


def _wide_lt_sql() -> str:
    kept = ", ".join(
        f"COALESCE(ANY_VALUE(kept) FILTER (pid = {pid}), 0) AS kept{-pid}, ANY_VALUE(weight) FILTER (pid = {pid}) AS weight{-pid}"
        for pid, _, _ in VIEWS_SQL
    )
    return with_tables(
        f"""SELECT a.container, a.record_type, a.sub_portfolio_id, ANY_VALUE(a.n) AS rows, {kept}
FROM (SELECT container, record_type, sub_portfolio_id, COUNT(*) AS n FROM lt GROUP BY ALL) a
LEFT JOIN (SELECT pid, container, record_type, sub_portfolio_id, COUNT(*) AS kept, SUM(weight * factor) AS weight
           FROM kl GROUP BY ALL) k USING (container, record_type, sub_portfolio_id)
GROUP BY a.container, a.record_type, a.sub_portfolio_id""",
        KEPT,
    )


QUERIES = {
    "R-02_wide_positions": (_wide_positions, _wide_sql()),
    "R-02_wide_lookthroughs": (_wide_lookthroughs, _wide_lt_sql()),
}


def _nested(spark, folder):
    """Nested maps, unfolded to rows."""
    rows = nested_result(main(spark, folder), parts=25)
    return (
        rows.select("perspective_id", "container", "section", F.explode("rows").alias("identifier", "weights"))
        .select("perspective_id", "container", "section", "identifier", F.explode("weights").alias("label", "weight"))
        .where("weight IS NOT NULL")
    )


def _nested_sql() -> str:
    parts = []
    for section, frame in (("'positions'", "kp"), ("record_type", "sl")):
        labels = {"holding": datasets.POSITION_LABELS, "x": ["weight"]} if frame == "kp" else {"holding": ["weight"], "x": ["weight"]}
        for container, names in labels.items():
            where = "container = 'holding'" if container == "holding" else "container <> 'holding'"
            parts += [
                f"SELECT pid AS perspective_id, container, {section} AS section, identifier, '{w}' AS label, "
                f"{w} * factor AS weight FROM {frame} WHERE {where} AND {w} IS NOT NULL"
                for w in names
            ]
    return with_tables(" UNION ALL ".join(parts), KEPT, SHOWN_LT)


QUERIES["R-03_nested_result"] = (_nested, _nested_sql())


def _flat(spark, folder):
    """Columnar arrays, unfolded to rows."""
    result = run_views(positions(spark, folder), None, views())
    rows = flat_result(result, parts=25)
    return rows.select(
        "perspective_id",
        "container",
        F.inline(F.arrays_zip("identifiers", "initial_weight", "weight")),
    ).withColumnRenamed("identifiers", "identifier")


QUERIES["R-05_flatten_response"] = (
    _flat,
    with_tables(
        """SELECT pid AS perspective_id, container, identifier,
  CASE WHEN container = 'holding' THEN initial_weight * factor END AS initial_weight,
  CASE WHEN container <> 'holding' THEN weight * factor END AS weight FROM kp""",
        KEPT,
    ),
)


def _flat_sections(spark, folder):
    """Columnar arrays of all sections and labels, unfolded to rows."""
    rows = flat_result(main(spark, folder), parts=25)
    unfolded = F.inline(F.arrays_zip("identifiers", *ALL_LABELS))
    return rows.select("perspective_id", "container", "section", unfolded).withColumnRenamed("identifiers", "identifier")


def _flat_sections_sql() -> str:
    own = ", ".join(f"CASE WHEN container = 'holding' THEN {w} * factor END AS {w}" for w in datasets.POSITION_LABELS)
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {w}" for w in datasets.POSITION_LABELS)
    return with_tables(
        f"""SELECT pid AS perspective_id, container, 'positions' AS section, identifier, {own},
  CASE WHEN container <> 'holding' THEN weight * factor END AS weight FROM kp
UNION ALL SELECT pid, container, record_type, identifier, {none}, weight * factor FROM sl""",
        KEPT,
        SHOWN_LT,
    )


QUERIES["R-05_flatten_all_sections"] = (_flat_sections, _flat_sections_sql())


def document_weights(done: DataFrame, columnar: bool = False) -> DataFrame:
    """The positions in JSON responses and their initial weight in each view."""
    rows = "struct<identifier:array<string>,initial_weight:array<double>>" if columnar else "map<string,struct<initial_weight:double>>"
    body = f"map<string,map<string,map<string,struct<positions:{rows}>>>>"
    # one parse of a document: every other would go through the names of all its rows again
    configs = F.from_json("document", f"struct<perspective_configurations:{body}>")["perspective_configurations"]
    containers = (
        done.select("request_id", F.explode(configs).alias("config", "views"))
        .select("request_id", F.explode("views").alias("perspective_id", "containers"))
        .select("request_id", "perspective_id", F.explode("containers").alias("container", "sections"))
    )
    positions = F.col("sections")["positions"]
    if columnar:
        zipped = F.arrays_zip(positions["identifier"].alias("identifier"), positions["initial_weight"].alias("weight"))
        unfolded = containers.select("request_id", "perspective_id", "container", F.inline(zipped)).toDF(
            "request_id", "perspective_id", "container", "identifier", "weight"
        )
    else:
        unfolded = containers.select(
            "request_id", "perspective_id", "container", F.explode(positions).alias("identifier", "weights")
        ).select("*", F.col("weights")["initial_weight"].alias("weight"))
    return unfolded.select(
        "request_id", "perspective_id", "container", "identifier", F.round("weight", 9).alias("weight")
    )


def _documents(columnar: bool):
    """JSON responses of the JSON requests, read back."""

    def run(spark, folder):
        done = process_requests(json_requests(spark, folder), types=TYPES, defaults=[]).documents(columnar)
        return document_weights(done, columnar)

    return run


def documents_sql() -> str:
    from foliolens.registry.source_queries import QUERIES as SOURCES

    rows = SOURCES["S-01_process_requests"][1]
    return (
        "SELECT request_id, CAST(perspective_id AS VARCHAR) AS perspective_id, container, identifier, "
        f"initial_weight AS weight FROM ({rows})"
    )


QUERIES["R-03_json_documents"] = (_documents(False), documents_sql())
QUERIES["R-05_columnar_documents"] = (_documents(True), documents_sql())


def _document_factors(spark, folder):
    """Scale factors in the JSON responses."""
    done = process_requests(json_requests(spark, folder), types=TYPES, defaults=[]).documents()
    path = "$.perspective_configurations.main.-1.holding.scale_factors.initial_weight"
    values = done.select(
        "request_id", F.round(F.get_json_object("document", path).cast("double"), 9).alias("scale_factor")
    )
    return values.where("scale_factor IS NOT NULL")


QUERIES["A-11_factors_in_documents"] = (
    _document_factors,
    f"""WITH {RAW}, {CHILDREN},
p AS (SELECT 'r' || (instrument_id // 50) AS request_id, * FROM raw_pos WHERE container = 'holding'),
c AS (SELECT p.request_id, p.trade_type_id AS parent_type, child.* FROM child JOIN p ON p.instrument_id = child.parent_instrument_id
      WHERE child.record_type = 'essential_lookthroughs' AND child.sub_portfolio_id = p.sub_portfolio_id),
x AS (SELECT request_id, initial_weight AS total, CASE WHEN trade_type_id <= 3 THEN initial_weight ELSE 0 END AS kept FROM p
      UNION ALL SELECT request_id, initial_weight,
        CASE WHEN trade_type_id <= 3 AND parent_type <= 3 THEN initial_weight ELSE 0 END FROM c)
SELECT request_id, ROUND(CASE WHEN SUM(kept) = 0 THEN 1.0 ELSE SUM(kept) / SUM(total) END, 9) AS scale_factor
FROM x GROUP BY request_id""",
)


def _round_trip(spark, folder):
    """Columnar responses read as columnar requests again."""
    result = run_views(positions(spark, folder), None, views())
    flat = flat_result(result, parts=25).where("container = 'holding'")
    arrays = "'\"identifier\":', to_json(identifiers), ',\"initial_weight\":', to_json(initial_weight)"
    text = f"concat('{{\"holding\":{{\"positions\":{{', {arrays}, '}}}}}}')"
    requests = flat.selectExpr(
        "concat_ws('/', perspective_id, part) AS request_id", f"{text} AS request"
    )
    pos, _ = read_columnar_requests(requests, {"initial_weight": "double"})
    return pos.selectExpr(
        "bigint(split(request_id, '/')[0]) AS perspective_id", "container", "identifier", "initial_weight"
    )


QUERIES["R-05_columnar_round_trip"] = (
    _round_trip,
    with_tables(
        "SELECT pid AS perspective_id, container, identifier, initial_weight * factor AS initial_weight FROM kp "
        "WHERE container = 'holding'",
        KEPT,
    ),
)


def _sections(spark, folder):
    return kept_summary(both(main(spark, folder)))


QUERIES["R-04_partition_output"] = (
    _sections,
    with_tables(
        kept_sql(
            "SELECT pid, container, record_type, sub_portfolio_id, instrument_id, initial_weight, factor FROM kp UNION ALL "
            "SELECT pid, container, record_type, sub_portfolio_id, instrument_id, initial_weight, factor FROM kl"
        ),
        KEPT,
    ),
)


def _folders(spark, folder):
    """Rows of the result files by the folder that they are in."""
    path = new_folder(spark)
    write_result(main(spark, folder), path)
    by = ["perspective_id", "container", "record_type"]
    # rows are counted per file; few paths are taken apart then
    files = [
        spark.read.parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        for name in ("positions", "lookthroughs")
    ]
    folders = [F.regexp_extract("file", f"/{k}=([^/]+)/", 1).alias(k) for k in by]
    return files[0].unionByName(files[1]).select(*folders, "rows").groupBy(*by).agg(F.sum("rows").alias("rows"))


QUERIES["R-04_partition_folders"] = (
    _folders,
    with_tables(
        """SELECT CAST(pid AS VARCHAR) AS perspective_id, container, record_type, COUNT(*) AS rows
FROM (SELECT pid, container, record_type FROM kp UNION ALL SELECT pid, container, record_type FROM kl) GROUP BY ALL""",
        KEPT,
    ),
)


def _unpivot(spark, folder):
    """Wide scale columns to long rows."""
    pos = positions(spark, folder)
    wide = pos.groupBy("container").agg(
        *[F.coalesce(F.sum(w), F.lit(0.0)).alias(f"sf__main__-1__{w}") for w in ALL_LABELS]
    )
    from foliolens.operators.scale_factors import unpivot_scale_factors

    return unpivot_scale_factors(wide)


QUERIES["R-01_unpivot_scale_factors"] = (
    _unpivot,
    with_tables(
        " UNION ALL ".join(
            f"SELECT container, 'main' AS config, CAST(-1 AS BIGINT) AS perspective_id, '{w}' AS weight_label, "
            f"COALESCE(SUM({w}), 0) AS scale_factor FROM pos GROUP BY container"
            for w in ALL_LABELS
        )
    ),
)


def _sink(spark, folder):
    """Result files, read back: all rows of both frames, beside the scale factors of their containers."""
    path = new_folder(spark)
    write_result(main(spark, folder, HOLD), path)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    keys = ["config", "perspective_id", "container"]
    factors = read("scale_factors").where("weight_label IN ('initial_weight', 'weight')").groupBy(*keys).agg(F.round(F.max("scale_factor"), 9).alias("scale_factor"))
    rows = read("positions").unionByName(read("lookthroughs"), allowMissingColumns=True).join(factors, keys)
    return rows.select(
        F.col("perspective_id").cast("long"), "container", "record_type", "identifier", "factor", "initial_weight", "weight",
        "scale_factor",
    )


QUERIES["R-06_sinks"] = (
    _sink,
    with_tables(
        """SELECT pid AS perspective_id, container, record_type, identifier, factor, initial_weight, weight,
  ROUND(CASE WHEN container = 'holding' THEN m.iw / t.iw ELSE CASE WHEN t.w = 0 THEN 1.0 ELSE m.w / t.w END END, 9) AS scale_factor
FROM (SELECT pid, container, record_type, identifier, factor, initial_weight, weight FROM kp
      UNION ALL SELECT pid, container, record_type, identifier, factor, initial_weight, weight FROM kl)
JOIN mass m USING (pid, container) JOIN tot t USING (container)""",
        KEPT,
        MASSES,
        TOTALS,
    ),
)


def _empty(spark, folder):
    """Requests whose positions are empty get an empty document each."""
    requests = json_requests(spark, folder).select(
        "request_id",
        F.regexp_replace("request", r'"(holding|selected_reference|contractual_reference)":', '"other_$1":').alias("request"),
    )
    hollow = requests.withColumn("request", F.regexp_replace("request", r'"positions":\{.*', '"none":{}}}'))
    return process_requests(hollow, types=TYPES, defaults=[]).documents().select("request_id", "document")


QUERIES["R-07_empty_input"] = (
    _empty,
    f"""SELECT DISTINCT 'r' || (o_orderkey // {ORDERS_PER_REQUEST}) AS request_id,
  '{{"perspective_configurations":{{}}}}' AS document FROM orders""",
)
QUERIES["O-01_sorted_result"] = (
    lambda spark, folder: main(spark, folder)
    .positions.select("perspective_id", "container", "identifier", "factor")
    .orderBy("perspective_id", "container", "identifier"),
    with_tables("SELECT pid AS perspective_id, container, identifier, factor FROM kp ORDER BY ALL", KEPT),
)
