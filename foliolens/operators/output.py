"""Result shapes: wide columns, nested documents, columnar arrays, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliolens.functions.criteria import literal
from foliolens.model import View, ViewSet
from foliolens.operators.factors import Layout, bit
from foliolens.operators.rescale import Totals, with_container_totals
from foliolens.plans.pipeline import ViewResult
from foliolens.schema import POSITIONS, REQUEST, SPEC, VIEW_KEYS, out, present

SECTION_KEYS = [REQUEST, "part", *VIEW_KEYS, "container", "section"]


def wide_name(view: View, label: str | None = None) -> str:
    suffix = f"{view.config}_{view.perspective_id}"
    return f"f_{suffix}" if label is None else f"{label}_{suffix}"


def _wide(rows: DataFrame, views: ViewSet, labels: list[str], totals: Totals | None, keys: list[str]) -> DataFrame:
    layout = Layout(views)
    columns = []
    for view in views.views:
        factor = layout.factor(view)
        columns.append(f"{factor} AS `{wide_name(view)}`")
        for j, w in enumerate(labels):
            share = factor
            total = totals.place(view.index, j) if totals is not None else None
            if total is not None:
                if totals.match:
                    total = f"CASE WHEN {bit(view, totals.match)} THEN {total} END"
                share = f"CASE WHEN coalesce({total}, 0.0D) <> 0.0D THEN {factor} / {total} ELSE {factor} END"
            columns.append(f"`{w}` * ({share}) AS `{wide_name(view, w)}`")
    return rows.selectExpr(*[f"`{k}`" for k in keys], *columns)


def wide_positions(result: ViewResult, carry: list[str] | None = None) -> DataFrame:
    """All positions with factor and weight columns per view, NULL where removed."""
    rows, totals = result.evaluated_positions, None
    if result.masses is not None:
        rows, totals = with_container_totals(
            rows, result.views, result.position_labels, result.masses
        )
    keys = [c for c in result.evaluated_positions.columns if not c.startswith("_")] if carry is None else carry
    return _wide(rows, result.views, result.position_labels, totals, keys)


def wide_lookthroughs(result: ViewResult, carry: list[str] | None = None) -> DataFrame:
    """The same for all child rows."""
    rows, totals = result.synced_lookthroughs(keep_removed=True)
    children = result.evaluated_lookthroughs
    keys = [c for c in children.columns if not c.startswith("_")] if carry is None else carry
    return _wide(rows, result.views, result.lookthrough_labels, totals, keys)


Labels = tuple[tuple[str, ...], tuple[str, ...]]


def _own_labels(views: ViewSet, mode: int, available: list[str], numbers: dict[Labels, int]) -> str:
    """Number of a container's own labels among the weights of its frame; new ones get the next number."""
    whens = []
    for spec, containers in views.labels.items():
        for container, pair in containers.items():
            labels = tuple(w for w in pair[mode] or [] if w in available)
            of_spec = "" if spec is None else f" AND {SPEC} = {literal(spec)}"
            number = numbers.setdefault((tuple(available), labels), len(numbers))
            whens.append(f"WHEN container = {literal(container)}{of_spec} THEN {number}")
    return f"CASE {' '.join(whens)} END" if whens else "int(NULL)"


def _weights(numbers: dict[Labels, int]) -> str:
    """Map of the output weights of a container's own labels, in its own order."""
    whens = []
    for (available, labels), number in numbers.items():
        entries = ", ".join(f"{literal(w)}, _row.weights[{available.index(w)}]" for w in labels)
        whens.append(f"WHEN {number} THEN cast({f'map({entries})' if entries else 'map()'} AS map<string,double>)")
    return f"CASE _row.labels {' '.join(whens)} END" if whens else "cast(NULL AS map<string,double>)"


def _weight(numbers: dict[Labels, int], label: str) -> str:
    """One of these weights."""
    places = [(number, available.index(label)) for (available, labels), number in numbers.items() if label in labels]
    whens = " ".join(f"WHEN {number} THEN _row.weights[{place}]" for number, place in places)
    return f"CASE _row.labels {whens} END" if whens else "double(NULL)"


def output_rows(result: ViewResult) -> tuple[DataFrame, dict[Labels, int]]:
    """Kept rows of both frames as (request, view, container, section, identifier, row), and the numbers of their label lists.

    A row is in the order of ``output_parts``; its weights have names only when they
    are shown.
    """
    parts = []
    numbers: dict[Labels, int] = {}
    for frame, mode, labels in (
        (result.positions, 0, result.position_labels),
        (result.lookthroughs, 1, result.lookthrough_labels),
    ):
        if frame is None or not labels:
            continue
        weights = f"array({', '.join(f'`{out(w)}`' for w in labels)})"
        own = _own_labels(result.views, mode, labels, numbers)
        parts.append(
            frame.selectExpr(
                REQUEST,
                *VIEW_KEYS,
                "container",
                f"{literal(POSITIONS)} AS section" if mode == 0 else "record_type AS section",
                "identifier",
                f"struct(instrument_id, sub_portfolio_id, {weights} AS weights, {own} AS labels) AS _row",
            )
        )
    if not parts:
        raise ValueError("the result has no weight columns")
    if len(parts) == 2:
        return parts[0].unionByName(parts[1]), numbers
    # from a generator of one row: a constant would be left out of the keys that rows are dealt by
    columns = [c for c in parts[0].columns if c not in (REQUEST, "section")]
    constants = F.expr(f"inline(array(named_struct('{REQUEST}', {REQUEST}, 'section', section)))")
    return parts[0].select(*columns, constants), numbers


def output_parts(
    result: ViewResult, parts: int = 1, keys: list[str] | None = None
) -> tuple[DataFrame, dict[Labels, int]]:
    """Output rows and label numbers, each row with the document part it belongs to.

    Documents are split over ``parts`` by identifier, as many for every request:
    their shape doesn't depend on how many rows there are. Of rows with one
    identifier the one with the largest instrument, sub-portfolio and weights, in this
    order, is taken; missing values are the least. Rows move once, to their section of
    a part or another group that ``keys`` name, where they are gathered as well.
    """
    rows, numbers = output_rows(result)
    placed = rows.withColumn("part", F.expr(f"int(pmod(xxhash64(identifier), {parts}))")).repartition(*(keys or SECTION_KEYS))
    return placed.groupBy(*SECTION_KEYS, "identifier").agg(F.max("_row").alias("_row")), numbers


def nested_result(result: ViewResult, parts: int = 1, keys: list[str] | None = None) -> DataFrame:
    """One row per (request, part, view, container, section) with ``{identifier: {label: weight}}``."""
    rows, numbers = output_parts(result, parts, keys)
    entry = F.struct("identifier", F.expr(_weights(numbers)).alias("weights"))
    return rows.groupBy(*SECTION_KEYS).agg(F.map_from_entries(F.collect_list(entry)).alias("rows"))


def flat_result(result: ViewResult, parts: int = 1, keys: list[str] | None = None) -> DataFrame:
    """The same as aligned arrays: ``identifiers`` and one array per label, sorted by identifier."""
    labels = list(dict.fromkeys(result.position_labels + result.lookthrough_labels))
    rows, numbers = output_parts(result, parts, keys)
    gathered = rows.groupBy(*SECTION_KEYS).agg(
        F.sort_array(
            F.collect_list(
                F.struct("identifier", *[F.expr(_weight(numbers, w)).alias(w) for w in labels])
            )
        ).alias("_rows")
    )
    return gathered.selectExpr(
        *SECTION_KEYS,
        "transform(_rows, r -> r.identifier) AS identifiers",
        *[f"transform(_rows, r -> r.`{w}`) AS `{w}`" for w in labels],
    )


def _json_name(name: str) -> str:
    """A text as a JSON string."""
    array = f"to_json(array(string({name})))"
    return f"substring({array}, 2, length({array}) - 2)"


def _document(entries: str) -> str:
    """JSON document of an array of ``(config, perspective_id, container, section, _body)``, sorted by these names."""
    levels = ["config", "perspective_id", "container"]
    before = f"get({entries}, i - 1)"

    def opened(level: int) -> list[str]:
        return [part for name in levels[level:] for part in (_json_name(f"e.{name}"), "':{'")]

    whens = [f"WHEN i = 0 THEN concat({', '.join(opened(0))})"]
    for level, name in enumerate(levels):
        close = "}" * (len(levels) - level)
        whens.append(f"WHEN NOT e.{name} <=> {before}.{name} THEN concat('{close},', {', '.join(opened(level))})")
    section = f"concat(CASE {' '.join(whens)} ELSE ',' END, {_json_name('e.section')}, ':', e._body)"
    close = "}" * (len(levels) + 2)
    return f"concat('{{\"perspective_configurations\":{{', array_join(transform({entries}, (e, i) -> {section}), ''), '{close}')"


def documents(
    result: ViewResult,
    requests: DataFrame | None = None,
    columnar: bool = False,
    parts: int = 1,
) -> DataFrame:
    """Response documents, ``{"perspective_configurations": {config: {id: {container: {...}}}}}``.

    Each of the ``parts`` is a document with some of the identifiers; part 0 also
    has the scale factors. ``requests`` adds requests
    without any position, whose document is empty. Rows are dealt by document from the
    start: neither the texts of its sections nor its own text move.
    """
    keys = [REQUEST] if parts == 1 else [REQUEST, "part"]
    if columnar:
        flat = flat_result(result, parts, keys)
        labels = [c for c in flat.columns if c not in [*SECTION_KEYS, "identifiers"]]
        arrays = ["concat('\"identifier\":', to_json(identifiers))"] + [
            f"CASE WHEN exists(`{w}`, x -> x IS NOT NULL) THEN concat({_json_name(literal(w))}, ':', "
            f"to_json(`{w}`, map('ignoreNullFields', 'false'))) END"
            for w in labels
        ]
        sections = flat.withColumn("_body", F.expr(f"concat('{{', concat_ws(',', {', '.join(arrays)}), '}}')"))
    else:
        sections = nested_result(result, parts, keys).withColumn("_body", F.expr("to_json(rows)"))
    factors = (
        result.all_scale_factors.repartition(REQUEST)
        .groupBy(REQUEST, *VIEW_KEYS, "container")
        .agg(F.map_from_entries(F.collect_list(F.struct("weight_label", "scale_factor"))).alias("_factors"))
        .select(
            REQUEST,
            F.lit(0).alias("part"),
            *VIEW_KEYS,
            "container",
            F.lit("scale_factors").alias("section"),
            F.to_json("_factors").alias("_body"),
        )
    )
    bodies = sections.select(*SECTION_KEYS, "_body").unionByName(factors).repartition(*keys)
    # bodies are copied once, to their document, and not again for each level of its objects
    entry = F.struct("config", F.col("perspective_id").cast("string").alias("perspective_id"), "container", "section", "_body")
    gathered = bodies.groupBy(REQUEST, "part").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    done = gathered.select(REQUEST, "part", F.expr(_document("_all")).alias("document"))
    if requests is None:
        return done
    return (
        requests.select(REQUEST)
        .join(done, REQUEST, "left")
        .select(
            REQUEST,
            F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce("document", F.lit('{"perspective_configurations":{}}')).alias("document"),
        )
    )


def sections(frame: DataFrame) -> list[str]:
    """Columns by which results are split into sections."""
    return present(frame, ["container", "record_type"])


def write_result(result: ViewResult, path: str, mode: str = "overwrite") -> None:
    """Parquet files of the result frames, split by config, perspective and section."""
    frames = {
        "positions": result.positions,
        "lookthroughs": result.lookthroughs,
        "scale_factors": result.all_scale_factors,
    }
    for name, frame in frames.items():
        if frame is not None:
            by = ["config", "perspective_id", *sections(frame)]
            frame.write.mode(mode).partitionBy(*by).parquet(f"{path}/{name}")


def write_colocated(positions: DataFrame, lookthroughs: DataFrame, names: tuple[str, str], buckets: int) -> None:
    """Stores both frames bucketed by the parent key, so that later runs join them without a shuffle."""
    keys = [REQUEST, "container", "sub_portfolio_id"]
    positions.write.mode("overwrite").bucketBy(buckets, "instrument_id", *keys).saveAsTable(names[0])
    lookthroughs.write.mode("overwrite").bucketBy(buckets, "parent_instrument_id", *keys).saveAsTable(names[1])
