"""Batches of JSON requests, each with its own views and labels."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count, islice

from pyspark.sql import DataFrame, functions as F

from foliolens.functions.criteria import Parameter, literal
from foliolens.model import Modifier, RuleBook, ViewSet, container_labels, custom_rules
from foliolens.operators.factors import keep_sql, scale_sql
from foliolens.operators.normalize import normalize
from foliolens.operators.output import documents
from foliolens.operators.reference import MOMENT, ReferenceTables, attach_reference
from foliolens.plans.pipeline import ViewResult, run_views
from foliolens.plans.reuse import materialize_if_possible, settings, stored_while
from foliolens.schema import CONTAINERS, LOOKTHROUGHS, POSITIONS, RECORD_TYPES, REQUEST, SPEC
from foliolens.sources.requests import NAMED, PARSED, READING, inflate_requests, may_name, section_names, with_request_ids

SPECS = 1000
"""Specifications of one plan; a batch with more has several plans."""

STORING = {
    # names in requests are their own: columns of the names of the first ones fit no others
    "spark.sql.variant.inferShreddingSchema": "false",
    # texts are gathered in the order of one sort, and not hashed for the first few of a task before that
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    **READING,
}
"""Settings under which requests are gathered and stored."""

SPEC_PARTS = ["perspective_configurations", "custom_perspective_rules", "position_weight_labels", "lookthrough_weight_labels"]


RULES = "custom_perspective_rules"
NUMBERS = "_spec_numbers"
"""Array column of the numbers that the criteria of a request compare with."""
NUMBER = r'(?<=[{,]"value":)(-?(?:\d{1,15}|\d+(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+)))(?=[,}])'
"""One in JSON that a double stands for; longer whole numbers stay in the specification."""
MARK = "NaN"
"""What a specification has in the place of a number: no JSON text has it."""


def with_specs(requests: DataFrame) -> DataFrame:
    """Adds the specification of each request, everything but its rows, its hash, its date and its sections.

    The numbers that its own criteria compare with are no part of it but columns: requests
    that differ in them alone share their views. ``sections`` maps its containers to their
    section names and is NULL where the request is no JSON object. The parsed request stays
    beside it: parsing again would go through the names of all rows a second time.
    """

    def part(path: str, name: str) -> str:
        return f"'{name}', to_json(variant_get({PARSED}, '$.{path}', 'variant'))"

    rules = f"to_json(variant_get({PARSED}, '$.{RULES}', 'variant'))"
    general = f"regexp_replace({rules}, {literal(NUMBER)}, '{MARK}')"
    numbers = f"cast(regexp_extract_all({rules}, {literal(NUMBER)}, 1) AS array<double>)"
    paths = [f"'{p}', {general}" if p == RULES else part(p, p) for p in SPEC_PARTS]
    for container in CONTAINERS:
        for mode in ("position_weight_labels", "lookthrough_weight_labels"):
            paths.append(part(f"{container}.{mode}", f"{container}.{mode}"))
    moments = [f"try_variant_get({PARSED}, '$.{name}', 'string')" for name in ("system_version_timestamp", "ed")]
    return (
        requests.withColumn(PARSED, F.expr("try_parse_json(request)"))
        .withColumn("spec", F.expr(f"to_json(map_filter(map({', '.join(paths)}), (k, v) -> v IS NOT NULL))"))
        .withColumn(SPEC, F.sha2("spec", 256))
        .withColumn(MOMENT, F.expr(f"coalesce({', '.join(moments)})"))
        .withColumn("sections", F.expr(section_names(PARSED)))
        .withColumn(NUMBERS, F.expr(numbers))
    )


def parse_spec(text: str) -> dict:
    """A specification as the request that has it, with empty containers and parameters for its numbers."""
    place = count()
    parts = {k: json.loads(v, parse_constant=lambda _: Parameter(NUMBERS, next(place))) for k, v in json.loads(text).items()}
    request = {p: parts.get(p) for p in SPEC_PARTS}
    for container in CONTAINERS:
        request[container] = {"positions": {}}
        for mode in ("position_weight_labels", "lookthrough_weight_labels"):
            request[container][mode] = parts.get(f"{container}.{mode}")
    return request


COPIES = "copies"


class BatchResult:
    """The frames of a batch: those of all its plans together, a copy of a request with rows of its own."""

    def __init__(self, blocks: list[tuple[DataFrame, ViewResult]]):
        self._blocks = blocks

    def _all(self, name: str) -> DataFrame | None:
        """The rows of the plans whose results have this frame."""
        found = []
        for known, result in self._blocks:
            frame = getattr(result, name)
            if frame is not None:
                again = F.explode(F.sequence(F.lit(1), F.col(COPIES).cast("int")))
                copies = known.select(REQUEST, COPIES).where(f"{COPIES} > 1")
                found.append(
                    frame.join(copies, REQUEST, "left")
                    .withColumn(COPIES, F.coalesce(COPIES, F.lit(1)))
                    .withColumn("_copy", again)
                    .select(*frame.columns)
                )
        if not found:
            return None
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    @cached_property
    def positions(self) -> DataFrame:
        return self._all("positions")

    @cached_property
    def lookthroughs(self) -> DataFrame | None:
        return self._all("lookthroughs")

    @cached_property
    def scale_factors(self) -> DataFrame | None:
        return self._all("scale_factors")

    @cached_property
    def all_scale_factors(self) -> DataFrame:
        return self._all("all_scale_factors")


@dataclass
class RequestRun:
    """Requests and their lazy results, one for each block of specifications.

    ``requests`` come from their source again where they are asked for: no texts are stored. ``errors`` has a row ``(request_id, error)`` for each request that is refused;
    it doesn't touch the others.
    """

    requests: DataFrame
    blocks: list[tuple[DataFrame, ViewResult | None]]
    errors: DataFrame

    @property
    def result(self) -> BatchResult | None:
        """The results of all blocks that have views, with copies of equal requests restored."""
        found = [(known, result) for known, result in self.blocks if result is not None]
        return BatchResult(found) if found else None

    def documents(self, columnar: bool = False, parts: int = 1) -> DataFrame:
        """The responses of every accepted request, each in as many parts; copies are answered alike."""
        made = [self._documents(known, result, columnar, parts) for known, result in self.blocks]
        if not made:
            return self.requests.select(REQUEST, F.lit(0).alias("part"), F.lit("").alias("document")).where("false")
        return functools.reduce(DataFrame.unionByName, made)

    @staticmethod
    def _documents(known: DataFrame, result: ViewResult | None, columnar: bool, parts: int) -> DataFrame:
        if result is None:
            empty = F.lit('{"perspective_configurations":{}}').alias("document")
            done = known.select(REQUEST, F.lit(0).alias("part"), empty)
        else:
            done = documents(result, known, columnar, parts)
        again = F.explode(F.sequence(F.lit(1), F.col(COPIES).cast("int")))
        return done.join(known.select(REQUEST, COPIES), REQUEST).withColumn("_copy", again).select(REQUEST, "part", "document")


def distinct_requests(requests: DataFrame) -> DataFrame:
    """Equal requests as one row with the number of its copies."""
    known = with_request_ids(requests).groupBy(REQUEST, F.sha2("request", 256).alias("_hash"))
    return known.agg(F.first("request").alias("request"), F.count(F.lit(1)).alias(COPIES)).drop("_hash")


def unreadable(known: DataFrame) -> DataFrame:
    """Requests that can't be told apart or parsed, and those with unknown sections."""
    twice = known.groupBy(REQUEST).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    clash = twice.select(REQUEST, F.lit("several requests have this id").alias("error"))
    broken = known.where("sections IS NULL").select(REQUEST, F.lit("the request is not a JSON object").alias("error"))
    names = known.select(REQUEST, F.explode("sections").alias("container", "record_type")).groupBy(REQUEST).agg(
        F.array_sort(F.collect_set("container")).alias("containers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("record_type")))).alias("sections"),
    )
    odd = names.select(REQUEST, *[F.array_except(c, F.array(*map(F.lit, domain))).alias(c) for c, domain in (("containers", CONTAINERS), ("sections", RECORD_TYPES))])
    unknown = odd.where("size(containers) + size(sections) > 0").select(
        REQUEST,
        F.when(F.size("containers") > 0, F.concat(F.lit("unknown container: "), F.array_join("containers", ", ")))
        .otherwise(F.concat(F.lit("unknown record_type: "), F.array_join("sections", ", ")))
        .alias("error"),
    )
    return clash.union(broken).union(unknown)


def without_mandatory(positions: DataFrame, lookthroughs: DataFrame) -> DataFrame:
    """Requests with a frame of rows that nowhere has the mandatory column."""
    found = []
    for frame in (positions, lookthroughs):
        names = [c for c in frame.columns if c.lower() == "sub_portfolio_id"]
        given = F.col(names[0]).isNotNull() if names else F.lit(False)
        found.append(frame.groupBy(REQUEST).agg(F.bool_or(given).alias("given")).where("NOT given").select(REQUEST))
    missing = found[0].union(found[1]).distinct()
    return missing.select(REQUEST, F.lit("column sub_portfolio_id is missing").alias("error"))


def spec_blocks(known: DataFrame) -> Iterator[dict[str, dict]]:
    """The distinct specifications, ``SPECS`` at a time: they define the plans, so the driver needs them."""
    rows = known.select(SPEC, "spec").distinct().orderBy(SPEC).toLocalIterator()
    while block := list(islice(rows, SPECS)):
        yield {row[SPEC]: parse_spec(row["spec"]) for row in block}


def refusals(own: DataFrame, refused: list[tuple[str, str]]) -> DataFrame:
    """The requests of refused specifications, with the numbers of each in its error."""
    table = own.sparkSession.createDataFrame(refused, f"{SPEC} string, error string")
    error = F.col("error")
    for place in sorted({int(n) for _, text in refused for n in re.findall(rf"\{{{NUMBERS}\[(\d+)\]\}}", text)}):
        parameter = Parameter(NUMBERS, place)
        number = literal(parameter)
        text = F.expr(f"if({number} = floor({number}) AND abs({number}) < 1e15D, string(bigint({number})), string({number}))")
        error = F.replace(error, F.lit(repr(parameter)), F.coalesce(text, F.lit(repr(parameter))))
    return own.join(table, SPEC).select(REQUEST, error.alias("error"))


def spec_groups(requests: DataFrame, groups: int) -> list[DataFrame]:
    """Splits a batch into groups of requests with few different specifications each."""
    known = with_specs(with_request_ids(requests))
    number = F.pmod(F.xxhash64(SPEC), F.lit(groups))
    return [known.where(number == i).select(REQUEST, "request") for i in range(groups)]


def _views(spec: str, request: dict, book: RuleBook | None, modifiers, defaults) -> ViewSet:
    custom = custom_rules(request["custom_perspective_rules"])
    rules = custom.over(book) if book else custom
    return ViewSet.build(request["perspective_configurations"] or {}, container_labels(request), rules, modifiers, defaults, spec)


def _fits(views: ViewSet, frames: list[DataFrame]) -> None:
    """Raises where a criterion doesn't fit the columns that it tests."""
    for frame in frames:
        for view in views.views:
            keep_sql(frame.schema, view)
            scale_sql(frame.schema, view)


def process_requests(
    requests: DataFrame,
    book: RuleBook | None = None,
    types: dict[str, str] | None = None,
    reference: ReferenceTables | None = None,
    modifiers: dict[str, Modifier] | None = None,
    defaults: list[str] | None = None,
    carry: list[str] | None = None,
    reuse: str = "masses",
) -> RequestRun:
    """Evaluates every request alone; one that can't be evaluated becomes an error row.

    ``requests`` has a text column ``request`` and optionally ``request_id``.
    ``types`` gives the attribute types; without it they are inferred.
    """
    given = with_specs(distinct_requests(requests))
    # parsed requests go when all their rows are stored; only few columns of them are needed later
    with stored_while(given.withColumn(NAMED, may_name()).drop("request"), STORING) as parsed:
        known = materialize_if_possible(parsed.drop(PARSED, NAMED))
        blocks, errors = _evaluated(known, parsed, book, types, reference, modifiers, defaults, carry, reuse)
    return RequestRun(given.drop(PARSED), blocks, errors)


def _evaluated(
    known: DataFrame, parsed: DataFrame, book, types, reference, modifiers, defaults, carry, reuse
) -> tuple[list[tuple[DataFrame, ViewResult | None]], DataFrame]:
    """The blocks of a batch and its errors, from the requests without and with their parsed texts."""
    errors = materialize_if_possible(unreadable(known))
    readable = known.join(errors, REQUEST, "left_anti")
    blocks: list[tuple[DataFrame, ViewResult | None]] = []
    for specs in spec_blocks(readable):
        own = readable.where(F.col(SPEC).isin(list(specs)))
        texts = parsed.join(errors, REQUEST, "left_anti").where(F.col(SPEC).isin(list(specs)))
        raw = inflate_requests(texts, types, [SPEC, MOMENT, NUMBERS])
        missing = materialize_if_possible(without_mandatory(*raw))  # few, and every frame leaves them out
        errors = errors.union(missing)
        own = own.join(missing, REQUEST, "left_anti")
        raw = tuple(frame.join(missing, REQUEST, "left_anti") for frame in raw)
        sets, refused = [], []
        for spec, request in specs.items():
            try:
                sets.append(_views(spec, request, book, modifiers, defaults))
            except (ValueError, TypeError, AttributeError) as error:
                refused.append((spec, str(error)))
        frames = _prepared(raw, ViewSet.merge(sets).all_labels, reference)
        fitting = []
        for views in sets:
            try:
                _fits(views, [f for f in frames if f is not None])
                fitting.append(views)
            except ValueError as error:
                refused.append((next(iter(views.labels)), str(error)))
        if refused:
            errors = errors.union(refusals(own, refused))
            bad = [spec for spec, _ in refused]
            own = own.where(~F.col(SPEC).isin(bad))
            frames = _prepared(tuple(f.where(~F.col(SPEC).isin(bad)) for f in raw), ViewSet.merge(fitting).all_labels, reference)
        views = ViewSet.merge(fitting)
        # a request's text was parsed by one task, so its rows may be in one as well
        result = run_views(*frames, views, [SPEC, *(carry or [])], reuse, [REQUEST]) if views.views else None
        blocks.append((own, result))
    return blocks, errors


def _prepared(raw: tuple[DataFrame, DataFrame], labels: list[str], reference: ReferenceTables | None):
    raw = tuple(f if "sub_portfolio_id" in map(str.lower, f.columns) else f.withColumn("sub_portfolio_id", F.lit(None).cast("long")) for f in raw)
    positions, lookthroughs = normalize(raw[0], labels, POSITIONS), normalize(raw[1], labels, LOOKTHROUGHS)
    return (positions, lookthroughs) if reference is None else attach_reference(positions, lookthroughs, reference)
