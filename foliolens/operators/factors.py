"""Evaluation of all views over a frame in one pass.

Each distinct criterion is tested once per row, into bits. From these a row gets a
bit mask, one bit per view that keeps it, packed in a few long columns, and one
column per distinct scaling rule set. Masks travel through
joins and group-bys in place of one row per view; rows are multiplied by views
only at the end, in ``explode_views``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliolens.functions.criteria import Compared, CriteriaCompiler, literal, rule_result_columns, scope
from foliolens.model import Modifier, View, ViewSet
from foliolens.operators.skew import join_groups
from foliolens.schema import REQUEST, ROW_KEYS, SPEC, present

BITS = 62
FEW = 16
"""Numbers that a column may be compared with one by one; more of them are looked up."""
BLOCK = 32
"""Numbers of one step of such a lookup."""


def pack(flags: dict[int, str], word: int) -> Column:
    """Flags of the views of one word as bits of a long."""
    bits = [f"if({flag}, {1 << (i % BITS)}L, 0L)" for i, flag in sorted(flags.items()) if i // BITS == word]
    return F.expr(" | ".join(bits) or "0L")


def _constants(values: Iterable, kind: str) -> str:
    """A list of numbers as one constant: a plan holds it as a whole, not a node for each."""
    return f"cast(split('{','.join(map(repr, values))}', ',') AS array<{kind}>)"


def _place_of(c: Compared) -> tuple[str, str, str]:
    return c.column, c.kind, c.sort


class Planes:
    """The distinct criteria of many views, each tested once per row: bit columns ``_p<n>``.

    Where a column is compared with many numbers, its place among them is looked up
    instead (``_r<n>``): it tells all of the criteria, and the plan does not grow with them.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ranked: dict[tuple[str, str, str], list] = {}

    def know(self, criteria: Iterable[str]) -> None:
        """Finds the columns that are compared with many numbers; to be called before the tests."""
        found: dict[tuple[str, str, str], set] = {}
        for c in criteria:
            if isinstance(c, Compared):
                found.setdefault(_place_of(c), set()).add(c.value)
        self.ranked |= {key: sorted(values) for key, values in found.items() if len(values) > FEW}

    def test(self, criterion: str) -> str:
        """TRUE where the row has the criterion's bit."""
        if criterion in ("true", "false"):
            return criterion
        n = self.number.setdefault(criterion, len(self.number))
        return f"(_p{n // BITS} & {1 << (n % BITS)}L) <> 0"

    def any_of(self, wanted: dict[str, list[View]]) -> str:
        """Bits of the views one of whose criteria the row meets; a view has one criterion here."""
        ranked: dict[tuple[str, str, str], dict] = {}
        single = []
        for c, of in wanted.items():
            if isinstance(c, Compared) and _place_of(c) in self.ranked:
                bits = ranked.setdefault(_place_of(c), {})
                bits[c.value] = bits.get(c.value, 0) | _mask(of)
            else:
                single.append(f"if({self.test(c)}, {_mask(of)}L, 0L)")
        return " | ".join(single + [self._looked_up(key, bits) for key, bits in ranked.items()]) or "0L"

    def _looked_up(self, key: tuple[str, str, str], bits: dict) -> str:
        """The bits of the numbers that the row's place means are met."""
        numbers, kind = self.ranked[key], key[1]
        own = [bits.get(n, 0) for n in numbers]
        every = 0
        for b in own:
            every |= b
        if kind == "==":
            met = [0, *own]
        elif kind == "!=":
            met = [every, *[every & ~b for b in own]]
        else:  # the numbers below a place come first
            met = [0]
            for b in own if kind in (">", ">=") else reversed(own):
                met.append(met[-1] | b)
            if kind in ("<", "<="):
                met.reverse()
        return f"{_constants(met, 'bigint')}[_r{list(self.ranked).index(key)}]"

    def _places(self) -> Iterator[str]:
        """The place of each such column: of the equal number, from 1 on, or how many numbers are below. Missing ones have place 0."""
        for (column, kind, sort), numbers in self.ranked.items():
            if kind in ("==", "!="):
                yield f"int(coalesce(array_position({_constants(numbers, sort)}, {sort}({column})), 0L))"
                continue
            below = f"t -> t {'<' if kind in ('>', '<=') else '<='} {column}"
            heads = f"size(filter({_constants(numbers[::BLOCK], sort)}, {below}))"
            inner = f"size(filter(slice({_constants(numbers, sort)}, (b - 1) * {BLOCK} + 1, {BLOCK}), {below}))"
            yield f"transform(array({heads}), b -> if(b = 0, 0, (b - 1) * {BLOCK} + {inner}))[0]"

    def columns(self) -> list[Column]:
        """The columns, from a generator of one row: filters on masks would
        otherwise be moved below them, with a copy of every criterion for each use."""
        tests = list(self.number)
        words = [tests[i : i + BITS] for i in range(0, len(tests), BITS)]
        bits = [" | ".join(f"if({t}, {1 << i}L, 0L)" for i, t in enumerate(word)) for word in words]
        named = ", ".join(
            [f"'_p{n}', {sql}" for n, sql in enumerate(bits)] + [f"'_r{n}', {sql}" for n, sql in enumerate(self._places())]
        )
        return [F.expr(f"inline(array(named_struct({named})))")] if named else []


def _mask(views: list[View]) -> int:
    return sum(1 << (v.index % BITS) for v in views)


def _by_criterion(pairs: list[tuple[View, str]]) -> dict[str, list[View]]:
    found: dict[str, list[View]] = {}
    for view, criterion in pairs:
        found.setdefault(criterion, []).append(view)
    return found


Steps = tuple[View, list[str], list[tuple[str, str]]]


def mask_steps(schema: T.StructType, view: View, stop: int | None = None) -> Steps:
    """What removes rows from a view, and the steps of its rules with their links. ``stop`` is that of ``rule_states``."""
    removed = [sql for _, sql in preprocess_steps(schema, view)]
    return view, removed, [(link, sql) for _, link, sql in rule_steps(schema, view)] + postprocess_steps(schema, view, stop)


def mask_sql(steps: list[Steps], planes: Planes) -> str:
    """Bits of the views of one word that keep the row.

    All views take a step of their rules at once: a step is one bit operation per
    distinct criterion, whatever the number of views that share it, and what a view
    asks for is a bit of a constant.
    """
    views = [view for view, _, _ in steps]
    ones = _mask(views)
    removed = [(view, sql) for view, found, _ in steps for sql in found]
    programs = [(view, program) for view, _, program in steps]
    state = f"{ones}L"
    for step in range(max((len(p) for _, p in programs), default=0)):
        here = [(v, *p[step]) for v, p in programs if len(p) > step]
        narrowed = [(v, sql) for v, link, sql in here if link == "and"]
        widened = _by_criterion([(v, sql) for v, link, sql in here if link == "or"])
        if narrowed:
            others = ones & ~_mask([v for v, _ in narrowed])
            state = f"({state} & ({planes.any_of(_by_criterion(narrowed))} | {others}L))"
        if widened:
            state = f"({state} | {planes.any_of(widened)})"
    if removed:
        state = f"({state} & ~({planes.any_of(_by_criterion(removed))}))"
    specs: dict[str, list[View]] = {}
    for view in views:
        if view.spec is not None:
            specs.setdefault(view.spec, []).append(view)
    if specs:
        free = ones & ~_mask([v for of in specs.values() for v in of])
        whens = " ".join(f"WHEN {literal(spec)} THEN {_mask(of)}L" for spec, of in specs.items())
        state = f"({state} & (CASE {SPEC} {whens} ELSE 0L END | {free}L))"
    return state


def mask_words(schema: T.StructType, views: list[View], planes: Planes, stop: int | None = None) -> dict[int, str]:
    """``mask_sql`` of each word that has views."""
    steps = [mask_steps(schema, view, stop) for view in views]
    planes.know(sql for _, removed, program in steps for sql in [*removed, *(sql for _, sql in program)])
    words: dict[int, list[Steps]] = {}
    for step in steps:
        words.setdefault(step[0].index // BITS, []).append(step)
    return {word: mask_sql(of, planes) for word, of in sorted(words.items())}


def bit(view: View, prefix: str = "_m") -> str:
    """TRUE where the mask has the bit of a view."""
    return f"({prefix}{view.index // BITS} & {1 << (view.index % BITS)}L) <> 0"


class Layout:
    """Names and expressions of the mask and scale columns of a view set."""

    def __init__(self, views: ViewSet):
        self.views = views.views
        self.words = -(-len(self.views) // BITS) or 1
        self.masks = [f"_m{w}" for w in range(self.words)]
        self.scale_name: dict[int, str] = {}
        self.scale_views: dict[str, View] = {}
        seen: dict[str, str] = {}
        for view in self.views:
            if not view.scaling_rules:
                continue
            text = json.dumps([[r.apply_to, r.criteria, r.scale_factor] for r in view.scaling_rules], sort_keys=True, default=repr)
            key = f"{view.perspective_id}:{text}" if "perspective_id" in text else text
            name = seen.setdefault(key, f"_s{len(seen)}")
            self.scale_name[view.index] = name
            self.scale_views.setdefault(name, view)

    @property
    def scales(self) -> list[str]:
        return list(self.scale_views)

    def any_kept(self, prefix: str = "_m") -> Column:
        return F.expr(" OR ".join(f"{prefix}{w} <> 0" for w in range(self.words)))

    def factor(self, view: View) -> str:
        """Factor of one view, NULL where it removes the row."""
        return f"CASE WHEN {bit(view)} THEN {self.scale_name.get(view.index, '1.0D')} END"

    # The same for a view number held in a column.

    def lookup(self, values: list, number: str = "_view") -> str:
        """Element of a constant list with one value per view."""
        return f"array({', '.join(map(literal, values))})[{number}]"

    def has_bit(self, number: str = "_view", prefix: str = "_m") -> str:
        shifted = [f"shiftright({prefix}{w}, {number} - {w * BITS})" for w in range(self.words)]
        whens = [f"WHEN {number} < {(w + 1) * BITS} THEN {s}" for w, s in enumerate(shifted[:-1])]
        word = f"CASE {' '.join(whens)} ELSE {shifted[-1]} END" if whens else shifted[-1]
        return f"(({word}) & 1L) = 1L"

    def scale_of(self, number: str = "_view", prefix: str = "") -> str:
        if not self.scale_views:
            return "1.0D"
        names = self.scales
        slots = [names.index(self.scale_name[v.index]) if v.index in self.scale_name else -1 for v in self.views]
        whens = " ".join(f"WHEN {i}L THEN {prefix}{name}" for i, name in enumerate(names))
        return f"CASE {self.lookup(slots, number)} {whens} ELSE 1.0D END"


def _in_scope(compiler: CriteriaCompiler, apply_to: str, criteria: dict | None) -> str:
    criterion = compiler.sql(criteria)
    return criterion if apply_to == "both" else f"({scope(apply_to)} AND {criterion})"


def _out_of_scope_or(compiler: CriteriaCompiler, apply_to: str, criteria: dict | None) -> str:
    criterion = compiler.sql(criteria)
    return criterion if apply_to == "both" else f"(NOT {scope(apply_to)} OR {criterion})"


def preprocess_steps(schema: T.StructType, view: View) -> list[tuple[Modifier, str]]:
    """Each preprocessing modifier with the rows it removes."""
    compiler = CriteriaCompiler(schema, view.perspective_id)
    return [(m, _in_scope(compiler, m.apply_to, m.criteria)) for m in view.preprocessing]


def preprocess_sql(schema: T.StructType, view: View) -> str:
    """TRUE where no preprocessing modifier removes the row."""
    kept = [] if view.spec is None else [f"{SPEC} = {literal(view.spec)}"]
    kept += [f"NOT {removed}" for _, removed in preprocess_steps(schema, view)]
    return "(" + (" AND ".join(kept) or "true") + ")"


def rule_steps(schema: T.StructType, view: View) -> list[tuple[int, str, str]]:
    """Filter rules in order: position, connector to what came before, criterion.

    The connector is the one of the rule just before in the full list, which may
    be a scaling rule. Rows out of a rule's scope pass it.
    """
    compiler = CriteriaCompiler(schema, view.perspective_id)
    steps: list[tuple[int, str, str]] = []
    for position, rule in enumerate(view.rules):
        if rule.is_scaling:
            continue
        link = view.rules[position - 1].link if steps else None
        steps.append((position, link or "and", _out_of_scope_or(compiler, rule.apply_to, rule.criteria)))
    return steps


def rule_chain_sql(schema: T.StructType, view: View) -> str:
    """Left to right fold of the filter rules; no rule keeps everything."""
    chain = ""
    for _, link, criterion in rule_steps(schema, view):
        chain = f"({chain} {link.upper()} {criterion})" if chain else criterion
    return chain or "true"


def _post_criterion(compiler: CriteriaCompiler, modifier: Modifier) -> str:
    """``or`` adds in-scope matches, ``and`` drops in-scope rows that do not match."""
    shape = _in_scope if modifier.operator == "or" else _out_of_scope_or
    return shape(compiler, modifier.apply_to, modifier.criteria)


def apply_postprocessing(compiler: CriteriaCompiler, rule: str, modifier: Modifier) -> str:
    return f"({rule} {'OR' if modifier.operator == 'or' else 'AND'} {_post_criterion(compiler, modifier)})"


def group_modifiers(view: View) -> list[Modifier]:
    """Postprocessing modifiers that look at other rows of the same group."""
    return [m for m in view.postprocessing if rule_result_columns(m.criteria)]


def _post_compilers(schema: T.StructType, view: View, stop: int | None) -> list[tuple[Modifier, CriteriaCompiler]]:
    """The postprocessing modifiers, before the group modifier number ``stop``; one finds its own group flags."""
    found = []
    stage = 0
    for modifier in view.postprocessing:
        grouped = bool(rule_result_columns(modifier.criteria))
        if grouped and stage == stop:
            break

        def flag(column: str, number: int = stage) -> str:
            return f"coalesce({bit(view, f'_g{number}_{column}_')}, false)"

        found.append((modifier, CriteriaCompiler(schema, view.perspective_id, rule_result=flag if grouped else None)))
        stage += grouped
    return found


def postprocess_steps(schema: T.StructType, view: View, stop: int | None = None) -> list[tuple[str, str]]:
    """Link (``and`` or ``or``) and criterion of each postprocessing modifier."""
    return [
        ("or" if modifier.operator == "or" else "and", _post_criterion(compiler, modifier))
        for modifier, compiler in _post_compilers(schema, view, stop)
    ]


def rule_states(schema: T.StructType, view: View, stop: int | None = None) -> list[tuple[Modifier | None, str]]:
    """Rule outcome after the chain and after each postprocessing modifier.

    ``stop`` ends before the group modifier of that number.
    """
    states: list[tuple[Modifier | None, str]] = [(None, rule_chain_sql(schema, view))]
    for modifier, compiler in _post_compilers(schema, view, stop):
        states.append((modifier, apply_postprocessing(compiler, states[-1][1], modifier)))
    return states


def keep_sql(schema: T.StructType, view: View, stop: int | None = None) -> str:
    """Preprocessing and rules with their postprocessing: the kept rows of a view."""
    return f"({preprocess_sql(schema, view)} AND {rule_states(schema, view, stop)[-1][1]})"


def scale_sql(schema: T.StructType, view: View) -> str:
    """Product of the factors of the matching scaling rules."""
    compiler = CriteriaCompiler(schema, view.perspective_id)
    factors = [
        f"CASE WHEN {_in_scope(compiler, r.apply_to, r.criteria)} THEN {literal(float(r.scale_factor))} ELSE 1.0D END"
        for r in view.scaling_rules
    ]
    return " * ".join(factors) or "1.0D"


def with_group_flags(rows: DataFrame, views: ViewSet) -> DataFrame:
    """Adds, for views with group modifiers, which groups have a passing row.

    Passing rows are reduced to one mask per group before they move; rows whose
    key is the missing-value sentinel form one real and often huge group, which
    adaptive execution splits in the join back.
    """
    stages = max((len(group_modifiers(v)) for v in views.views), default=0)
    types = {f.name: f.dataType for f in rows.schema.fields}
    for stage in range(stages):
        wanted: dict[str, list[View]] = {}
        for view in views.views:
            modifiers = group_modifiers(view)
            if len(modifiers) > stage:
                for column in rule_result_columns(modifiers[stage].criteria):
                    if column not in types:
                        raise ValueError(f"criteria column {column!r} is not in the data")
                    wanted.setdefault(column, []).append(view)
        for column, asking in wanted.items():
            planes = Planes()
            passes = {f"_g{stage}_{column}_{w}": sql for w, sql in mask_words(rows.schema, asking, planes, stage).items()}
            specs = [SPEC] if SPEC in types else []
            groups = (
                rows.select(REQUEST, column, *specs, *planes.columns())
                .select(REQUEST, column, *[F.expr(sql).alias(n) for n, sql in passes.items()])
                .where(f"`{column}` IS NOT NULL AND ({' OR '.join(f'{n} <> 0' for n in passes)})")
                .groupBy(REQUEST, column)
                .agg(*[F.bit_or(n).alias(n) for n in passes])
            )
            rows = join_groups(rows, groups, [REQUEST, column])
    return rows


def evaluate(rows: DataFrame, views: ViewSet, carry: list[str] | None = None) -> DataFrame:
    """Mask and scale columns of every view; only the needed columns are kept.

    ``carry`` names columns to keep beside the row keys (default: all).
    """
    layout, planes = Layout(views), Planes()
    flagged = with_group_flags(rows, views)
    schema = flagged.schema
    masks = mask_words(schema, list(views.views), planes)
    kept = list(rows.columns) if carry is None else present(rows, list(dict.fromkeys([*ROW_KEYS, *carry])))
    specs = [SPEC] if SPEC in flagged.columns and SPEC not in kept else []
    tested = flagged.select(
        *kept,
        *specs,
        *planes.columns(),
        *[F.expr(scale_sql(schema, view)).alias(name) for name, view in layout.scale_views.items()],
    )
    return tested.select(
        *kept, *[F.expr(masks.get(w, "0L")).alias(name) for w, name in enumerate(layout.masks)], *layout.scales
    )


def explode_views(evaluated: DataFrame, views: ViewSet, columns: list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """One row per kept (row, view), with its factor.

    Inside the scan stage, rows are multiplied by the words of their mask that have
    views and by the bits of a word, whatever the number of views; names and factors
    are looked up for the surviving pairs only. ``extra`` adds columns
    computed from the view number ``_view``.
    """
    layout = Layout(views)
    if not views.views:
        return evaluated.selectExpr(
            *[f"`{c}`" for c in columns],
            "'' AS config",
            "0L AS perspective_id",
            "1.0D AS factor",
            *[f"double(NULL) AS {name}" for name in extra or {}],
        ).where("false")
    if layout.words == 1:
        rows = evaluated.where(layout.any_kept()).withColumn("_word", F.lit(0))
    else:  # only words with kept views, then their bits
        words = ", ".join(f"if({m} <> 0, {w}, NULL)" for w, m in enumerate(layout.masks))
        rows = evaluated.withColumn("_word", F.expr(f"explode(array_compact(array({words})))"))
    return (
        rows.withColumn("_bit", F.expr(f"explode(sequence(0, {min(BITS, len(views.views)) - 1}))"))
        .where(f"(shiftright(array({', '.join(layout.masks)})[_word], _bit) & 1L) = 1L")
        .withColumn("_view", F.expr(f"_word * {BITS} + _bit"))
        .selectExpr(
            *[f"`{c}`" for c in columns],
            f"{layout.lookup([v.config for v in views.views])} AS config",
            f"{layout.lookup([v.perspective_id for v in views.views])} AS perspective_id",
            f"{layout.scale_of()} AS factor",
            *[f"{sql} AS {name}" for name, sql in (extra or {}).items()],
        )
    )


def factors(rows: DataFrame, views: ViewSet, carry: list[str] | None = None) -> DataFrame:
    """Long factor rows of a frame: kept rows of every view with their factor."""
    carry = carry or []
    columns = present(rows, list(dict.fromkeys([*ROW_KEYS, *carry])))
    return explode_views(evaluate(rows, views, carry), views, columns)
