"""Views over generated tables, for every combination of settings, against a plain model."""

from __future__ import annotations

import itertools
import random

import pytest

from foliolens import Modifier, ViewSet, custom_rules, process_tables
from foliolens.registry.inputs import rule, test as crit  # noqa: F401
from tests.conftest import table

HOLD = "scale_holdings_to_100_percent"
LOOK = "scale_lookthroughs_to_100_percent"
SECTIONS = ("essential_lookthroughs", "complete_lookthroughs")
COLUMNS = "container string, record_type string, identifier string, instrument_id bigint, sub_portfolio_id bigint, mass double, barred boolean, spared boolean, grade bigint, tier bigint"
CHILD_COLUMNS = COLUMNS + ", parent_instrument_id bigint, part double"


def is_true(name):
    return crit(name, "==", True)


def made_tables(seed):
    """Positions of two sub portfolios and children of some of them, with random attributes."""
    rng = random.Random(seed)

    def attributes(name, instrument, sub):
        return {"container": "holding", "identifier": name, "instrument_id": instrument, "sub_portfolio_id": sub,
                "mass": rng.randint(1, 64) / 128, "barred": rng.random() < 0.3, "spared": rng.random() < 0.4,
                "grade": rng.randint(1, 4), "tier": rng.randint(1, 4)}

    positions = [attributes(f"p{i}", i, i % 2) | {"record_type": "positions"} for i in range(9)]
    children = []
    for i in range(14):
        parent = rng.randrange(11)  # some have no parent row
        extra = {"record_type": SECTIONS[i % 3 == 0], "parent_instrument_id": parent, "part": rng.randint(1, 32) / 32}
        children.append(attributes(f"c{i}", 100 + i, parent % 2) | extra)
    return positions, children


# Each axis: what a view may have, by name.
RULES = {
    "none": [], "grade": ["grade"], "grade and tier": ["grade", "tier"], "grade or tier": ["grade/or", "tier"],
}
SCALES = {"plain": [], "halved": ["half"], "twice scaled": ["half", "fifth"]}
MODIFIERS = [(), ("bar",), ("spare",), ("insist",), ("bar", "spare")]
FLAGS = [(), (HOLD,), (LOOK,), (HOLD, LOOK)]
VIEWS = list(itertools.product(RULES, SCALES, MODIFIERS, FLAGS))
TESTS = {"grade": lambda r: r["grade"] > 2, "tier": lambda r: r["tier"] <= 2, "half": lambda r: r["grade"] % 2 == 1, "fifth": lambda r: r["tier"] == 3}
WRITTEN = {
    "grade": rule(crit("grade", ">", 2)), "grade/or": rule(crit("grade", ">", 2), link="or"), "tier": rule(crit("tier", "<=", 2)),
    "half": rule(crit("grade", "In", [1, 3]), percent=50), "fifth": rule(crit("tier", "==", 3), percent=20),
}


def passes(row, rules, modifiers):
    outcomes = [TESTS[r.split("/")[0]](row) for r in RULES[rules]]
    kept = (any if "or" in rules else all)(outcomes) if outcomes else True
    if "spare" in modifiers:
        kept = kept or row["spared"]
    if "insist" in modifiers:
        kept = kept and row["spared"]
    return kept and not ("bar" in modifiers and row["barred"])


def factor(row, scales):
    found = 1.0
    for name, size in (("half", 0.5), ("fifth", 0.2)):
        if name in SCALES[scales] and TESTS[name](row):
            found *= size
    return found


def model(positions, children, view):
    """Output masses, output parts and the scale factor of one view."""
    rules, scales, modifiers, flags = view
    left = {p["identifier"]: (p, factor(p, scales)) for p in positions if passes(p, rules, modifiers)}
    parents = {(p["instrument_id"], p["sub_portfolio_id"]) for p, _ in left.values()}
    kids = {c["identifier"]: (c, factor(c, scales)) for c in children if passes(c, rules, modifiers) and (c["parent_instrument_id"], c["sub_portfolio_id"]) in parents}
    share = 1.0
    out = {i: p["mass"] * f for i, (p, f) in left.items()}
    if HOLD in flags:
        essential = [(c, f) for c, f in kids.values() if c["record_type"] == SECTIONS[0]]
        mass = sum(out.values()) + sum(c["mass"] * f for c, f in essential)
        raw = sum(p["mass"] for p in positions) + sum(c["mass"] for c in children if c["record_type"] == SECTIONS[0])
        if mass:
            out, share = {i: m / mass for i, m in out.items()}, mass / raw
    parts = {i: c["part"] * f for i, (c, f) in kids.items()}
    if LOOK in flags:
        group = lambda c: (c["parent_instrument_id"], c["sub_portfolio_id"], c["record_type"])
        sums = {}
        for c, f in kids.values():
            sums[group(c)] = sums.get(group(c), 0.0) + c["part"] * f
        parts = {i: c["part"] * f / sums[group(c)] for i, (c, f) in kids.items()}
    return out, parts, share


@pytest.fixture(scope="module", params=[11, 12])
def lattice(request, spark):
    positions, children = made_tables(request.param)
    catalogue = {
        "bar": Modifier("bar", "PreProcessing", is_true("barred")),
        "spare": Modifier("spare", "PostProcessing", is_true("spared"), "both", "or"),
        "insist": Modifier("insist", "PostProcessing", is_true("spared"), "both", "and"),
        HOLD: Modifier(HOLD, "Scaling"), LOOK: Modifier(LOOK, "Scaling"),
    }
    numbers = [str(-n) for n in range(1, len(VIEWS) + 1)]
    written = [[WRITTEN[x] for x in [*RULES[r], *SCALES[s]]] for r, s, _, _ in VIEWS]
    views = ViewSet.build(
        {"c": {n: [*mods, *flags] for n, (_, _, mods, flags) in zip(numbers, VIEWS, strict=True)}},
        {"holding": (["mass"], ["part"])},
        custom_rules({n: {"rules": rules} for n, rules in zip(numbers, written, strict=True)}),
        catalogue,
        [],
    )
    result = process_tables(table(spark, positions, COLUMNS), table(spark, children, CHILD_COLUMNS), views)
    found = {i: ({}, {}, {}) for i in range(len(VIEWS))}
    for frame, slot, column in ((result.positions, 0, "out_mass"), (result.lookthroughs, 1, "out_part")):
        for r in frame.collect():
            found[-r["perspective_id"] - 1][slot][r["identifier"]] = r[column]
    for r in result.all_scale_factors.collect():
        found[-r["perspective_id"] - 1][2][r["weight_label"]] = r["scale_factor"]
    return positions, children, found


def test_every_combination(lattice):
    positions, children, found = lattice
    for i, view in enumerate(VIEWS):
        masses, parts, share = model(positions, children, view)
        assert found[i][0] == pytest.approx(masses), view
        assert found[i][1] == pytest.approx(parts), view
        assert found[i][2] == pytest.approx({"mass": share}), view


S_POSITION = "container string, identifier string, instrument_id bigint, sub_portfolio_id bigint, simulated_trade_id bigint, initial_weight double, gone boolean, passes boolean"
S_CHILD = S_POSITION + ", parent_instrument_id bigint, record_type string"
IN_RESULT = crit("simulated_trade_id", "In", {"table_name": "rule_result", "column": "result", "operator_type": "==", "value": True})


def saviour(spark, rows, negate=False):
    post = dict(IN_RESULT, operator_type="NotIn") if negate else IN_RESULT
    modifiers = {
        "pre": Modifier("pre", "PreProcessing", is_true("gone")),
        "post": Modifier("post", "PostProcessing", post, "both", "or"),
    }
    views = ViewSet.build(
        {"c": {"-1": ["pre", "post"]}}, {"holding": (["initial_weight"], [])},
        custom_rules({"-1": {"rules": [rule(is_true("passes"))]}}), modifiers, [],
    )
    data = [
        {"container": "holding", "identifier": i, "instrument_id": n, "sub_portfolio_id": 1, "simulated_trade_id": g,
         "initial_weight": 0.1, "gone": gone, "passes": ok}
        for n, (i, g, gone, ok) in enumerate(rows)
    ]
    result = process_tables(table(spark, data, S_POSITION), None, views)
    return {r["identifier"] for r in result.positions.collect()}


def test_saviour_does_not_see_preprocessed_rows(spark):
    assert saviour(spark, [("a", 100, True, True), ("b", 100, False, False), ("c", 200, False, True)]) == {"c"}


def test_saviour_by_group(spark):
    rows = [("a", 100, True, True), ("b", 100, False, False), ("c", 200, False, True), ("d", 300, False, False),
            ("e", 300, False, False), ("f", 400, False, True), ("g", 400, False, False)]
    assert saviour(spark, rows) == {"c", "f", "g"}


def test_saviour_not_in(spark):
    rows = [("a", 100, False, True), ("b", 100, False, False), ("c", 200, False, False), ("d", None, False, False)]
    assert saviour(spark, rows, negate=True) == {"a", "c", "d"}


def test_rows_without_group_key_are_one_group(spark):
    assert saviour(spark, [("a", None, False, True), ("b", None, False, False), ("c", 5, False, False)]) == {"a", "b"}


def test_sync_per_sub_portfolio_and_orphans(spark):
    def p(i, instrument, sub, ok):
        return {"container": "holding", "identifier": i, "instrument_id": instrument, "sub_portfolio_id": sub,
                "initial_weight": 0.5, "gone": False, "passes": ok}

    def c(i, parent, sub):
        return p(i, 90 + parent, sub, True) | {"parent_instrument_id": parent, "record_type": "essential_lookthroughs"}

    views = ViewSet.build(
        {"c": {"-1": []}}, {"holding": (["initial_weight"], ["initial_weight"])},
        custom_rules({"-1": {"rules": [rule(is_true("passes"))]}}), {}, [],
    )
    positions = [p("pos_1", 1, 100, False), p("pos_2", 1, 200, True), p("pos_3", 2, 100, True), p("dup", 1, 200, False)]
    children = [c("elt_1", 1, 100), c("elt_2", 1, 200), c("orphan", 7, 100)]
    result = process_tables(table(spark, positions, S_POSITION), table(spark, children, S_CHILD), views)
    assert {r["identifier"] for r in result.positions.collect()} == {"pos_2", "pos_3"}
    assert {r["identifier"] for r in result.lookthroughs.collect()} == {"elt_2"}
