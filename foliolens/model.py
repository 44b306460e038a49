"""Rules, modifiers and view requests: the settings that drive the Spark jobs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

PRE, POST, SCALING = "PreProcessing", "PostProcessing", "Scaling"
APPLY_TO = ("both", "holding", "reference")
LINKS = ("and", "or")
SCALE_HOLDINGS = "scale_holdings_to_100_percent"
SCALE_LOOKTHROUGHS = "scale_lookthroughs_to_100_percent"

Requirements = dict[str, list[str]]


@dataclass(frozen=True)
class Rule:
    """One filter or scaling rule of a perspective."""

    apply_to: str = "both"
    criteria: dict | None = None
    link: str | None = None
    """Connector to the next rule; AND when missing."""
    is_scaling: bool = False
    scale_factor: float = 1.0

    def __post_init__(self):
        if self.apply_to not in APPLY_TO:
            raise ValueError(f"apply_to must be one of {APPLY_TO}, not {self.apply_to!r}")
        if self.link is not None and self.link not in LINKS:
            raise ValueError(f"rules are joined by and / or, not {self.link!r}")


@dataclass(frozen=True)
class Modifier:
    """A reusable criterion applied before, after or beside the rules."""

    name: str
    kind: str
    criteria: dict | None = None
    apply_to: str = "both"
    operator: str | None = None
    overrides: tuple[str, ...] = ()
    requires: dict = field(default_factory=dict)


def add_requirements(target: Requirements, more: dict | None) -> Requirements:
    """Merges ``{table: [columns]}`` in lower case, first seen first."""
    for table, columns in (more or {}).items():
        known = target.setdefault(table.lower(), [])
        known.extend(c for c in dict.fromkeys(c.lower() for c in columns) if c not in known)
    return target


def resolve_modifiers(requested: list[str] | None, catalogue: dict[str, Modifier], defaults: list[str]) -> list[str]:
    """Requested modifiers, then defaults, without the overridden ones."""
    names = list(dict.fromkeys([*(requested or []), *defaults]))
    overridden = {o for n in names if n in catalogue for o in catalogue[n].overrides}
    return [n for n in names if n not in overridden]


def _decoded(value: Any) -> dict:
    """An object that may be kept as JSON text; missing ones are empty."""
    return json.loads(value) if isinstance(value, str) else dict(value or {})


def read_rule(sent: dict, required: frozenset[str] = frozenset(), origin: str = "rule") -> tuple[Rule, dict]:
    """A rule from its JSON form, and the columns it needs. Percentages count for scaling rules."""
    scales = bool(sent.get("is_scaling_rule"))
    for name in sorted(required | {"scale_factor"} if scales and required else required):
        if name not in sent:
            raise ValueError(f"{origin} has no {name!r}")
    criteria = _decoded(sent.get("criteria"))
    needs = _decoded(criteria.pop("required_columns", None))
    percent = sent.get("scale_factor") if scales else None
    connector = sent.get("condition_for_next_rule")
    rule = Rule(
        sent.get("apply_to") or "both",
        criteria,
        connector.lower() if connector else None,
        scales,
        1.0 if percent is None else percent / 100,
    )
    return rule, needs


@dataclass
class RuleBook:
    """Perspectives by id, with the columns each of them needs."""

    rules: dict[int, list[Rule]] = field(default_factory=dict)
    requires: dict[int, Requirements] = field(default_factory=dict)

    @staticmethod
    def of(read: dict[int, list[tuple[Rule, dict]]]) -> RuleBook:
        book = RuleBook()
        for pid, pairs in read.items():
            book.rules[pid] = [rule for rule, _ in pairs]
            needs: Requirements = {}
            for _, more in pairs:
                add_requirements(needs, more)
            if needs:
                book.requires[pid] = needs
        return book

    def over(self, other: RuleBook) -> RuleBook:
        """This book, completed by another for the ids it lacks."""
        return RuleBook({**other.rules, **self.rules}, {**other.requires, **self.requires})


def stored_rules(definitions: dict[int, dict]) -> RuleBook:
    """Catalogue perspectives ``{id: {is_active, is_supported, rules}}``.

    Inactive and unsupported ones are left out: their ids then have no rules.
    """
    usable = {int(pid): d for pid, d in definitions.items() if d.get("is_active", True) and d.get("is_supported", True)}
    return RuleBook.of({pid: [read_rule(r) for r in d.get("rules", [])] for pid, d in usable.items()})


SENT_FIELDS = frozenset({"criteria", "apply_to"})


def custom_rules(definitions: dict | None) -> RuleBook:
    """Perspectives sent along with a request, keyed by ids that are not positive.

    One with an empty list of rules is as good as none: it keeps everything.
    """
    sent = {int(pid): body for pid, body in (definitions or {}).items()}
    if sent and max(sent) > 0:
        raise ValueError("ids of custom perspectives must be negative")
    bare = [pid for pid, body in sent.items() if "rules" not in body]
    if bare:
        raise ValueError(f"custom perspectives {bare} have no 'rules'")
    read = {
        pid: [read_rule(r, SENT_FIELDS, f"rule {n} of custom perspective {pid}") for n, r in enumerate(body["rules"])]
        for pid, body in sent.items()
        if body["rules"]
    }
    return RuleBook.of(read)


@dataclass(frozen=True)
class View:
    """One (config, perspective) to evaluate: rules plus resolved modifiers."""

    index: int
    config: str
    perspective_id: int
    rules: tuple[Rule, ...]
    modifiers: tuple[Modifier, ...]
    flags: frozenset[str]
    spec: str | None = None

    @property
    def preprocessing(self) -> list[Modifier]:
        return [m for m in self.modifiers if m.kind == PRE and m.criteria]

    @property
    def postprocessing(self) -> list[Modifier]:
        return [m for m in self.modifiers if m.kind == POST and m.criteria]

    @property
    def scaling_rules(self) -> list[Rule]:
        return [r for r in self.rules if r.is_scaling]

    @property
    def rescales_holdings(self) -> bool:
        return SCALE_HOLDINGS in self.flags

    @property
    def rescales_lookthroughs(self) -> bool:
        return SCALE_LOOKTHROUGHS in self.flags


Labels = dict[str, tuple[list[str], list[str]]]


LABEL_LISTS = ("position_weight_labels", "lookthrough_weight_labels")


def container_labels(request: dict) -> Labels:
    """Weight labels per container: its own lists, or the request's when missing or empty."""

    def first(*lists: list[str] | None) -> list[str]:
        return next(([x.lower() for x in found] for found in lists if found), [])

    holders = {name: part for name, part in request.items() if isinstance(part, dict) and "positions" in part}
    return {name: tuple(first(part.get(m), request.get(m)) for m in LABEL_LISTS) for name, part in holders.items()}


def union_labels(labels: Labels, mode: int) -> list[str]:
    return list(dict.fromkeys(label for pair in labels.values() for label in pair[mode] or []))


@dataclass(frozen=True)
class ViewSet:
    """All views of a run, with the weight labels of their containers."""

    views: tuple[View, ...]
    labels: dict[str | None, Labels]
    lookthrough_criteria: dict | None = None

    @staticmethod
    def build(
        configs: dict[str, dict[Any, list[str] | None]],
        labels: Labels,
        book: RuleBook | None = None,
        modifiers: dict[str, Modifier] | None = None,
        defaults: list[str] | None = None,
        spec: str | None = None,
    ) -> ViewSet:
        from foliolens.plans.modifiers import DEFAULT_MODIFIERS, MODIFIERS

        catalogue = MODIFIERS if modifiers is None else modifiers
        defaults = DEFAULT_MODIFIERS if defaults is None else defaults
        book = book or RuleBook()
        views = []
        for config, perspectives in configs.items():
            by_id = {int(pid): names for pid, names in perspectives.items()}
            for pid in sorted(by_id):
                names = resolve_modifiers(by_id[pid], catalogue, defaults)
                views.append(
                    View(
                        index=len(views),
                        config=config,
                        perspective_id=pid,
                        rules=tuple(book.rules.get(pid, [])),
                        modifiers=tuple(catalogue[n] for n in names if n in catalogue),
                        flags=frozenset(names),
                        spec=spec,
                    )
                )
        lookthrough = catalogue.get(SCALE_LOOKTHROUGHS)
        return ViewSet(tuple(views), {spec: labels}, lookthrough.criteria if lookthrough else None)

    @staticmethod
    def merge(sets: list[ViewSet]) -> ViewSet:
        """One set for a batch of requests with different specifications."""
        views = [v for s in sets for v in s.views]
        labels: dict[str | None, Labels] = {}
        for s in sets:
            labels.update(s.labels)
        return ViewSet(
            tuple(replace(v, index=i) for i, v in enumerate(views)),
            labels,
            sets[0].lookthrough_criteria if sets else None,
        )

    def _labels(self, mode: int) -> list[str]:
        return list(dict.fromkeys(label for labels in self.labels.values() for label in union_labels(labels, mode)))

    @property
    def position_labels(self) -> list[str]:
        return self._labels(0)

    @property
    def lookthrough_labels(self) -> list[str]:
        return self._labels(1)

    @property
    def all_labels(self) -> list[str]:
        return list(dict.fromkeys(self.position_labels + self.lookthrough_labels))
