"""From tables to views: the whole evaluation as one declarative plan."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from foliolens.model import ViewSet
from foliolens.operators.factors import evaluate
from foliolens.operators.lookthrough import sync_lookthroughs
from foliolens.operators.normalize import normalize
from foliolens.operators.reference import ReferenceTables, attach_reference
from foliolens.operators.rescale import (
    Totals,
    container_masses,
    sync_and_rescale_lookthroughs,
    weigh,
    with_container_totals,
)
from foliolens.operators.scale_factors import complete_scale_factors, scale_factors
from foliolens.plans.reuse import materialize, materialize_if_possible
from foliolens.schema import ESSENTIAL, GROUP_KEYS, LOOKTHROUGHS, POSITIONS, REQUEST, ROW_KEYS, SPEC, present


REUSE = ("plan", "masses", "all")


class ViewResult:
    """Lazy result frames of all views; each is planned when it is asked for.

    ``positions`` and ``lookthroughs`` have one row per kept (row, view): raw
    weights keep their names, output weights are ``out_<label>``, removed rows
    are absent. ``scale_factors`` is None when no view rescales holdings;
    ``all_scale_factors`` completes it for every view.
    """

    def __init__(
        self,
        positions: DataFrame,
        lookthroughs: DataFrame | None,
        views: ViewSet,
        carry: list[str],
        reuse: str,
        deal: list[str] | None = None,
    ):
        self.raw_positions = positions
        self.raw_lookthroughs = lookthroughs
        self.views = views
        self.position_labels = present(positions, views.position_labels)
        self.lookthrough_labels = [] if lookthroughs is None else present(lookthroughs, views.lookthrough_labels)
        self._keep = [*views.all_labels, *carry]
        if reuse not in REUSE:
            raise ValueError(f"reuse must be one of {REUSE}, not {reuse!r}")
        self._reuse = reuse
        self._deal = deal

    def _store(self, df: DataFrame) -> DataFrame:
        return materialize(df) if self._reuse == "all" else df

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(*self._deal) if self._deal else df

    @property
    def rescales_holdings(self) -> bool:
        return any(v.rescales_holdings for v in self.views.views) and bool(self.position_labels)

    @property
    def rescales_lookthroughs(self) -> bool:
        return any(v.rescales_lookthroughs for v in self.views.views) and bool(self.lookthrough_labels)

    @cached_property
    def evaluated_positions(self) -> DataFrame:
        return self._store(evaluate(self.raw_positions, self.views, self._keep))

    @cached_property
    def evaluated_lookthroughs(self) -> DataFrame | None:
        if self.raw_lookthroughs is None:
            return None
        return self._store(evaluate(self.raw_lookthroughs, self.views, self._keep))

    @cached_property
    def masses(self) -> DataFrame | None:
        """Packed container masses, when a view rescales holdings."""
        if not self.rescales_holdings:
            return None
        essential = None
        if self.raw_lookthroughs is not None and present(self.raw_lookthroughs, self.position_labels):
            children = self.evaluated_lookthroughs.where(F.col("record_type") == ESSENTIAL)
            essential = sync_lookthroughs(
                children, self.evaluated_positions, self.views, keep_removed=True
            )
        packed = container_masses(self.evaluated_positions, essential, self.views, self.position_labels)
        return packed if self._reuse == "plan" else materialize_if_possible(packed)

    def _columns(self, frame: DataFrame, labels: list[str]) -> list[str]:
        return present(frame, list(dict.fromkeys([*ROW_KEYS, *labels, *self._keep])))

    @cached_property
    def positions(self) -> DataFrame:
        rows, totals = self.evaluated_positions, None
        if self.masses is not None:
            rows, totals = with_container_totals(rows, self.views, self.position_labels, self.masses)
        carry = self._columns(self.raw_positions, self.position_labels)
        return weigh(self._dealt(rows), self.views, self.position_labels, totals, carry)

    @cached_property
    def lookthroughs(self) -> DataFrame | None:
        if self.raw_lookthroughs is None:
            return None
        rows, totals = self.synced_lookthroughs()
        return weigh(
            self._dealt(rows),
            self.views,
            self.lookthrough_labels,
            totals,
            self._columns(self.raw_lookthroughs, self.lookthrough_labels),
        )

    def synced_lookthroughs(self, keep_removed: bool = False) -> tuple[DataFrame, Totals | None]:
        """Evaluated child rows in step with their parents, with their divisors."""
        children, parents = self.evaluated_lookthroughs, self.evaluated_positions
        if self.rescales_lookthroughs:
            return sync_and_rescale_lookthroughs(
                children, parents, self.raw_positions, self.views, self.lookthrough_labels, keep_removed
            )
        return sync_lookthroughs(children, parents, self.views, keep_removed), None

    @cached_property
    def _specs(self) -> DataFrame | None:
        if SPEC not in self.raw_positions.columns:
            return None
        return self.raw_positions.select(REQUEST, SPEC).distinct()

    @cached_property
    def scale_factors(self) -> DataFrame | None:
        if self.masses is None:
            return None
        return scale_factors(self.masses, self.views, self.position_labels, self._specs)

    @cached_property
    def all_scale_factors(self) -> DataFrame:
        source = self.raw_positions if self.masses is None else self.masses
        containers = source.select(*GROUP_KEYS).distinct()
        return complete_scale_factors(containers, self.scale_factors, self.views, self.position_labels, self._specs)


def run_views(
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    views: ViewSet,
    carry: list[str] | None = None,
    reuse: str = "masses",
    deal: list[str] | None = None,
) -> ViewResult:
    """Evaluates all views over normalised frames.

    ``carry`` keeps more columns in the results. ``reuse`` says what is stored in
    the shared folder of the session instead of being computed for each output: nothing (``plan``), the container masses, which are few rows
    from a pass over all of them (``masses``, if there is such a folder), or the
    evaluated frames as well (``all``). ``deal`` names columns that few rows
    share: result rows are dealt by these before they become one for each view.
    """
    return ViewResult(positions, lookthroughs, views, carry or [], reuse, deal)


def process_tables(
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    views: ViewSet,
    reference: ReferenceTables | None = None,
    carry: list[str] | None = None,
    reuse: str = "masses",
) -> ViewResult:
    """Normalises the tables, attaches reference columns and evaluates the views."""
    labels = views.all_labels
    positions = normalize(positions, labels, POSITIONS)
    if lookthroughs is not None:
        lookthroughs = normalize(lookthroughs, labels, LOOKTHROUGHS)
    if reference is not None:
        positions, lookthroughs = attach_reference(positions, lookthroughs, reference)
    return run_views(positions, lookthroughs, views, carry, reuse)
