"""What a plan reads and what it does, told from Spark's analysed plan before any job runs.

Names in a query's text say little: a view, an alias or a subquery hides them.  In the analysed plan every relation
is resolved, so the rules here look at that: which relations feed it, whether those with a time are bounded by the
as-of instant before anything mixes their rows, and whether a step that must be row by row is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame

from tidemark.plans.provenance import LeakageError, StepContractError

#: Nodes that look at one row at a time, and keep all rows.
ROWWISE = frozenset({"Project", "SubqueryAlias", "View", "CollectMetrics", "ResolvedHint", "UnresolvedHint"})
#: Nodes below which a row that a filter above drops hasn't met another one's values.
SEPARATE = ROWWISE | {"Filter", "Join", "Union", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Sort", "WithCTE", "CTERelationDef", "Generate"}


class ForbiddenSourceError(LeakageError):
    """A plan reads what can't be read as of an instant."""


def _list(seq: Any) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _ids(attributes: Any) -> list[int]:
    return [a.exprId().id() for a in _list(attributes)]


def analysed(df: DataFrame) -> Any:
    return df._jdf.queryExecution().analyzed()


def _below(node: Any) -> list:
    """A node's children, and the plans of subqueries in its expressions."""
    return [*_list(node.children()), *_list(node.subqueries())]


def _nodes(plan: Any) -> Iterator[Any]:
    work = [plan]
    while work:
        node = work.pop()
        yield node
        work += _below(node)


def relation_name(leaf: Any) -> str | None:
    """A table's name, or that of the file or folder that is read; None for rows in memory."""
    kind = _kind(leaf)
    if kind == "LogicalRelation":
        if leaf.catalogTable().isDefined():
            return leaf.catalogTable().get().identifier().table()
        try:
            return _list(leaf.relation().location().rootPaths())[0].getName().partition(".")[0]
        except Exception:  # a relation without files
            return leaf.relation().toString()
    if kind in ("DataSourceV2Relation", "StreamingRelationV2", "StreamingDataSourceV2Relation"):
        return leaf.name().rpartition(".")[2]
    return None


def _leaves(plan: Any) -> Iterator[tuple[Any, str]]:
    for node in _nodes(plan):
        if node.children().isEmpty() and (name := relation_name(node)) is not None:
            yield node, name


def _plain(expression: Any) -> Any:
    """What a cast is of."""
    while _kind(expression) in ("Cast", "UpCast", "Alias"):
        expression = expression.child()
    return expression


def _origins(plan: Any) -> dict[int, set[int]]:
    """Attributes by those that they are other names of."""
    out: dict[int, set[int]] = {}
    for node in _nodes(plan):
        if _kind(node) == "Project":
            for e in _list(node.projectList()):
                if _kind(e) == "Alias" and _kind(_plain(e)) == "AttributeReference":
                    out.setdefault(e.exprId().id(), set()).add(_plain(e).exprId().id())
        elif _kind(node) == "Union":
            for child in _list(node.children()):
                for own, given in zip(_ids(node.output()), _ids(child.output()), strict=True):
                    if own != given:
                        out.setdefault(own, set()).add(given)
        elif _kind(node) == "CTERelationRef":
            for other in _nodes(plan):
                if _kind(other) == "CTERelationDef" and other.id() == node.cteId():
                    for own, given in zip(_ids(node.output()), _ids(other.output()), strict=True):
                        out.setdefault(own, set()).add(given)
    return out


def _reached(ident: int, origins: Mapping[int, set[int]]) -> set[int]:
    found, work = set(), [ident]
    while work:
        now = work.pop()
        if now not in found:
            found.add(now)
            work += origins.get(now, ())
    return found


def _micros(expression: Any) -> int | None:
    """A constant instant; dates are their beginnings."""
    if not expression.foldable():
        return None
    kind, value = expression.dataType().typeName(), expression.eval(None)
    if value is None:
        return None
    return value * 86_400_000_000 if kind == "date" else value if kind in ("timestamp", "timestamp_ntz") else None


def _bounds(condition: Any) -> Iterator[tuple[int, int]]:
    """(attribute, instant in microseconds) for each part of a condition that says attribute <= instant."""
    kind = _kind(condition)
    if kind == "And":
        yield from _bounds(condition.left())
        yield from _bounds(condition.right())
        return
    if kind == "Between":
        small, large = condition.input(), condition.upper()
    elif kind in ("LessThan", "LessThanOrEqual"):
        small, large = condition.left(), condition.right()
    elif kind in ("GreaterThan", "GreaterThanOrEqual"):
        small, large = condition.right(), condition.left()
    else:
        return
    at = _micros(large)
    if at is not None and _kind(_plain(small)) == "AttributeReference":
        yield _plain(small).exprId().id(), at


@dataclass(frozen=True)
class SourceRules:
    """``forbidden``: relations that hold the present state, with the reason; ``columns``: the same for columns, as
    ``relation.column``.  ``timed``: relations by the column that says when a row was known.  ``invariant``: relations
    that have no such time, with why they can't leak.  Whatever else is read is refused."""

    forbidden: Mapping[str, str] = field(default_factory=dict)
    columns: Mapping[str, str] = field(default_factory=dict)
    timed: Mapping[str, str] = field(default_factory=dict)
    invariant: Mapping[str, str] = field(default_factory=dict)

    def check(self, df: DataFrame, as_of: datetime) -> DataFrame:
        """``df`` again; ForbiddenSourceError where its plan breaks a rule.  No job runs."""
        if as_of.tzinfo is None:
            raise StepContractError("as_of needs a time zone")
        plan = analysed(df)
        self._relations(plan)
        self._columns(plan)
        at = round(as_of.astimezone(timezone.utc).timestamp() * 1_000_000)
        self._bounded(plan, (), _origins(plan), at, {d.id(): d for d in _nodes(plan) if _kind(d) == "CTERelationDef"})
        return df

    def _relations(self, plan: Any) -> None:
        for _, name in _leaves(plan):
            if name in self.forbidden:
                raise ForbiddenSourceError(f"{name}: {self.forbidden[name]}")
            if name not in self.timed and not self.invariant.get(name, "").strip():
                raise ForbiddenSourceError(f"{name} has no time and no reason why it needs none")

    def _columns(self, plan: Any) -> None:
        banned = {a.exprId().id(): f"{name}.{a.name()}" for leaf, name in _leaves(plan) for a in _list(leaf.output()) if f"{name}.{a.name()}".lower() in {c.lower() for c in self.columns}}
        if not banned:
            return
        used = set(_ids(plan.output()))
        for node in _nodes(plan):
            if _kind(node) not in ("SubqueryAlias", "View") and not node.children().isEmpty():
                used |= set(_ids(node.references().toSeq()))
        for ident in sorted(used & set(banned)):
            why = next(w for c, w in self.columns.items() if c.lower() == banned[ident].lower())
            raise ForbiddenSourceError(f"{banned[ident]}: {why}")

    def _bounded(self, node: Any, bounds: tuple, origins: Mapping[int, set[int]], at: int, named: Mapping[int, Any]) -> None:
        """Goes down with the bounds that hold for all rows that come from below."""
        kind = _kind(node)
        if kind == "Filter" or kind == "Join" and node.joinType().toString() == "Inner" and node.condition().isDefined():
            bounds = (*bounds, *_bounds(node.condition() if kind == "Filter" else node.condition().get()))
        elif kind not in SEPARATE and not node.children().isEmpty():
            bounds = ()
        if kind == "CTERelationRef":
            self._bounded(named[node.cteId()].child(), bounds, origins, at, named)
            return
        if node.children().isEmpty() and (name := relation_name(node)) in self.timed:
            known = next((a.exprId().id() for a in _list(node.output()) if a.name().lower() == self.timed[name].lower()), None)
            held = [x for ident, x in bounds if known in _reached(ident, origins)]
            if known is None or not held:
                raise ForbiddenSourceError(f"{name} is read without a bound on {self.timed[name]} before its rows meet")
            if min(held) > at:
                raise ForbiddenSourceError(f"{name} is read up to an instant after the as-of one")
        for child in _list(node.children()):
            if kind == "WithCTE" and _kind(child) == "CTERelationDef":
                continue  # looked at where it is used, under the bounds there
            self._bounded(child, bounds, origins, at, named)
        for sub in _list(node.subqueries()):
            self._bounded(sub, (), origins, at, named)


def rowwise(before: DataFrame, after: DataFrame, step: str, filters: bool = False) -> None:
    """StepContractError unless ``after`` is ``before`` with nothing but expressions over single rows on top, and
    with ``filters`` also conditions on them."""
    given, node = analysed(before), analysed(after)
    allowed = ROWWISE | {"Filter"} if filters else ROWWISE
    while not node.fastEquals(given):
        kind = _kind(node)
        if kind not in allowed or not node.subqueries().isEmpty():
            raise StepContractError(f"{step} must look at one row at a time, and its plan has {kind if kind not in allowed else 'a subquery'}")
        (node,) = _list(node.children())


def keeps_rows(before: DataFrame, after: DataFrame) -> bool:
    """Whether the plan shows that ``after`` has a row for each of ``before`` (expressions, windows and another deal do)."""
    given, node = analysed(before), analysed(after)
    while not node.fastEquals(given):
        if _kind(node) not in ROWWISE | {"Window", "RepartitionByExpression"}:
            return False
        (node,) = _list(node.children())
    return True


def carries(before: DataFrame, after: DataFrame, columns: Iterable[str]) -> bool:
    """Whether ``columns`` of ``after`` are those of ``before`` and not made anew."""
    old, new = ({a.name(): a.exprId().id() for a in _list(analysed(df).output())} for df in (before, after))
    return all(new.get(c) == old.get(c) for c in columns)
