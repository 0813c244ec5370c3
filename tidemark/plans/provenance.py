"""What a step declares about its columns, and the errors that follow from breaking it."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class FeatureError(Exception):
    """Anything wrong in a feature plan."""


class LeakageError(FeatureError):
    """A value was computed from data that wasn't there yet."""


class UndeclaredProvenanceError(FeatureError):
    """Columns or rows whose origin isn't declared."""


class StepContractError(FeatureError):
    """A step did something else than it declared."""


class StepKind(Enum):
    SOURCE = "source"
    ASOF_JOIN = "asof_join"
    TIME_INVARIANT_JOIN = "time_invariant_join"
    ROW_LOCAL = "row_local"
    WINDOWED = "windowed"
    FILTER = "filter"
    FITTED = "fitted"


#: What a step of each kind says of itself, beside the columns that it adds: this, and nothing else.
SAYS = {
    StepKind.SOURCE: "anchors",
    StepKind.ASOF_JOIN: "anchors",
    StepKind.TIME_INVARIANT_JOIN: "justification",
    StepKind.WINDOWED: "window_ends",
    StepKind.ROW_LOCAL: None,
    StepKind.FILTER: None,
    StepKind.FITTED: None,
}


@dataclass(frozen=True)
class Provenance:
    """``adds``: columns; ``anchors``: when each row was observed; ``window_ends``: last instant in a window;
    ``justification``: why a time-invariant join can't leak."""

    kind: StepKind
    adds: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    window_ends: tuple[str, ...] = ()
    justification: str = ""

    def __post_init__(self) -> None:
        said = {name for name in ("anchors", "window_ends", "justification") if self._said(name)}
        wanted = {SAYS[self.kind]} - {None}
        if said != wanted:
            raise UndeclaredProvenanceError(f"{self.kind.value}: it must say {sorted(wanted) or 'nothing more'}, and says {sorted(said) or 'nothing'}")
        unknown = {*self.anchors, *self.window_ends} - {*self.adds}
        if unknown or self.adds and self.kind is StepKind.FILTER:
            raise UndeclaredProvenanceError(f"{self.kind.value}: {sorted(unknown) or 'columns'} can't be added by it")

    def _said(self, name: str) -> bool:
        value = getattr(self, name)
        return bool(value.strip() if isinstance(value, str) else value)
