"""Feature pipelines: a chain of declared steps over one lazy plan, with a guard against leakage.

Structure and declarations are checked on schemas and analysed plans, without a job.  What each step does to values
(rows neither lost nor made, anchors not after the as-of instant, windows ended strictly before the row's event) is
observed while the result is written to the shared folder: no step runs again for its check, and nothing is observed
that the plan shows already.  A fitted step looks at all rows twice, so what comes before it is written first.
Observed numbers can be too large where a task ran twice, so what looks bad is looked at again by a job of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.plans.plan_guard import SourceRules, carries, keeps_rows, rowwise
from tidemark.plans.provenance import FeatureError, LeakageError, Provenance, StepContractError, StepKind, UndeclaredProvenanceError


@dataclass(frozen=True)
class Context:
    as_of: datetime
    seasons: tuple[int, ...] = ()
    season_types: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.as_of.tzinfo is None:
            raise FeatureError("as_of needs a time zone")


@dataclass(frozen=True)
class Frame:
    """A DataFrame with its event time, anchors and window ends; these can only grow."""

    df: DataFrame | None = None
    event_time: str = ""
    anchors: tuple[str, ...] = ()
    window_ends: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.df is None:
            return
        if missing := self.marks - set(self.df.columns):
            raise StepContractError(f"there is no {sorted(missing)}")
        for c in sorted(self.marks - {self.event_time}):
            _instant(self.df, c)

    @property
    def marks(self) -> set[str]:
        return {self.event_time, *self.anchors, *self.window_ends}

    @classmethod
    def empty(cls, spark: SparkSession, schema: str, event_time: str, anchors: Sequence[str] = (), window_ends: Sequence[str] = ()) -> Frame:
        return cls.from_rows(spark, [], schema, event_time, anchors, window_ends)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence, schema: str, event_time: str, anchors: Sequence[str] = (), window_ends: Sequence[str] = ()) -> Frame:
        """A frame of rows in memory with what is declared about them."""
        return cls(spark.createDataFrame(rows, schema), event_time, tuple(anchors), tuple(window_ends))

    def select(self, *names: str) -> Frame:
        lost = self.marks - set(names)
        if lost:
            raise StepContractError(f"a selection must keep {sorted(lost)}")
        return replace(self, df=self.df.select(*names))

    def declaring(self, p: Provenance) -> Frame:
        add = lambda have, more: (*have, *(m for m in more if m not in have))
        return replace(self, anchors=add(self.anchors, p.anchors), window_ends=add(self.window_ends, p.window_ends))


def _instant(df: DataFrame, column: str) -> None:
    """Anchors and window ends are instants; a wall-clock time (timestamp_ntz) could be any of several."""
    if df.schema[column].dataType.typeName() != "timestamp":
        raise StepContractError(f"{column} is {df.schema[column].dataType.simpleString()}, not timestamp")


@dataclass(frozen=True)
class Step:
    """``apply``: (DataFrame or None, context) to DataFrame; ``needs``: columns it reads."""

    name: str
    provenance: Provenance
    apply: Callable[[DataFrame | None, Context], DataFrame]
    needs: tuple[str, ...] = ()


def source(name: str, load: Callable[[Context], DataFrame], anchor: str, adds: Sequence[str]) -> Step:
    return Step(name, Provenance(StepKind.SOURCE, tuple(adds), (anchor,)), lambda _, c: load(c))


def row_local(name: str, change: Callable[[DataFrame], DataFrame], adds: Sequence[str], needs: Sequence[str] = ()) -> Step:
    return Step(name, Provenance(StepKind.ROW_LOCAL, tuple(adds)), lambda df, _: change(df), tuple(needs))


def windowed(name: str, change: Callable[[DataFrame], DataFrame], adds: Sequence[str], window_ends: Sequence[str], needs: Sequence[str] = ()) -> Step:
    return Step(name, Provenance(StepKind.WINDOWED, tuple(adds), window_ends=tuple(window_ends)), lambda df, _: change(df), tuple(needs))


def asof(name: str, change: Callable[[DataFrame], DataFrame], adds: Sequence[str], anchor: str, needs: Sequence[str] = ()) -> Step:
    return Step(name, Provenance(StepKind.ASOF_JOIN, tuple(adds), (anchor,)), lambda df, _: change(df), tuple(needs))


def lookup(name: str, change: Callable[[DataFrame], DataFrame], adds: Sequence[str], justification: str, needs: Sequence[str] = ()) -> Step:
    return Step(name, Provenance(StepKind.TIME_INVARIANT_JOIN, tuple(adds), justification=justification), lambda df, _: change(df), tuple(needs))


def keep(name: str, condition: Callable[[Context], object], needs: Sequence[str] = ()) -> Step:
    return Step(name, Provenance(StepKind.FILTER), lambda df, c: df.filter(condition(c)), tuple(needs))


def fitted(name: str, change: Callable[[DataFrame], DataFrame], adds: Sequence[str], needs: Sequence[str] = ()) -> Step:
    return Step(name, Provenance(StepKind.FITTED, tuple(adds)), lambda df, _: change(df), tuple(needs))


def _rules(frame: Frame, context: Context) -> dict:
    """Conditions that no row may fulfil."""
    rules = {}
    at = F.lit(context.as_of.timestamp())
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    rules["no_event_time"] = F.col(frame.event_time).isNull()
    rules["no_anchor"] = F.coalesce(*[F.col(a).cast("timestamp") for a in frame.anchors]).isNull()
    rules |= {f"late__{a}": F.coalesce(seconds(a) > at, F.lit(False)) for a in frame.anchors}
    rules |= {f"open__{w}": F.coalesce(seconds(w) >= seconds(frame.event_time), F.lit(False)) for w in frame.window_ends}
    return rules


def violations(frame: Frame, context: Context) -> DataFrame:
    """One row: how many rows break each rule."""
    return frame.df.agg(*_counts(frame, context)).drop("rows")


def _rows():
    return F.count(F.lit(1)).alias("rows")


def _counts(frame: Frame, context: Context) -> list:
    """Rows, and how many break each rule."""
    return [_rows(), *[F.count_if(c).alias(n) for n, c in _rules(frame, context).items()]]


def _broken(frame: Frame, context: Context):
    """A bit for each rule that a row breaks."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(_rules(frame, context).values()):
        out = out.bitwiseOR(F.when(c, 1 << min(i, 62)).otherwise(0).cast("long"))
    return out


def _seen(observation: Observation) -> dict | None:
    try:
        return observation.get
    except Py4JError:
        return None


@dataclass(frozen=True)
class _Watch:
    """What is seen of a frame: ``whole``, or its rows alone; ``before``: of the frame that the step was given."""

    step: Step | None
    frame: Frame
    seen: Observation
    whole: bool
    before: _Watch | None = None


@dataclass(frozen=True)
class Pipeline:
    name: str
    steps: tuple[Step, ...]
    event_time: str
    guarded: bool = True
    #: What sources may read; None for whatever they like.
    rules: SourceRules | None = None
    by_name: dict[str, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        names = [s.name for s in self.steps]
        if len(set(names)) < len(names):
            raise FeatureError(f"{self.name}: step names must differ")
        object.__setattr__(self, "by_name", {n: i for i, n in enumerate(names)})

    def _at(self, name: str) -> int:
        if name not in self.by_name:
            raise FeatureError(f"{self.name} has no step {name}")
        return self.by_name[name]

    def with_steps(self, *steps: Step) -> Pipeline:
        return replace(self, steps=(*self.steps, *steps))

    def insert_after(self, name: str, step: Step) -> Pipeline:
        i = self._at(name) + 1
        return replace(self, steps=(*self.steps[:i], step, *self.steps[i:]))

    def without(self, name: str) -> Pipeline:
        i = self._at(name)
        return replace(self, steps=(*self.steps[:i], *self.steps[i + 1 :]))

    def replace_step(self, name: str, step: Step) -> Pipeline:
        i = self._at(name)
        return replace(self, steps=(*self.steps[:i], step, *self.steps[i + 1 :]))

    def renamed(self, name: str) -> Pipeline:
        return replace(self, name=name)

    def with_guard(self, guarded: bool = True) -> Pipeline:
        return replace(self, guarded=guarded)

    def with_rules(self, rules: SourceRules | None) -> Pipeline:
        return replace(self, rules=rules)

    def unguarded(self) -> Pipeline:
        return self.with_guard(False)

    def run(self, context: Context, frame: Frame | None = None) -> Frame:
        """The frame after all steps; guarded, it is written once and checked, else it stays a plan.

        ``frame``: what to start from, where the first step isn't a source.
        """
        frame = frame or Frame(event_time=self.event_time)
        if not self.guarded:
            for step in self.steps:
                frame = self._apply(step, frame, context)
            return frame
        return self._watched(context, frame)

    def _watched(self, context: Context, frame: Frame) -> Frame:
        """Rows are counted around steps of which the plan doesn't show that it keeps them; values are looked at
        before a step that drops rows or makes marked columns anew, and at the end."""
        watched: list[_Watch] = []
        last: Step | None = None
        counted: _Watch | None = None  # whose number of rows the frame has
        fresh = frame.df is not None  # whether there are values that haven't been looked at

        def look(frame: Frame, whole: bool, before: _Watch | None = None) -> Frame:
            nonlocal counted, fresh
            counted = _Watch(last, frame, Observation(), whole, before)
            watched.append(counted)
            fresh = fresh and not whole
            if not whole:
                return replace(frame, df=frame.df.observe(counted.seen, _rows()))
            # What is observed is summed row by row without generated code, so it is one number for each row.
            marked = frame.df.withColumn("__broken", _broken(frame, context)).observe(counted.seen, _rows(), F.bit_or("__broken").alias("broken"))
            return replace(frame, df=marked.drop("__broken"))

        for step in self.steps:
            kind, before = step.provenance.kind, frame
            if kind is StepKind.FITTED or kind is StepKind.FILTER and fresh:
                before = look(before, fresh) if fresh or counted is None else before
            frame = self._apply(step, before, context)
            kept = kind is not StepKind.FILTER and before.df is not None and (kind is StepKind.ROW_LOCAL or keeps_rows(before.df, frame.df))
            if before.df is not None and kind not in (StepKind.FITTED, StepKind.FILTER):
                made_anew = fresh and not carries(before.df, frame.df, before.marks)
                if made_anew or not kept and counted is None:
                    before = look(before, fresh)
                    frame = self._apply(step, before, context)
            last, known = step, counted
            fresh = fresh or kind is not StepKind.FILTER
            if kind is StepKind.FILTER:
                counted = None
            elif not kept:
                frame = look(frame, False, known if before.df is not None else None)
        if frame.df is None:
            return frame
        if fresh:
            frame = look(frame, True)
        done = replace(frame, df=staging.materialize(frame.df, self.name))
        for w in watched:
            found = _seen(w.seen)
            if found is None or self._wrong(w, found, _seen(w.before.seen) if w.before else None):
                # Nothing was seen where the plan shows that no row is left; what was seen twice is too much.
                found = w.frame.df.agg(*_counts(w.frame, context)).first().asDict()
                if wrong := self._wrong(w, found, w.before.frame.df.agg(_rows()).first().asDict() if w.before else None):
                    raise wrong
        return done

    def _wrong(self, w: _Watch, found: dict, before: dict | None) -> FeatureError | None:
        """What the numbers after a step say, beside those before it."""
        name, rows = w.step.name if w.step else "start", found["rows"]
        bad = {k: n for k, n in found.items() if n and k != "rows"}
        if w.before and before and rows != before["rows"]:
            return StepContractError(f"{self.name}: {name} made {rows} rows of {before['rows']}")
        if any(k.startswith("no_") for k in bad):
            return UndeclaredProvenanceError(f"{self.name}, after {name}: {bad}")
        return LeakageError(f"{self.name}, after {name}: {bad}") if bad else None

    def _read(self, step: Step, df: DataFrame, context: Context, before: DataFrame | None) -> None:
        """What the step's plan does, and what it reads beside the rows that it was given."""
        kind = step.provenance.kind
        if kind in (StepKind.ROW_LOCAL, StepKind.FILTER):
            rowwise(before, df, step.name, filters=kind is StepKind.FILTER)
        elif self.rules and kind is StepKind.SOURCE:
            self.rules.check(df, context.as_of)

    def _apply(self, step: Step, frame: Frame, context: Context) -> Frame:
        p, have = step.provenance, set(frame.df.columns) if frame.df is not None else set()
        if (p.kind is StepKind.SOURCE) != (frame.df is None):
            raise StepContractError(f"{step.name}: a source comes first, and only there")
        if missing := set(step.needs) - have:
            raise StepContractError(f"{step.name} needs {sorted(missing)}")
        if p.kind is StepKind.FITTED and self.guarded:
            frame = replace(frame, df=staging.materialize(frame.df, f"{self.name}-{step.name}"))
        df = step.apply(frame.df, context)
        if self.guarded:
            self._read(step, df, context, frame.df)
        now = set(df.columns)
        if have - now:
            raise StepContractError(f"{step.name} dropped {sorted(have - now)}")
        if now - have != set(p.adds):
            raise UndeclaredProvenanceError(f"{step.name} declared {sorted(p.adds)} and added {sorted(now - have)}")
        for column in (*p.anchors, *p.window_ends):
            _instant(df, column)
        if self.event_time not in now:
            raise StepContractError(f"{step.name}: there is no {self.event_time}")
        return replace(frame, df=df).declaring(p)
