"""Where rows come from: Parquet tables, frames in memory, landed captures."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.plan_guard import SourceRules
from tidemark.plans.provenance import StepContractError, UndeclaredProvenanceError


class Source(Protocol):
    def table(self, name: str) -> DataFrame: ...


@dataclass(frozen=True)
class ParquetSource:
    """Tables under one folder.  The ``forbidden`` ones hold the present state and can't be read for features;
    ``timed`` ones (by name the column that says when a row was known) only as of an instant."""

    spark: SparkSession
    folder: str
    forbidden: frozenset[str] = frozenset()
    timed: Mapping[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name in self.timed:
            raise StepContractError(f"{name} can only be read as of an instant")
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        if name in self.forbidden:
            raise StepContractError(f"{name} is no source of features")
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def as_of(self, name: str, instant: datetime, known_at: str | None = None) -> DataFrame:
        """Rows known by ``instant``; the filter reaches the scan."""
        known_at = known_at or self.timed.get(name)
        if known_at is None:
            raise StepContractError(f"when rows of {name} were known isn't said")
        if instant.tzinfo is None:
            raise StepContractError("an as-of read needs a time zone")
        rows = self._read(name)
        kind = "timestamp_ntz" if rows.schema[known_at].dataType.typeName() == "timestamp_ntz" else "timestamp"
        return rows.filter(F.col(known_at) <= F.lit(instant.astimezone(timezone.utc).replace(tzinfo=None).isoformat()).cast(kind))

    def query(self, sql: str, instant: datetime, invariant: Mapping[str, str] | None = None) -> DataFrame:
        """SQL over the folder's tables, each as ``{name}``.  Its analysed plan may read timed tables only under a bound
        by ``instant``, none of the forbidden ones, and others only with a reason (``invariant``, by name)."""
        rules = SourceRules({n: "it holds the present state" for n in self.forbidden}, timed=self.timed, invariant=invariant or {})
        known = {*self.timed, *self.forbidden, *rules.invariant}
        views = {n: self.spark.read.parquet(f"{self.folder}/{n}.parquet") for n in sorted(known)}
        return rules.check(self.spark.sql(sql, **views), instant)

    def time_invariant(self, name: str, justification: str) -> DataFrame:
        if not justification.strip():
            raise UndeclaredProvenanceError(f"reading all of {name} needs a justification")
        return self._read(name)


@dataclass(frozen=True)
class StaticSource:
    """Frames in memory, not filtered, so that tests can put in rows that must be caught."""

    frames: Mapping[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.frames[name]


CAPTURE = "schema_version int, provider string, captured_at timestamp, pages array<string>"


def captures(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Pages of landed capture files (one JSON document each, gzip or plain): provider, captured_at, page, body.

    Unreadable files and other versions are left out.
    """
    raw = spark.read.schema(f"{CAPTURE}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    good = raw.filter(F.col("_corrupt_record").isNull() & (F.col("schema_version") == version))
    return good.select("provider", "captured_at", F.posexplode("pages").alias("page", "body"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def requested(spark: SparkSession, ids: list[int], name: str) -> DataFrame:
    """A row for each requested id, so that absent ones still appear."""
    return spark.createDataFrame([(i,) for i in ids], f"{name} long")
