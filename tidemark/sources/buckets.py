"""Tables that a load changes where its keys are, and nowhere else.

Rows are dealt to a fixed number of buckets by a hash of their key.  A load reads the buckets that its keys fall
into, rewrites those of them that really change under a new version, and then puts down a manifest that names the
version of each bucket.  Readers see the newest manifest, so a load that dies in the middle changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dml
from tidemark.staging import materialize


@dataclass(frozen=True)
class BucketTable:
    """``path``: a URI; ``schema``: of the table; ``buckets``: never changes once rows are there.  One writer at a time."""

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def manifest(self) -> dict:
        """number, and by bucket the folder that holds it now."""
        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
        if not names:
            return {"number": 0, "folders": {}}
        with system.open_input_stream(f"{root}/manifests/{names[-1]}") as stream:
            return json.loads(stream.read())

    def _put(self, manifest: dict) -> None:
        system, root = self._system()
        system.create_dir(f"{root}/manifests", recursive=True)
        name = f"{manifest['number']:012d}.json"
        if system.get_file_info(f"{root}/manifests/{name}").type != fs.FileType.NotFound:
            raise RuntimeError(f"another load has made version {manifest['number']}")
        with system.open_output_stream(f"{root}/manifests/.{name}") as out:
            out.write(json.dumps(manifest).encode())
        system.move(f"{root}/manifests/.{name}", f"{root}/manifests/{name}")

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        folders = [f for b, f in self.manifest()["folders"].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def load(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts ``merge(old, new)`` in the place of the buckets that ``new`` has keys of, where that changes them; the
        buckets that were written, which are no more than ``buckets``."""
        new = materialize(new, "load")
        near = sorted(r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect())
        if not near:
            return []
        old = self.read(near)
        merged = materialize(merge(old, new).select(*old.columns).withColumn("__bucket", self._bucket()), "merged")
        prints = lambda df: df.groupBy(self._bucket().alias("b")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*old.columns).cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(1), *old.columns).cast("decimal(38,0)")).alias("y"))
        before, after = ({r["b"]: tuple(r) for r in prints(df).collect()} for df in (old, merged.drop("__bucket")))
        moved = sorted(b for b in near if before.get(b) != after.get(b))
        if not moved:
            return []
        manifest, version = self.manifest(), uuid.uuid4().hex
        merged.filter(F.col("__bucket").isin(moved)).repartition(len(moved), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{version}")
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in moved} | {str(b): f"data/{version}/__bucket={b}" for b in moved if b in after}
        self._put({"number": manifest["number"] + 1, "folders": folders})
        return moved

    def upsert(self, new: DataFrame, order: Sequence[str]) -> list[int]:
        return self.load(new, lambda old, rows: dml.upsert(old, rows, self.keys, order))

    def insert_absent(self, new: DataFrame, order: Sequence[str]) -> list[int]:
        return self.load(new, lambda old, rows: old.unionByName(dml.insert_absent(old, rows, self.keys, order)))

    def fill_null(self, new: DataFrame, columns: Sequence[str]) -> list[int]:
        return self.load(new, lambda old, rows: dml.fill_null(old, rows, self.keys, columns))

    def update_changed(self, new: DataFrame, columns: Sequence[str], stamp: str, now: Column) -> list[int]:
        """Rows whose ``columns`` differ from those of ``new`` get them, and ``stamp``; others stay as they are."""
        return self.load(new, lambda old, rows: dml.update_changed(old, rows, self.keys, columns, stamp, now))

    def vacuum(self) -> int:
        """Deletes folders that the newest manifest doesn't name; how many.  Not while someone reads an older one."""
        system, root = self._system()
        kept = set(self.manifest()["folders"].values())
        gone = 0
        for version in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
            for folder in system.get_file_info(fs.FileSelector(version.path)):
                if folder.type == fs.FileType.Directory and f"data/{version.base_name}/{folder.base_name}" not in kept:
                    system.delete_dir(folder.path)
                    gone += 1
        return gone
