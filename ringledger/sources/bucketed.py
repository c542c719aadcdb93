"""A keyed table in shared storage whose upserts rewrite only the buckets that they touch.

Rows lie in buckets by a hash of their key. A version writes the buckets that its delta touches into a folder of its own;
its manifest says for each bucket which version's folder holds it; the pointer CURRENT moves to the new manifest in one
step. Old versions stay readable until vacuum() removes what no kept manifest names. A write that fails leaves only files
that nothing names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.operators.keyed import first_per_key, upsert
from ringledger.sources import pointers


class Outrun(RuntimeError):
    """Another writer moved the pointer since this one read it."""


@dataclass(frozen=True)
class BucketedTable:
    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, rows: DataFrame, folder: str, keys: Sequence[str], buckets: int) -> BucketedTable:
        """Writes the first version; of several rows of a key, any one stays."""
        table = cls(rows.sparkSession, folder)
        manifest = {"version": 1, "keys": list(keys), "buckets": buckets, "schema": rows.schema.json(), "at": {}}
        table._publish(None, manifest, first_per_key(rows, keys, [F.xxhash64(*rows.columns)]))
        return table

    def manifest(self, version: int | None = None) -> dict:
        version = version or int(pointers.read(self.spark, f"{self.folder}/CURRENT"))
        return json.loads(pointers.read(self.spark, f"{self.folder}/manifests/{version}.json"))

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"]))
        at = [path for b, path in sorted(m["at"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in at)) if at else self.spark.createDataFrame([], schema)

    def upsert(self, delta: DataFrame, order: Sequence[Column] = ()) -> list[int]:
        """Rows of `delta` replace those of equal keys, others are added; of several, the first by `order`. Gives the buckets written."""
        m = self.manifest()
        delta = delta.select(*(f.name for f in self.read().schema))
        touched = sorted(r["b"] for r in delta.select(self._bucket(m).alias("b")).distinct().collect())  # at most one a bucket
        if touched:
            self._publish(m["version"], {**m, "version": m["version"] + 1}, upsert(self.read(m["version"], touched), delta, m["keys"], order))
        return touched

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int")

    def _publish(self, since: int | None, m: dict, rows: DataFrame) -> None:
        home = f"data/{m['version']}_{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(m)).repartition(m["buckets"], "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{home}")
        written = {name.split("=")[1]: f"{home}/{name}" for name in pointers.children(self.spark, f"{self.folder}/{home}") if name.startswith("_bucket=")}
        now = pointers.read(self.spark, f"{self.folder}/CURRENT")
        if now != (None if since is None else str(since)):
            raise Outrun(f"version {now} came in between")
        pointers.replace(self.spark, f"{self.folder}/manifests/{m['version']}.json", json.dumps({**m, "at": {**m["at"], **written}}))
        pointers.replace(self.spark, f"{self.folder}/CURRENT", str(m["version"]))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes data folders and manifests that the last `keep` versions don't need; gives the folders removed."""
        last = self.manifest()["version"]
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1) if pointers.read(self.spark, f"{self.folder}/manifests/{v}.json") is not None]
        needed = {p for m in kept for p in m["at"].values()}
        gone = []
        for home in pointers.children(self.spark, f"{self.folder}/data"):
            for name in pointers.children(self.spark, f"{self.folder}/data/{home}"):
                if name.startswith("_bucket=") and f"data/{home}/{name}" not in needed:
                    pointers.remove(self.spark, f"{self.folder}/data/{home}/{name}")
                    gone.append(f"data/{home}/{name}")
        for v in range(1, last - keep + 1):
            pointers.remove(self.spark, f"{self.folder}/manifests/{v}.json")
        return gone
