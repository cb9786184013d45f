"""Tables by key that change in part: buckets, deltas, and versions behind a pointer.

``data/_version=<n>/_bucket=<b>/`` holds what version ``n`` wrote, and
``versions/<n>.json`` says for each bucket which versions' folders make it up: a base
and the deltas after it. A change writes a delta to the buckets of its keys and to no
others; it counts from the moment that its version's file is renamed into place, so
readers see all of it or nothing. What a lost writer left has no version file and is
overwritten by the next writer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE = "_gone"


class Files:
    """Whole small files in whichever store a folder is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write a file beside and rename it, so that it is there whole or not at all; a file that is there is an error."""
        if self.fs.exists(self._path(path)):
            raise FileExistsError(path)
        beside = self._path(path + ".new")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(beside, self._path(path)):
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class KeyedTable:
    """A table of which each key has one row; its buckets, ``buckets`` of them, bound what a change reads and writes."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], buckets: int = 64, most_deltas: int = 4):
        self.spark, self.folder, self.keys, self.buckets, self.most_deltas = spark, folder.rstrip("/"), keys, buckets, most_deltas
        self.files = Files(spark, self.folder)

    # versions

    def version(self) -> dict:
        """The newest version: number, last batch, schema, the folders of each bucket, and what its writer noted."""
        known = [int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/versions") if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.files.read(f"{self.folder}/versions/{max(known)}.json")) if known else {"number": 0, "batch": -1, "schema": None, "buckets": {}, "notes": {}}

    def publish(self, version: dict) -> None:
        self.files.publish(f"{self.folder}/versions/{version['number']}.json", json.dumps(version))

    def bucket_of(self, columns: tuple[str, ...] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(columns or self.keys)), F.lit(self.buckets)).cast("int")

    # changes

    def staged(self, rows: DataFrame, before: dict, whole: bool = False, only: list[int] | None = None) -> dict:
        """Write ``rows`` as the next version's files, and return that version, which doesn't count yet.

        ``whole``: the rows are all of the buckets that they are in, or of ``only``, which then has no deltas.
        """
        number = before["number"] + 1
        into = f"{self.folder}/data/_version={number}"
        rows = rows.withColumn(GONE, F.lit(False)) if GONE not in rows.columns else rows
        dealt = rows.withColumn("_bucket", self.bucket_of()).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.keys)
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(into)
        written = [int(n.split("=")[1]) for n in self.files.names(into) if n.startswith("_bucket=")]
        made = {b: list(v) for b, v in before["buckets"].items()}
        for b in map(str, only if only is not None else written):
            made[b] = ([] if whole else made.get(b, [])) + ([number] if int(b) in written else [])
        schema = before["schema"] or T.StructType([f for f in rows.schema.fields if f.name != GONE]).json()
        return {"number": number, "batch": before["batch"], "schema": schema, "buckets": {b: v for b, v in made.items() if v}, "notes": dict(before["notes"])}

    def create(self, rows: DataFrame) -> None:
        """The first version; ``rows`` has each key once."""
        self.publish(self.staged(rows, self.version(), whole=True))

    def upsert(self, changes: DataFrame, order: str | None = None, batch: int | None = None) -> list[int]:
        """Rows that replace those of the same key, or go in; the buckets written.

        Of repeated keys the last in ``order`` counts. A batch of a number that has
        been applied changes nothing, so a stream may run one again.
        """
        return self._apply(self.last_of(changes, order), batch)

    def delete(self, gone: DataFrame, batch: int | None = None) -> list[int]:
        """Remove the keys of ``gone``; the buckets written."""
        return self._apply(self.markers(gone), batch)

    def markers(self, gone: DataFrame) -> DataFrame:
        """Rows that say that their keys are gone."""
        fields = T.StructType.fromJson(json.loads(self.version()["schema"])).fields
        return gone.select(*self.keys).distinct().select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.lit(True).alias(GONE))

    def last_of(self, changes: DataFrame, order: str | None) -> DataFrame:
        """One row for each key, added up before the shuffle, so that a key may repeat any number of times."""
        row = F.struct(*[F.col(c) for c in changes.columns])
        best = F.max_by(row, F.struct(F.col(order), row)) if order else F.max(row)
        return changes.groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(best.alias("_row")).select("_row.*")

    def _apply(self, rows: DataFrame, batch: int | None) -> list[int]:
        before = self.version()
        if batch is not None and batch <= before["batch"]:
            return []
        after = self.staged(rows, before)
        after["batch"] = before["batch"] if batch is None else batch
        touched = [int(b) for b, v in after["buckets"].items() if v[-1] == after["number"]]
        if touched or batch is not None:
            self.publish(after)
        return touched

    def compact(self, most_deltas: int | None = None) -> list[int]:
        """Write buckets with more deltas than that anew, each from its own files; the buckets."""
        most, before = self.most_deltas if most_deltas is None else most_deltas, self.version()
        due = [int(b) for b, v in before["buckets"].items() if len(v) > most + 1]
        if due:
            self.publish(self.staged(self.read(before, due), before, whole=True, only=due))
        return due

    def vacuum(self) -> list[int]:
        """Delete the folders that the newest version doesn't use, and older versions' files."""
        now = self.version()
        used = {n for v in now["buckets"].values() for n in v}
        old = [int(n.split("=")[1]) for n in self.files.names(f"{self.folder}/data") if n.startswith("_version=")]
        for n in (n for n in old if n not in used and n <= now["number"]):
            self.files.delete(f"{self.folder}/data/_version={n}")
        for name in self.files.names(f"{self.folder}/versions"):
            if name != f"{now['number']}.json":
                self.files.delete(f"{self.folder}/versions/{name}")
        return [n for n in old if n not in used]

    # reading

    def _rows(self, version: dict, picked: list[tuple[str, int]]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version["schema"]))
        full = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField("_version", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
        paths = [f"{self.folder}/data/_version={n}/_bucket={b}" for b, n in picked]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/data").parquet(*paths)

    def read(self, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest where none is given; buckets without deltas are read as they are, without a shuffle."""
        version = version or self.version()
        if version["schema"] is None:
            raise ValueError(f"{self.folder} has no version")
        columns = T.StructType.fromJson(json.loads(version["schema"])).names
        of = {b: v for b, v in version["buckets"].items() if buckets is None or int(b) in buckets}
        out = self._rows(version, [(b, v[0]) for b, v in of.items() if len(v) == 1]).where(~F.col(GONE)).select(*columns)
        mixed = {b: v for b, v in of.items() if len(v) > 1}
        if not mixed:
            return out
        deltas = self._rows(version, [(b, n) for b, v in mixed.items() for n in v[1:]])
        newest = deltas.groupBy("_bucket", *[F.col(k).alias(f"_{k}") for k in self.keys]).agg(F.max_by(F.struct(*columns, GONE), "_version").alias("_row"))
        base = self._rows(version, [(b, v[0]) for b, v in mixed.items()]).where(~F.col(GONE))
        same = [base["_bucket"] == newest["_bucket"], *[base[k].eqNullSafe(newest[f"_{k}"]) for k in self.keys]]
        kept = base.join(newest, same, "left_anti").select(*columns)
        return out.unionByName(kept).unionByName(newest.select("_row.*").where(~F.col(GONE)).select(*columns))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of some keys, from the buckets of those keys alone."""
        met = [r[0] for r in wanted.select(self.bucket_of().alias("b")).distinct().collect()]
        return self.read(buckets=met).join(wanted.select(*self.keys).distinct(), list(self.keys), "left_semi")
