"""Tables that the batches of a stream change, each batch once.

A table is a folder of folders of Parquet files and of manifests, one a batch: ``manifests/<batch>.json`` names the folders
that are the table after that batch. Writing it is a batch's last step, so a reader sees a batch whole or not at all, and a
batch that is run again finds its manifest and does nothing. Folders and manifests that only older batches need are
removed one batch later, so who reads the last manifest while a batch ends still finds its folders.

``replace`` and ``merge`` keep one folder. ``append`` adds one, and whenever FAN folders of a level have come together they
are written as one of the next: after n batches there are at most FAN folders for each of log(n) levels, and a row has been
written that many times.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracelode.files import Store

FAN = 16


def read_folders(spark: SparkSession, folders: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of several folders; each may have partition folders of its own, so they are read one by one."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reduce(DataFrame.unionByName, [reader.parquet(folder) for folder in folders])


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN, partition: list[str] | None = None) -> None:
        self._spark, self._path, self._store, self._fan, self._partition = spark, path.rstrip("/"), Store(spark, path), fan, partition or []

    def _manifest(self, batch: int) -> str:
        return f"{self._path}/manifests/{batch}.json"

    def batches(self) -> list[int]:
        """Batches whose manifests are there, the newest last."""
        return sorted(int(n[:-5]) for n in self._store.names(f"{self._path}/manifests") if n.endswith(".json"))

    def done(self, batch: int) -> bool:
        return any(b >= batch for b in self.batches())

    def state(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of a batch before a given one: folders as [level, name], and notes."""
        known = [b for b in self.batches() if before is None or b < before]
        return json.loads(self._store.read(self._manifest(known[-1]))) if known else {"folders": [], "notes": {}}

    def folders(self, before: int | None = None) -> list[str]:
        return [f"{self._path}/{name}" for _, name in self.state(before)["folders"]]

    def read(self, schema: T.StructType | str, before: int | None = None) -> DataFrame:
        folders = self.folders(before)
        return read_folders(self._spark, folders, schema) if folders else self._spark.createDataFrame([], schema)

    def _write(self, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.partitionBy(*self._partition).parquet(f"{self._path}/{name}")
        return name

    def _commit(self, batch: int, folders: list, notes: dict) -> None:
        kept = self.batches()[-1:]
        needed = {name for b in kept for _, name in json.loads(self._store.read(self._manifest(b)))["folders"]} | {name for _, name in folders}
        self._store.write(self._manifest(batch), json.dumps({"folders": folders, "notes": notes}))
        for old in self.batches():
            if old not in (*kept, batch):
                self._store.remove(self._manifest(old))
        for name in self._store.names(self._path):
            if name.startswith("part-") and name not in needed:
                self._store.remove(f"{self._path}/{name}")

    def replace(self, df: DataFrame, batch: int, **notes) -> None:
        """The rows of this batch are the table."""
        if not self.done(batch):
            self._commit(batch, [[0, self._write(df)]], notes)

    def merge(self, df: DataFrame, batch: int, keys: list[str]) -> None:
        """Rows of this batch take the place of those with the same keys; null keys are keys."""
        if self.done(batch):
            return
        old = self.read(df.schema, batch).withColumn("__new", F.lit(0))
        both = old.unionByName(df.withColumn("__new", F.lit(1)))
        columns = [c for c in df.columns if c not in keys]
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__new").alias("__row"))
        self.replace(last.select(*keys, "__row.*").select(*df.columns), batch)

    def append(self, df: DataFrame, batch: int, **notes) -> None:
        """Rows of this batch come to the table."""
        if self.done(batch):
            return
        folders = [*self.state(batch)["folders"], [0, self._write(df)]]
        level = 0
        while len(full := [f for f in folders if f[0] == level]) >= self._fan:
            rows = read_folders(self._spark, [f"{self._path}/{name}" for _, name in full], df.schema)
            folders = [f for f in folders if f[0] != level] + [[level + 1, self._write(rows)]]
            level += 1
        self._commit(batch, folders, notes)
