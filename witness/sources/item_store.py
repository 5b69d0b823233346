"""The stored items, for any number of writers and batches that come again.

A batch is written to a folder of its own and belongs to the store once a mark names that folder.  A mark is one file,
made only if there is none of its name, so of two tries at one batch the first to finish counts.  What a lost writer
left behind has no mark and is never read.  Two writers may store one item at the same time; reads take the first of it.

    items/folder=<batch>.<try>/dataset_id=<d>/shard=<k>/*.parquet
    marks/<batch>
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from witness.operators import dedupe
from witness.plans.lineage import drop_path

#: Parts of a data set by the hash of its keys; a batch reads the parts that its own keys fall into.
SHARDS = 64
#: A cluster's store refuses a taken name by itself; a local disk looks first and renames then, so threads take turns.
_TURN = Lock()


def what(external_id: str = "external_id", item_id: str = "item_id") -> Column:
    """What tells items of a source apart: the collector's id; an item without one is itself only."""
    return F.coalesce(F.concat(F.lit("id:"), external_id), F.concat(F.lit("item:"), F.col(item_id).cast("string")))


@dataclass
class ItemStore:
    """A store below ``path``, which all writers share; ``schema`` is that of items, with dataset_id, source,
    external_id, item_id and captured_at."""

    spark: SparkSession
    path: str
    schema: StructType
    shards: int = SHARDS
    _own: list[str] = field(default_factory=lambda: ["dataset_id", "source", "_what"])

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def marks(self) -> dict[str, dict]:
        """Batch to its mark: the folder, and for a merge the batches that it stands for.

        The driver holds a line for each batch; ``merge`` keeps the folders few.
        """
        store, at = self._fs(f"{self.path}/marks")
        if not store.exists(at) or not len(store.listStatus(at)):
            return {}
        lines = self.spark.read.text(f"{self.path}/marks", wholetext=True).collect()
        return {m["batch"]: m for m in (json.loads(r.value) for r in lines)}

    def _mark(self, batch: str, folder: str, stands_for: list[str]) -> bool:
        """Whether the mark could be made, that is, wasn't there."""
        store, at = self._fs(f"{self.path}/marks/{batch}")
        draft = self._fs(f"{self.path}/drafts/{folder}")[1]
        out = store.create(draft, True)
        out.write(json.dumps({"batch": batch, "folder": folder, "stands_for": stands_for}).encode())
        out.close()
        store.mkdirs(at.getParent())
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # a finished file gets its name: nobody reads half a mark, and a taken name is an error
            with _TURN:
                context.rename(draft, at, no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            store.delete(draft, False)
            return False
        return True

    def _folders(self) -> list[str]:
        marks = self.marks()
        gone = {b for m in marks.values() for b in m["stands_for"]}
        return sorted(m["folder"] for b, m in marks.items() if b not in gone)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumns({"folder": F.lit(""), "shard": F.lit(0), "_what": F.lit("")})
        kept = StructType([*self.schema.fields]).add("_what", "string").add("folder", "string").add("shard", "integer")
        return self.spark.read.schema(kept).option("basePath", f"{self.path}/items").parquet(f"{self.path}/items").where(F.col("folder").isin(folders))

    def read(self) -> DataFrame:
        """The stored items, of each key the first by captured_at and item_id; empty for a store without batches."""
        rows = dedupe.first_of(self._rows(self._folders()), self._own, ["captured_at", "item_id"])
        return rows.select(*self.schema.names)

    def stored_keys(self, rows: DataFrame) -> DataFrame:
        """Keys in the parts of the store that keys of ``rows`` (with shard) can be in; other files are not opened.

        The driver holds the data sets and parts that a batch touches, at most ``shards`` for each data set.
        """
        touched = rows.groupBy("dataset_id").agg(F.collect_set("shard").alias("parts")).collect()
        here = F.lit(False)
        for r in touched:
            here |= F.col("dataset_id").eqNullSafe(F.lit(r.dataset_id)) & F.col("shard").isin(r.parts)
        return self._rows(self._folders()).where(here).select(*self._own)

    def _write(self, batch: str, rows: DataFrame, stands_for: list[str]) -> bool:
        folder = f"{batch}.{uuid.uuid4().hex[:12]}"
        out = rows.select(*self.schema.names, "_what", "shard").repartition("dataset_id", "shard")
        out.write.partitionBy("dataset_id", "shard").parquet(f"{self.path}/items/folder={folder}")
        made = self._mark(batch, folder, stands_for)
        if not made:
            drop_path(self.spark, f"{self.path}/items/folder={folder}")
        return made

    def add(self, batch: str, rows: DataFrame) -> bool:
        """Stores the items of a batch that the store doesn't have; False if the batch was in it already.

        ``batch`` names the batch for good, such as a query's id and its batch number.  Of rows with one key the first
        by captured_at and item_id is stored; rows without an external id are told apart by their item_id.
        """
        if batch in self.marks():
            return False
        keyed = rows.select(*self.schema.names).withColumn("_what", what())
        keyed = keyed.withColumn("shard", F.pmod(F.xxhash64(*self._own), F.lit(self.shards)).cast("int"))
        first = dedupe.first_of(keyed, self._own, ["captured_at", "item_id"])
        return self._write(batch, dedupe.new_items(first, self.stored_keys(keyed), self._own), [])

    def merge(self) -> bool:
        """Writes the folders as one, without what writers stored twice; batches stay known by their marks.

        Readers that began before go on with the old folders, which stay until ``sweep``.
        """
        marks = self.marks()
        gone = {b for m in marks.values() for b in m["stands_for"]}
        live = sorted(set(marks) - gone)
        if len(live) < 2:
            return False
        rows = dedupe.first_of(self._rows([marks[b]["folder"] for b in live]), self._own, ["captured_at", "item_id"])
        return self._write(f"merge-{uuid.uuid4().hex[:12]}", rows, live)

    def sweep(self) -> list[str]:
        """Deletes folders that no mark names or that a merge stands for; only while no writer or older reader is at work."""
        store, at = self._fs(f"{self.path}/items")
        live = set(self._folders())
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        old = sorted(n for n in names if n.startswith("folder=") and n.removeprefix("folder=") not in live)
        for n in old:
            drop_path(self.spark, f"{self.path}/items/{n}")
        return old
