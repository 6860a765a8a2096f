"""Sequence samples that grow with the reviews, without reading old histories again.

A store is a folder. ``batch=<n>`` holds what batch n brought (``samples``, ``late``) and the
carry after it (``users``, ``counts``); ``commits/<n>`` is written last, by a rename. Readers
look at committed batches only, so a driver or executor lost at any point leaves the store as
it was, and a batch that is repeated after its commit changes nothing. The carry has a row
per user and one per (user, category); each batch writes it anew and drops the one before
the last.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from basketline.operators.sequences import Carry, extend_samples
from basketline.streaming.running_counts import FILES_PER_BATCH


class SequenceStore:
    """Samples and carry in ``root``, for one list of categories and one set of options.

    ``options`` are those of ``extend_samples``. Another list or other options than the
    store was begun with are refused, as the stored values depend on them.
    """

    def __init__(self, spark: SparkSession, root: str, categories: list[str], **options):
        self.spark, self.root = spark, root.rstrip("/")
        self.categories, self.options = list(categories), options
        self._settings = json.dumps({"categories": self.categories} | options, sort_keys=True)

    def batches(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        folder = self._path("commits")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(name) for name in names if name.isdigit())

    def append(self, reviews: DataFrame, batch: int) -> bool:
        """Take the reviews of a batch; False if it, or a later one, is in already.

        An empty batch is committed like any other.
        """
        done = self.batches()
        if done and batch <= done[-1]:
            return False
        carry = None
        if done:
            self._check_settings(done[-1])
            carry = Carry(self._read(done[-1], "users"), self._read(done[-1], "counts"))
        new = extend_samples(reviews, self.categories, carry, **self.options)
        parts = {"samples": new.samples, "late": new.late, "users": new.carry.users, "counts": new.carry.counts}
        for name, table in parts.items():
            table.write.mode("overwrite").parquet(self._folder(batch, name))
        self._commit(batch)
        for old in done[:-1]:
            for name in ("users", "counts"):
                self._fs.delete(self._path(f"batch={old}/{name}"), True)
        return True

    def samples(self) -> DataFrame:
        return self._all("samples")

    def late(self) -> DataFrame:
        """Reviews that came after a later one of their user; they are in no sample."""
        return self._all("late")

    def _all(self, name: str) -> DataFrame:
        done = self.batches()
        if not done:
            raise ValueError(f"no batch has been committed to {self.root}")
        schema = self._read(done[-1], name).schema
        return self.spark.read.schema(schema).parquet(*[self._folder(n, name) for n in done])

    def _folder(self, batch: int, name: str) -> str:
        return f"{self.root}/batch={batch}/{name}"

    def _read(self, batch: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(batch, name))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root, name)

    @property
    def _fs(self):
        return self._path("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, batch: int) -> None:
        draft = self._path(f"commits/.{batch}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(self._settings, "utf-8"))
        out.close()
        if not self._fs.rename(draft, self._path(f"commits/{batch}")):
            raise RuntimeError(f"batch {batch} could not be committed to {self.root}")

    def _check_settings(self, batch: int) -> None:
        lines = self.spark.read.text(f"{self.root}/commits/{batch}", wholetext=True)
        if lines.first()[0] != self._settings:
            raise ValueError("the store was begun with other categories or options")


def extend_from_files(
    store: SequenceStore,
    source: str,
    schema: StructType,
    checkpoint: str,
    max_files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Take all JSON files in ``source`` that no earlier run has taken, and stop."""
    reader = store.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_batch)

    def take(reviews: DataFrame, batch: int) -> None:
        store.append(reviews, batch)

    return (
        reader.json(source)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(take)
        .start()
    )
