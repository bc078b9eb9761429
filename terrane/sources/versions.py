"""Tables whose versions are named by a log: a rebuild is swapped in at once, and a batch that runs again counts once.

The data of a version are folders that are written whole before the log names them. An entry of the log is a small file
under the next number, put there by a rename that fails if the number is taken, so readers see one version or the next
and of two writers one fails. An entry says up to which batch the table goes and which folders make it up, so an append
costs what it adds. Folders that no kept entry names, as a killed writer leaves them, go with ``clear``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from terrane.sources.storage import forget


class Versions:
    """A table under path. Batches are numbered upwards; a version holds the folders of all batches so far."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(n) for n in self._names("log") if n.isdigit()]

    def entry(self, number: int | None = None) -> dict:
        """{"batch", "folders": [[batch, folder], ...]} of a version, the last one by default; batch -1 before the first."""
        numbers = self.numbers()
        if not numbers:
            return {"batch": -1, "folders": []}
        stream = self._fs.open(self._path(f"log/{(numbers[-1] if number is None else number):020d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> int:
        """Name a version under the next number; fails if another writer took it."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        number = (self.numbers() or [-1])[-1] + 1
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"log/{number:020d}")
        self._fs.mkdirs(self._path("log"))
        out = self._fs.create(draft, True)
        out.write(json.dumps(entry).encode())
        out.close()
        context = fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context.rename(draft, target, how)
        return number

    def _written(self, df: DataFrame, batch: int) -> str:
        folder = f"data/{batch:012d}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, df: DataFrame, batch: int | None = None) -> int:
        """df in place of all there is; its version's number. Readers go over to it with the entry."""
        batch = self.entry()["batch"] + 1 if batch is None else batch
        return self._commit({"batch": batch, "folders": [[batch, self._written(df, batch)]]})

    def append(self, df: DataFrame, batch: int) -> bool:
        """df as one more batch; False, and nothing is written, if the table has that batch already."""
        last = self.entry()
        if last["batch"] >= batch:
            return False
        self._commit({"batch": batch, "folders": [*last["folders"], [batch, self._written(df, batch)]]})
        return True

    def read(self, number: int | None = None, before: int | None = None, only: int | None = None) -> DataFrame | None:
        """A version as a whole, or of it what came before a batch, or with one; None where that is nothing."""
        folders = [f for b, f in self.entry(number)["folders"] if (before is None or b < before) and (only is None or b == only)]
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def compact(self, merge) -> None:
        """merge(everything) as one folder, up to the same batch."""
        last = self.entry()
        if len(last["folders"]) > 1:
            self.publish(merge(self.read()), last["batch"])

    def clear(self, keep: int = 2) -> list[str]:
        """Delete all but the last versions' entries, and the folders that none of those names; what was deleted.

        keep covers readers that opened an older version; nobody may be writing meanwhile.
        """
        numbers = self.numbers()
        kept = numbers[-keep:]
        named = {f for n in kept for _, f in self.entry(n)["folders"]}
        gone = [f"log/{n:020d}" for n in numbers[:-keep]] + [f"data/{d}" for d in self._names("data") if f"data/{d}" not in named]
        forget(self.spark, *[f"{self.path}/{g}" for g in gone], f"{self.path}/drafts")
        return gone
