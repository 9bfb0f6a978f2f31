"""A table kept as whole versions, of which a marker says which one counts.

A version is written in full to a folder of its own; only then is its marker created, a file that bears the version's number and
names the folder.  Of several writers of one number only one can create it.  A write that breaks off leaves a folder
without a marker, or an empty marker, which nobody reads.  Readers keep the version they started on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Snapshots:
    """The versions of a table at ``path``, on any store that Spark reaches."""

    spark: SparkSession
    path: str

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _markers(self) -> dict[int, int]:
        """Numbers that were taken, with the sizes of their markers."""
        files, folder = self._folder()
        found = files.listStatus(folder) if files.exists(folder) else []
        return {int(s.getPath().getName()): s.getLen() for s in found}

    def versions(self) -> dict[int, str]:
        """Version numbers and the names of their folders."""
        files, folder = self._folder()
        out = {}
        for number in (n for n, size in self._markers().items() if size):
            stream = files.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(number)))
            out[number] = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or the one asked for; None before the first."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/{known[max(known) if version is None else version]}")

    def write(self, rows: DataFrame, after: int | None = None) -> int:
        """Write ``rows`` as the version after ``after`` (the newest without it); an error if another writer made one meanwhile."""
        after = max(self.versions(), default=0) if after is None else after
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        files, folder = self._folder()
        files.mkdirs(folder)
        number = max(self._markers(), default=0) + 1
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(number))
        try:
            if max(self.versions(), default=0) != after:
                raise FileExistsError
            stream = files.create(marker, False)
        except (FileExistsError, Py4JJavaError) as error:
            raise RuntimeError(f"a version of {self.path} after {after} was written by another job") from error
        stream.write(bytearray(name.encode()))
        stream.close()
        return number
