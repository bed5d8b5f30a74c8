"""A log of publications to a folder: each is one entry, put in place whole or not at all, never over another's."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConcurrentPublication(RuntimeError):
    """Another publication of the same batch was committed since this one began."""


class CommitLog:
    """Entries 0, 1, ... of a folder. An entry names a batch and the run that now stands for it.

    An entry's number is free for one writer only: it is written beside, then linked (local files) or renamed
    without overwriting (other file systems, which must rename atomically, as HDFS does) to its number.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self.folder = spark.sparkContext._jvm, folder
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(folder).getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _read(self, place: Any) -> dict[str, Any]:
        stream = self._files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def entries(self, after: int = -1) -> list[dict[str, Any]]:
        """Entries beyond a number, in order."""
        folder = self._path(self.folder)
        if not self._files.exists(folder):
            return []
        names = {f.getPath().getName().removesuffix(".json"): f.getPath() for f in self._files.listStatus(folder)}
        return [self._read(path) for name, path in sorted(names.items()) if name.isdigit() and int(name) > after]

    def version(self) -> int:
        """Number of the last entry, -1 if there is none."""
        return max((e["version"] for e in self.entries()), default=-1)

    def live(self, upto: int | None = None) -> dict[str, str]:
        """The run that stands for each batch, after all entries or those up to a number."""
        return {e["batch_id"]: e["run_id"] for e in self.entries() if upto is None or e["version"] <= upto}

    def _put(self, entry: dict[str, Any]) -> bool:
        """Put an entry at its number; False if the number is taken."""
        self._files.mkdirs(self._path(self.folder))
        beside, place = self._path(f"{self.folder}/.{uuid.uuid4().hex}.tmp"), self._path(f"{self.folder}/{entry['version']:020d}.json")
        stream = self._files.create(beside)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        try:
            if self._files.getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(place), local(beside))
            else:
                fs = self._jvm.org.apache.hadoop.fs
                fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(beside, place, self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0))
            return True
        except Py4JJavaError as fault:
            if fault.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        finally:
            if self._files.exists(beside):
                self._files.delete(beside, False)

    def commit(self, seen: int, batch: str, run_id: str) -> str | None:
        """Let `run_id` stand for `batch`; return the run that it replaces, if any.

        seen: the last entry when the publication began. Later entries of other batches do not matter; one of
        the same batch is a conflict, and the later publication gives way.
        """
        replaced, last = self.live(seen).get(batch), seen
        while True:
            for entry in self.entries(last):
                if entry["batch_id"] == batch:
                    raise ConcurrentPublication(f"batch {batch} was published by run {entry['run_id']} meanwhile")
                last = entry["version"]
            if self._put({"version": last + 1, "batch_id": batch, "run_id": run_id}):
                return replaced
