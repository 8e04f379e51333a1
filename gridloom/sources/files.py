"""Small files and folders through Hadoop's file systems, so that a store can be wherever Spark can read."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


_mutex = threading.RLock()


class Files:
    """File operations on the file system of ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isDirectory()

    def qualified(self, path: str) -> str:
        """With scheme and absolute."""
        return self._fs.makeQualified(self._path(path)).toString()

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def make_folder(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    @contextmanager
    def locked(self, path: str, patience: float = 60.0):
        """Hold ``path``, a file that only one can create. A lock older than ``patience`` seconds is of a holder that died, and is taken over."""
        with _mutex:
            until = time.time() + 2 * patience
            while not self._created(path):
                try:
                    age = time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000
                except Exception:  # gone meanwhile
                    continue
                if age > patience:
                    self.delete(path)
                elif time.time() > until:
                    raise TimeoutError(f"{path} is held by another writer")
                else:
                    time.sleep(0.05)
            try:
                yield
            finally:
                self.delete(path)

    def _created(self, path: str) -> bool:
        try:
            self._fs.create(self._path(path), False).close()
            return True
        except Exception:
            if self._fs.exists(self._path(path)):
                return False
            raise

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write beside ``path`` and put it in place in one step."""
        beside = f"{path}.{uuid.uuid4().hex}.new"
        stream = self._fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._jvm.java.lang.reflect.Array.newInstance(kind.OVERWRITE.getClass(), 1)
        how[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(context.makeQualified(self._path(beside)), context.makeQualified(self._path(path)), how)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which the whole cluster shares."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="gridloom-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
