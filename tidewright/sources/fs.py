"""Files by Spark's own file systems, so that paths may lie in any store Spark reads."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """The few operations publication needs, on the file system of ``path``."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        spark = spark or SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("no Spark session")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._at(path).getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def plain(self, path: str) -> str:
        """The path without its scheme, as the local system knows it."""
        return self._at(path).toUri().getPath()

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(path))) if self.exists(path) else []

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._at(path))

    def remove(self, path: str) -> None:
        self.fs.delete(self._at(path), True)

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def read(self, path: str) -> str:
        stream = self.fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Puts a small file in place of the one there at once: by a rename, or, in stores where creation is atomic and
        renaming is not, by creating it anew."""
        if self.local:
            path = self.plain(path)
            tmp = f"{path}.{uuid.uuid4().hex}"
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(tmp, path)
            return
        tmp = path
        if self.fs.getScheme() in ("hdfs", "viewfs"):
            tmp = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(tmp), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if tmp != path:
            files = self.jvm.org.apache.hadoop.fs
            how = self.jvm.java.lang.reflect.Array.newInstance(files.Options.Rename.OVERWRITE.getClass(), 1)
            how[0] = files.Options.Rename.OVERWRITE
            files.FileContext.getFileContext(self._at(tmp).toUri(), self.conf).rename(self._at(tmp), self._at(path), how)

    def create(self, path: str, text: str) -> bool:
        """Makes a small file unless there is one; of several writers at once one alone gets True. Local and HDFS-like systems
        put it in place whole, by a link or a rename that does not overwrite; others by creation that does not overwrite, which
        must be atomic there (as in object stores with conditional writes)."""
        tmp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        if self.local:
            tmp, path = self.plain(tmp), self.plain(path)
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(tmp, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(tmp)
            return True
        renames = self.fs.getScheme() in ("hdfs", "viewfs")
        try:
            stream = self.fs.create(self._at(tmp if renames else path), False)
            stream.write(bytearray(text.encode()))
            stream.close()
            if renames:
                files = self.jvm.org.apache.hadoop.fs
                how = self.jvm.java.lang.reflect.Array.newInstance(files.Options.Rename.NONE.getClass(), 0)
                files.FileContext.getFileContext(self._at(tmp).toUri(), self.conf).rename(self._at(tmp), self._at(path), how)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            if renames:
                self.remove(tmp)
            return False
        return True
