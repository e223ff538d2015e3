"""Small files through Hadoop's file systems, so that a store need not be mounted."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


#: How names of files begin that are being written.
PENDING = "_pending-"


def _array(gateway, kind, *values):
    made = gateway.new_array(kind, len(values))
    for i, x in enumerate(values):
        made[i] = x
    return made


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, value: dict) -> bool:
        """Write a file that isn't there yet; False if it is. It is whole when it can be seen, and only one of several writers
        makes it where the store renames in one step, as HDFS and local disks do; object stores need a committer for that."""
        if self.fs.exists(self.path(name)):
            return False
        written = self._written(name, value)
        try:
            self._move(written, self.path(name), "NONE")
        except Py4JJavaError as e:
            self.fs.delete(written, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(self.path(name)):
                return False
            raise
        return True

    def replace(self, name: str, value: dict) -> None:
        """Write a file in place of what is there; readers see the old one or the new one."""
        self._move(self._written(name, value), self.path(name), "OVERWRITE")

    def _written(self, name: str, value: dict):
        """The value in a file of its own beside the place; names() leaves it out."""
        folder, _, last = name.rpartition("/")
        path = self.path(f"{folder}/{PENDING}{uuid.uuid4().hex}-{last}".lstrip("/"))
        stream = self.fs.create(path, False)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        return path

    def _move(self, source, target, how: str) -> None:
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = _array(self.gateway, kind, getattr(kind, how))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(source, target, options)

    def read(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        found = (s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else ()
        return sorted(n for n in found if not n.startswith(PENDING))

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def scratch_root(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where it is unset."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"
