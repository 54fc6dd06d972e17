"""Run folders on any file system that Spark's Hadoop layer reaches: a folder for each attempt, one pointer a key.

Data files are written where they stay; nothing is renamed but the pointer, a file of one line. A run of a key writes
root/<key>-<attempt>, its receipt complete.json last, and then puts root/<key>.json, which names the attempt. The first
writer to put it wins; others drop their own attempt and use the winner's. What no pointer names isn't published, so an attempt
that was cut off at any point is never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

#: Rows of a data file at most; files are digested whole in tasks.
FILE_ROWS = 2_000_000
#: Characters of a receipt or pointer at most.
MOST_CHARACTERS = 1 << 20


class Folder:
    """A folder by its URI. A pathlib path is a local one, whatever the cluster's default file system is."""

    def __init__(self, spark: SparkSession, path: Path | str):
        self.spark, jvm = spark, spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"file://{path.resolve()}" if isinstance(path, Path) else path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        self.uri = fs.makeQualified(p).toString().rstrip("/")
        self.local = fs.getUri().getScheme() == "file"
        self.fs = fs.getRawFileSystem() if self.local else fs  # small files without checksum files beside them

    def __truediv__(self, name: str) -> str:
        return f"{self.uri}/{name}"

    @property
    def name(self) -> str:
        return self.uri.rsplit("/", 1)[1]

    @property
    def parent(self) -> Folder:
        return Folder(self.spark, self.uri.rsplit("/", 1)[0])

    @property
    def local_path(self) -> Path:
        return Path(self._path("").toUri().getPath())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self / name if name else self.uri)

    def has(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        """Make a folder that only its owner may enter."""
        self.fs.mkdirs(self._path(name))
        self.fs.setPermission(self._path(name), self._mode("700"))

    def _mode(self, octal: str):
        return self.spark._jvm.org.apache.hadoop.fs.permission.FsPermission(octal)

    def close_to_others(self) -> None:
        """Mode 700 for the folders within and 600 for the files."""
        entries = [s for s in self.fs.listStatus(self._path(""))]
        while entries:
            s = entries.pop()
            self.fs.setPermission(s.getPath(), self._mode("700" if s.isDirectory() else "600"))
            if s.isDirectory():
                entries += [e for e in self.fs.listStatus(s.getPath())]

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        if self.fs.getFileStatus(self._path(name)).getLen() > MOST_CHARACTERS:
            raise ValueError(f"{self / name} is too large")
        stream = self.fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.setPermission(self._path(name), self._mode("600"))

    def put_if_absent(self, name: str, text: str) -> bool:
        """Write a small file whole, unless it is there: False then.

        The file is written beside and renamed without overwriting, which is one step on HDFS; on a local disk a hard link is. An
        object store whose renames are copies needs one writer a key.
        """
        beside = f".put-{uuid.uuid4().hex}"
        self.write(beside, text)
        try:
            if self.local:
                of = lambda n: self._path(n).toUri().getPath()
                os.link(of(beside), of(name))
                return True
            jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(self._path(beside), self._path(name), none)
            return True
        except FileExistsError:
            return False
        except (Py4JJavaError, PySparkException):
            if self.has(name):
                return False
            raise
        finally:
            self.delete(beside)

    def files(self) -> DataFrame:
        """(file, bytes, sha256) of the data files of the folders within, read and hashed in tasks."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.uri)
        name = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
        return found.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Attempt(Folder):
    """One writer's folder for a key."""

    def __init__(self, root: Folder, key: str):
        super().__init__(root.spark, root / f"{key}-{uuid.uuid4().hex}")
        self.root, self.key = root, key

    def publish(self, receipt: dict) -> str:
        """Write the receipt and put the pointer. Returns the name of the attempt that stands for the key, ours or an earlier one."""
        self.write("complete.json", json.dumps(receipt, sort_keys=True, indent=1))
        self.close_to_others()
        if self.root.put_if_absent(f"{self.key}.json", json.dumps({"attempt": self.name})):
            return self.name
        self.delete()
        return pointed(self.root, self.key)

    def fail(self, error: BaseException) -> None:
        """Drop the attempt and leave a note of the failure. A task that is still being stopped may write once more; nothing reads it."""
        self.delete()
        self.root.make(f".stage-{self.key}")
        note = {"status": "failed", "error": f"{type(error).__name__}: {error}"[:2000]}
        self.root.write(f".stage-{self.key}/failure.json", json.dumps(note))


def begin(root: Folder, key: str) -> Attempt:
    """A new, empty attempt; the note of an earlier failure goes."""
    attempt = Attempt(root, key)
    attempt.make()
    root.delete(f".stage-{key}")
    return attempt


def pointed(root: Folder, key: str) -> str | None:
    """The name of the published attempt of a key."""
    if not root.has(f"{key}.json"):
        return None
    name = json.loads(root.read(f"{key}.json"))["attempt"]
    if not re.fullmatch(re.escape(key) + "-[0-9a-f]{32}", name):
        raise ValueError(f"the pointer of {key} names {name}")
    return name


def like(root: Path | str, name: str) -> Path | str:
    """A folder below root, of root's own kind."""
    return root / name if isinstance(root, Path) else f"{root.rstrip('/')}/{name}"


def swept(root: Folder, older_than_ms: int) -> list[str]:
    """Delete attempts that no pointer names and that haven't changed for so long, as cut-off drivers leave them; their names."""
    now, gone = root.spark._jvm.java.lang.System.currentTimeMillis(), []
    for s in root.fs.listStatus(root._path("")):
        name = s.getPath().getName()
        key, _, rest = name.partition("-")
        attempt = s.isDirectory() and re.fullmatch("[0-9a-f]{64}", key) and re.fullmatch("[0-9a-f]{32}", rest)
        if attempt and now - s.getModificationTime() >= older_than_ms and pointed(root, key) != name:
            root.delete(name)
            gone.append(name)
    return sorted(gone)
