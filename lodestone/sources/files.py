"""Small files beside tables, through the file systems that Spark reads: manifests are visible to all or to none."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from lodestone.errors import FileError

#: File systems whose rename is atomic and fails if the target is there (fixed values: schemes of URIs).
EXCLUSIVE = ("hdfs", "viewfs", "abfs", "abfss", "ofs", "o3fs")

class Files:
    """Text files and folders below any path that Spark can read."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no folder."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def sizes(self, folder: str) -> dict[str, int]:
        """Bytes of each file below a folder, by its path."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return {}
        found, files = {}, fs.listFiles(p, True)  # of a file, itself
        while files.hasNext():
            status = files.next()
            found[status.getPath().toString()] = status.getLen()
        return found

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Writes a file whole; False, and no change, if there is one of that name."""
        fs, p = self._at(path)
        scheme = fs.getUri().getScheme()
        if scheme != "file" and scheme not in EXCLUSIVE:
            raise FileError(f"commits need an atomic rename that does not replace files; {scheme}: has none")
        if fs.exists(p):
            return False
        pending = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.pending")
        self._create(fs, pending, text)
        if scheme == "file":  # here a rename would replace the other run's file
            try:
                os.link(pending.toUri().getPath(), p.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        else:
            # FileContext, unlike FileSystem, tells whether the target was there.
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
            try:
                context.rename(pending, p, [])
                done = True
            except Exception:
                if not fs.exists(p):
                    raise
                done = False
        if fs.exists(pending):
            fs.delete(pending, False)
        return done

    def _create(self, fs, p, text: str) -> None:
        fs.mkdirs(p.getParent())
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes a file of a name that nobody else uses."""
        self._create(*self._at(path), text)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
