"""The manifest: one JSON file that names every file of a store's current version.

Files are reached through Hadoop's file system, so a store can be in any of them.
Data files are never changed; a new manifest replaces the old one in one rename.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

from ..errors import TableError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, name: str) -> bool:
        """Makes an empty file; false if it is there."""
        return bool(self._fs.createNewFile(self._path(name)))

    def replace(self, name: str, text: str) -> None:
        temporary = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        context.rename(self._path(temporary), self._path(name), array)

    def copy(self, source: str, target: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(source), self._path(target).getFileSystem(self._conf), self._path(target), False, self._conf)


class Manifest:
    """The parsed manifest; ``save`` makes a new version current."""

    NAME = "manifest.json"

    def __init__(self, files: Files):
        self.files = files
        if files.exists(f"{files.root}/{self.NAME}"):
            self.data: dict[str, Any] = json.loads(files.read(f"{files.root}/{self.NAME}"))
        else:
            files.make(files.root)
            self.data = {"version": 0, "tables": {}, "indexes": {}}

    def refresh(self) -> bool:
        """Takes up what other handles have made current; whether there was something."""
        if not self.files.exists(f"{self.files.root}/{self.NAME}"):
            return False
        found = json.loads(self.files.read(f"{self.files.root}/{self.NAME}"))
        if found["version"] == self.data["version"]:
            return False
        self.data = found
        return True

    def copy(self) -> dict[str, Any]:
        return json.loads(json.dumps(self.data))

    def save(self, data: dict[str, Any]) -> None:
        begun = data["version"]
        if self.refresh() or begun != self.data["version"]:
            raise TableError("the store has changed since this change was begun")
        data["version"] += 1
        # of several writers of one version, the one that makes this file goes on
        claim = f"{self.files.root}/manifest-{data['version']}.claim"
        if not self.files.claim(claim):
            raise TableError(f"the store is being changed by another writer; {claim} is left behind if it died")
        self.files.delete(f"{self.files.root}/manifest-{begun}.claim")
        self.files.replace(f"{self.files.root}/{self.NAME}", json.dumps(data))
        self.data = data
