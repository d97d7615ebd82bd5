"""A commit log: numbered files, each created once, that name what a reader may read.

Whatever a commit names is written before it and never changed after it, so a reader always sees one whole commit, also
while the next one is written. A commit that was cut off while written has no end mark and is passed over.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

END = "complete"


class Commits:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/_commits"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(self) -> list[int]:
        """Numbers of all commits, whole or not, ascending."""
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(at)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        """What commit ``number`` says; None if it is not whole."""
        stream = self._fs.open(self._path(f"{self.folder}/{number:012}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) and found.pop(END, False) else None

    def latest(self) -> tuple[int, dict] | None:
        """Number and content of the highest whole commit."""
        for number in reversed(self.numbers()):
            found = self.read(number)
            if found is not None:
                return number, found
        return None

    def add(self, content: Mapping) -> int:
        """Writes the next commit; of two writers at once, the later one takes the number after."""
        number = max(self.numbers(), default=-1) + 1
        while not self._create(number, json.dumps({**content, END: True})):
            number += 1
        return number

    def _create(self, number: int, text: str) -> bool:
        try:
            stream = self._fs.create(self._path(f"{self.folder}/{number:012}.json"), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True
