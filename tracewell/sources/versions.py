"""A table in versions: each is written to a folder of its own and then published by one small manifest, on any file system Spark reaches.

A version is there when its manifest is: the manifest gets its name by a rename that never replaces another, so of two writers of one
number one fails, and what a killed write leaves behind is never read.
"""

from __future__ import annotations

import json
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_versions"


class Conflict(RuntimeError):
    """Another writer has published the version meanwhile; read again and repeat."""


class _Folder:
    """Hadoop's view of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.base = folder.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, self.jvm.java.nio.charset.StandardCharsets.UTF_8)
        finally:
            stream.close()

    def claim(self, text: str, *parts: str) -> bool:
        """Write a file whole under a name of its own, then give it its name unless that is taken."""
        own = self.path(*parts[:-1], f".{uuid.uuid4().hex}")
        stream = self.fs.create(own, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.conf)
        no = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(own, self.path(*parts), no)
        except Exception as e:
            self.fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


def _number(name: str) -> int | None:
    return int(name.removesuffix(".json")) if name.endswith(".json") and name[:-5].isdigit() else None


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, the oldest first."""
    return sorted(n for x in _Folder(spark, folder).names(MANIFESTS) if (n := _number(x)) is not None)


def manifest(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(_Folder(spark, folder).text(MANIFESTS, f"{version:012d}.json"))


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """A version, or the newest; None where there is none yet."""
    have = versions(spark, folder)
    if version is None and not have:
        return None
    told = manifest(spark, folder, have[-1] if version is None else version)
    return spark.read.schema(told["schema"]).parquet(f"{folder.rstrip('/')}/{told['data']}")


def publish(df: DataFrame, folder: str, after: int | None = None, tag: str = "", data: str = "") -> int:
    """Write df as the version after `after` (the newest there is, unless given; 0 for an empty folder) and give its number.

    tag names who wrote it; a version of this tag that is already published is kept, and its number given: so a repeated batch
    writes nothing twice. data is the folder's name, where it isn't taken.
    """
    spark = df.sparkSession
    at = _Folder(spark, folder)
    have = versions(spark, folder)
    for n in reversed(have) if tag else ():
        if manifest(spark, folder, n)["tag"] == tag:
            return n
    after = (have[-1] if have else 0) if after is None else after
    if not data or at.fs.exists(at.path(data)):
        data = f"{data or 'data'}-{uuid.uuid4().hex}"
    df.write.parquet(f"{at.base}/{data}")
    told = {"data": data, "tag": tag, "schema": df._jdf.schema().toDDL()}
    if not at.claim(json.dumps(told), MANIFESTS, f"{after + 1:012d}.json"):
        with suppress(Exception):
            at.fs.delete(at.path(data), True)
        raise Conflict(f"version {after + 1} of {folder} is taken")
    return after + 1


def prune(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all but the newest `keep` versions, and what broken writes left; only while nobody writes or reads older ones."""
    at, have = _Folder(spark, folder), versions(spark, folder)
    for n in have[:-keep]:
        at.fs.delete(at.path(MANIFESTS, f"{n:012d}.json"), False)
    live = {manifest(spark, folder, n)["data"] for n in have[-keep:]} | {MANIFESTS}
    for name in at.names():
        if name not in live:
            at.fs.delete(at.path(name), True)
