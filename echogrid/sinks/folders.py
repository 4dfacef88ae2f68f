"""File operations on whatever file system a path names: listing, and writing a small file unless there is one."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import SparkSession


class Folders:
    """The folders below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop, self.jvm, self.gateway = spark._jvm.org.apache.hadoop.fs, spark._jvm, spark.sparkContext._gateway
        self.conf, self.root = spark._jsc.hadoopConfiguration(), path
        self.system = self.hadoop.Path(path).getFileSystem(self.conf)

    def at(self, *parts: str):
        return self.hadoop.Path("/".join([self.root, *parts]))

    def named(self, kind: str, column: str, value: str, *parts: str):
        """The folder that a partitioned write gives ``column`` = ``value`` below ``kind``."""
        return self.at(kind, f"{column}={self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}", *parts)

    def below(self, folder, *parts: str):
        return self.hadoop.Path(folder, "/".join(parts))

    def names(self, folder) -> list[str]:
        return [status.getPath().getName() for status in self.system.listStatus(folder)] if self.system.exists(folder) else []

    def drop(self, folder) -> None:
        self.system.delete(folder, True)

    def first_line(self, file) -> str | None:
        stream = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(self.system.open(file)))
        line = stream.readLine()
        stream.close()
        return line

    def put(self, target, text: str) -> bool:
        """Write a file whole unless there is one of that name; whether it was written."""
        draft = self.at("drafts", uuid.uuid4().hex)
        out = self.system.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.system.mkdirs(target.getParent())
        context = self.hadoop.FileContext.getFileContext(target.toUri(), self.conf)
        never = self.gateway.new_array(self.hadoop.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), never)
            return True
        except (Py4JJavaError, PySparkException):
            if not self.system.exists(target):
                raise
            self.drop(draft)
            return False

    def numbers(self, folder) -> list[int]:
        """The files that are numbered records, ascending."""
        return sorted(int(name) for name in self.names(folder) if name.isdigit())
