"""Stored tables that are replaced as a whole, version by version."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; on this machine only where all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or 'file://' + tempfile.mkdtemp(prefix='eocatalog-')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written to a new table and read from there, for what is asked for several times."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing will read again."""
    for df in dfs:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Versioned:
    """Parquet tables below a folder that change together, version by version.

    All tables of a version are written to a folder of their own before one new empty file, whose name holds the
    version's number, token and folder, makes it current. Nothing that is current is ever written to or deleted,
    so a crash at any point leaves the version before, and readers see whole versions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[str, str, str]]:
        """Number, token and folder of all versions, ascending."""
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(tuple(s.getPath().getName().split(".")) for s in self._fs.listStatus(folder))

    def token(self) -> str | None:
        """What the current version was written for."""
        return self._versions()[-1][1] if self._versions() else None

    def read(self, table: str) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/{found[-1][2]}/{table}") if found else None

    def write(self, dfs: dict[str, DataFrame], token: str) -> None:
        """Makes these tables the current version; of the older ones only the last is left for its readers."""
        before, folder = self._versions(), uuid.uuid4().hex
        for name, df in dfs.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        number = int(before[-1][0]) + 1 if before else 0
        self._fs.create(self._at(f"{self.path}/versions/{number:012d}.{token}.{folder}"), False).close()
        for old in before[:-1]:
            self._fs.delete(self._at(f"{self.path}/versions/{'.'.join(old)}"), False)
            self._fs.delete(self._at(f"{self.path}/{old[2]}"), True)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV, a file with a header for each partition. Sort before, if the order of files is to tell the order of rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """The first column, a line a row."""
    df.select(F.col(df.columns[0]).cast("string")).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """GeoJSON features, one a line, as files of text sequences: readers take any number of them, in any order."""
    write_lines(features.where(F.col(column).isNotNull()).select(column), path)
