"""Tables of one folder in segments with a log: what is written counts once it is in the log.

A write gives a segment of each table and then one row of the log; a run that stopped half-way leaves a folder behind that the next one overwrites. A version of a row (its `seq`) lives while no mark of its key
is later. One writer at a time; readers see the segments that the log names when they start.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "segment int, replaces array<int>, buckets int, live long"


class Segmented:
    """Subclasses have SCHEMAS (of tables; the last two columns are segment and bucket), KEY (what marks name) and CUT (the column whose hash cuts a table, or none if `bucket` is given)."""

    SCHEMAS: dict[str, str] = {}
    CUT: dict[str, str | None] = {}
    KEY = "slug"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        log = self._log()
        self.buckets = log[0]["buckets"] if log else buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _log(self) -> list:
        """One row for each write."""
        path = f"{self.path}/log"
        return sorted(self.spark.read.schema(LOG).parquet(path).collect()) if self._exists(path) else []

    def segments(self) -> list[int]:
        """Those in force."""
        log = self._log()
        gone = {s for r in log for s in r["replaces"]}
        return [r["segment"] for r in log if r["segment"] not in gone]

    def live(self) -> int:
        """How many keys there are."""
        log = self._log()
        return log[-1]["live"] if log else 0

    def table(self, name: str, segments: list[int] | None = None) -> DataFrame:
        """Rows of the given segments, or of all in force."""
        segments = self.segments() if segments is None else segments
        path = f"{self.path}/{name}"
        if not segments or not self._exists(path):
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(path).where(F.col("segment").isin(segments))

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, segment: int, df: DataFrame, dealt: bool = True) -> None:
        """A segment's part of a table. Rebalancing gives each bucket about one file, and a large one several; where rows are not dealt, as wide ones, each task writes a file for each of its buckets."""
        cut = self.CUT[name]
        columns = [x.split()[0] for x in self.SCHEMAS[name].split(", ")][:-2]
        df = df.select(*columns, self._bucket(cut).alias("bucket") if cut else "bucket")
        df = (df.hint("rebalance", "bucket") if dealt else df).sortWithinPartitions("bucket", cut or columns[0])
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/segment={segment}")

    def _living(self, df: DataFrame) -> DataFrame:
        """Without the versions that a mark has ended."""
        marks = self.table("marks").groupBy(F.col(self.KEY).alias("_key")).agg(F.max("at").alias("_at"))
        return df.join(marks, (F.col(self.KEY) == F.col("_key")) & (F.col("_at") > F.col("seq")), "left_anti")

    def _commit(self, segment: int, replaces: list[int], live: int) -> None:
        self.spark.createDataFrame([(segment, replaces, self.buckets, live)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def vacuum(self) -> None:
        """Delete the files of segments that are not in force; no reader may be at work."""
        keep = set(self.segments())
        for name in self.SCHEMAS:
            fs, where = self._fs(f"{self.path}/{name}")
            for f in fs.listStatus(where) if fs.exists(where) else ():
                segment = re.fullmatch(r"segment=(\d+)", f.getPath().getName())
                if segment and int(segment[1]) not in keep:
                    fs.delete(f.getPath(), True)


def kept_at(folder: str, name: str, source: DataFrame) -> str:
    """A path in the shared folder for what is derived from the files of a table; other files, sizes or times give another path."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    print_of = files.agg(F.coalesce(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")), F.lit(0)).alias("p")).first()["p"]
    return f"{folder}/{name}-{int(print_of) & (2**64 - 1):016x}"
