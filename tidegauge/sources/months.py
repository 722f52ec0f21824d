"""Tables partitioned by the month of a time column, in the folder that driver and executors share.

A month is a folder of its own. Readers give a half-open span, which becomes a filter on the months
as well as one on the column, so no file of another month is opened. Writers stage their rows and
move them in at the end of the job, whole months at a time: a job that dies leaves the old
months, and one that runs again leaves the same rows. Old months go as folders, not row by row.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import shared_folder


def month_of(at: datetime) -> date:
    return at.date().replace(day=1)


def month_after(month: date) -> date:
    return (month + timedelta(days=31)).replace(day=1)


class MonthTable:
    """Rows of ``schema`` by the month of the column ``at``; rows where that is null have no month and are refused."""

    def __init__(self, spark: SparkSession, schema: T.StructType | str, at: str, path: str | None = None, name: str = "months"):
        self.spark, self.at = spark, at
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._files(self.path).mkdirs(self._place(self.path))

    def _place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._place(path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def months(self) -> list[date]:
        """The months that exist, with rows or without."""
        names = [s.getPath().getName() for s in self._files(self.path).listStatus(self._place(self.path))]
        return sorted(date.fromisoformat(n.removeprefix("month=")) for n in names if n.startswith("month="))

    def create(self, *months: date) -> None:
        for month in months:
            self._files(self.path).mkdirs(self._place(f"{self.path}/month={month}"))

    def drop(self, *months: date) -> None:
        for month in months:
            self._files(self.path).delete(self._place(f"{self.path}/month={month}"), True)

    def read(self, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        """Rows from ``low`` up to ``high``; either may be open."""
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("month", T.DateType())])).parquet(self.path)
        if low is not None:
            rows = rows.where((F.col("month") >= F.lit(month_of(low))) & (F.col(self.at) >= F.lit(low).cast("timestamp_ntz")))
        if high is not None:
            last = month_of(high - timedelta(microseconds=1))
            rows = rows.where((F.col("month") <= F.lit(last)) & (F.col(self.at) < F.lit(high).cast("timestamp_ntz")))
        return rows.drop("month")

    def _written(self, rows: DataFrame, mode: str, overwrite: str) -> None:
        month = F.trunc(F.col(self.at), "month")
        placed = rows.select(*self.schema.names, F.when(F.col(self.at).isNull(), F.raise_error(F.lit(f"{self.at} is null"))).otherwise(month).alias("month"))
        placed.write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy("month").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._written(rows, "append", "static")

    def overwrite(self, rows: DataFrame) -> None:
        """Each month that ``rows`` have gets just these rows; all others stay untouched."""
        self._written(rows, "overwrite", "dynamic")
