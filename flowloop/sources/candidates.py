"""The table of parked candidates, laid out for look-ups by id.

Candidates are shown in pages. All ids of a page are in one bucket, which the page's name decides
and which any of its ids tells: the id modulo the number of buckets. A page of answers is so looked
up in one folder, however many candidates were ever parked. Buckets are partition folders; below
them every run of the parking job has its own.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloop.functions import random_id
from flowloop.schemas import PREDICTION_CANDIDATE
from flowloop.session import work_path
from flowloop.sources.files import Files

# A power of two, so that ids of 48 bits divide evenly.
BUCKETS = 256
LAYOUT = "_layout"
RUNS = "_runs"
BUCKET, RUN, PAGE = "bucket", "run", "page"
# Ids collide by chance alone; a generator that fails this often is no random one.
ATTEMPTS = 50

STORED = T.StructType(
    [
        *PREDICTION_CANDIDATE.fields,
        T.StructField(PAGE, T.StringType()),
        T.StructField("parked_at", T.TimestampType()),
    ]
)


class CandidateTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)

    def buckets(self) -> int:
        """The table's own number of buckets."""
        layout = f"{self.path}/{LAYOUT}"
        if not self.files.exists(layout):
            raise FileNotFoundError(f"no candidate table at {self.path}")
        return json.loads(self.files.read(layout))["buckets"]

    def _laid_out(self, buckets: int) -> int:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        if not self.files.exists(f"{self.path}/{LAYOUT}"):
            self.files.publish(f"{self.path}/{LAYOUT}", json.dumps({"buckets": buckets}))
        return self.buckets()

    def park(self, candidates: DataFrame, run: str, buckets: int = BUCKETS, bulk: bool = False) -> None:
        """Write candidates with a ``page`` under ids of their own.

        An id that another candidate has, in this run or in the table, is drawn anew; two runs that
        park at the same moment cannot see each other. A repeated run first removes its
        candidates, also where it parks none now. ``bulk`` brings each bucket's rows together.
        """
        number = self._laid_out(buckets)
        if not self.files.mark(f"{self.path}/{RUNS}/{run}"):
            for folder in self.files.matching(f"{self.path}/{BUCKET}=*/{RUN}={run}"):
                self.files.delete(folder)
        rows = self._kept(_drawn(candidates, number))
        for _ in range(ATTEMPTS):
            taken = self._taken(rows)
            if taken is None:
                break
            again = _drawn(rows.join(taken, "id", "left_semi").drop("id"), number)
            rows = self._kept(rows.join(taken, "id", "left_anti").unionByName(again))
        else:
            raise RuntimeError(f"no free ids after {ATTEMPTS} draws")
        rows = rows.select(*STORED.names, bucket_of(F.col("id"), number).alias(BUCKET))
        if bulk:
            rows = rows.hint("rebalance", BUCKET)
        rows = rows.withColumn(RUN, F.lit(run))
        rows.write.mode("append").partitionBy(BUCKET, RUN).parquet(self.path)

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Rows as they were drawn: evaluated again, they would get other ids."""
        path = work_path(self.spark, "drawn")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _taken(self, rows: DataFrame) -> DataFrame | None:
        """The ids of ``rows`` that are not theirs alone."""
        twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
        stored = self.holding(rows.select("id")).select("id")
        parked = rows.select("id").join(stored, "id", "left_semi")
        taken = self._kept(twice.unionByName(parked).distinct())
        return None if taken.isEmpty() else taken

    def all(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.path).select(*STORED.names)

    def holding(self, wanted: DataFrame) -> DataFrame:
        """The candidates in the buckets of ``wanted``'s ids, and of its pages if it names any.

        Only these folders are listed. As many numbers as there are buckets come to the driver.
        """
        number = self.buckets()
        asked = [bucket_of(F.col("id"), number)]
        if PAGE in wanted.columns:
            asked.append(page_bucket(F.col(PAGE), number))
        found = wanted.select(F.explode(F.array(*asked)).alias(BUCKET)).distinct().dropna()
        folders = [f"{self.path}/{BUCKET}={row[0]}" for row in found.collect()]
        folders = [folder for folder in sorted(folders) if self.files.exists(folder)]
        if not folders:
            return self.spark.createDataFrame([], STORED)
        reader = self.spark.read.schema(STORED).option("basePath", self.path)
        return reader.parquet(*folders).select(*STORED.names)


def bucket_of(candidate_id: Column, buckets: int) -> Column:
    return F.pmod(candidate_id, F.lit(buckets)).cast("int")


def page_bucket(page: Column, buckets: int) -> Column:
    return F.when(page.isNotNull(), F.pmod(F.xxhash64(page), F.lit(buckets)).cast("int"))


def _drawn(candidates: DataFrame, buckets: int) -> DataFrame:
    """Random ids of 48 bits whose last bits are the page's bucket."""
    drawn = F.expr(f"__drawn - pmod(__drawn, {buckets})") + page_bucket(F.col(PAGE), buckets)
    rows = candidates.withColumn("__drawn", random_id())
    return rows.withColumn("id", drawn.cast("bigint")).drop("__drawn")
