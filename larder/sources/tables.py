"""The driver's tables, and tables that grow by batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times as timestamps of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


class BatchTables:
    """Tables under one folder that grow by batches, all of a batch's tables or none.

    A batch is appended to each table as a partition of its own (the writing query and
    the batch's number), and counts once its row stands in the table `commits`, which is
    written last. So readers never see half a batch, whichever table they read, a batch
    that is written again after a failure replaces its own partitions only, and one that is committed
    already is left alone. Nothing is rewritten: what is current is a grouped query over
    the rows. One writer of a query at a time.
    """

    COMMITS = "commits"

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {**schemas, self.COMMITS: "batch_order long"}

    def _all(self, name: str) -> DataFrame:
        schema = f"{self.schemas[name]}, batch_query string, batch_id long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _put(self, name: str, rows: DataFrame, query: str, batch: int) -> None:
        own = rows.withColumns({"batch_query": F.lit(query), "batch_id": F.lit(batch).cast("long")})
        own.write.partitionBy("batch_query", "batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/{name}")

    def committed(self, query: str, batch: int) -> bool:
        return not self._all(self.COMMITS).filter((F.col("batch_query") == query) & (F.col("batch_id") == batch)).isEmpty()

    def append(self, rows: dict[str, DataFrame], query: str, batch: int) -> bool:
        """Append a batch to its tables; False where it was committed before."""
        if self.committed(query, batch):
            return False
        for name, df in rows.items():
            self._put(name, df.select(*(c.strip().split(" ")[0] for c in self.schemas[name].split(","))), query, batch)
        last = self._all(self.COMMITS).agg(F.coalesce(F.max("batch_order"), F.lit(-1)).cast("long").alias("n"))
        self._put(self.COMMITS, last.select((F.col("n") + 1).alias("batch_order")), query, batch)
        return True

    def read(self, name: str) -> DataFrame:
        """The rows of all committed batches, with `batch_order`, in which they were committed."""
        return self._all(name).join(self._all(self.COMMITS), ["batch_query", "batch_id"]).drop("batch_query", "batch_id")
