"""Tables that are stored by sample: joins and groupings by sha need no shuffle.

Every table of one dataset is dealt into the same number of hash buckets of sha, one file per
bucket, sorted. Spark's own bucketing does the rest: scans of such tables are partitioned alike,
so aligning views, joining exports of several models and grouping all scores of a sample plan
neither an exchange nor, with one file per bucket, movement of pixels.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoview.errors import ContractViolation

KEY = "sha"


def write_aligned(df: DataFrame, path: str, buckets: int) -> None:
    """Store ``df`` by sha. The only shuffle; the number of buckets is kept beside the data."""
    root, spark = path.rstrip("/"), df.sparkSession
    name = f"aligned_{uuid.uuid4().hex}"
    (df.repartition(buckets, F.col(KEY)).write.bucketBy(buckets, KEY).sortBy(KEY)
     .option("path", f"{root}/rows").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    spark.createDataFrame([(buckets, df.schema.json())], "buckets int, fields string").coalesce(
        1).write.json(f"{root}/layout")


def scan_aligned(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with its layout, as ``write_aligned`` recorded it."""
    root = path.rstrip("/")
    layout = spark.read.schema("buckets int, fields string").json(f"{root}/layout").first()
    if layout is None:
        raise ContractViolation(f"{path} has no layout")
    fields = StructType.fromJson(json.loads(layout["fields"]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    name = f"aligned_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY "
              f"({KEY}) INTO {layout['buckets']} BUCKETS LOCATION '{root}/rows'")
    return spark.table(name)
