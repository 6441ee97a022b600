"""Run identities: hash-addressed records of inputs and settings, and refusal to mix them."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation
from chronoview.operators.cohort import dataset_hash

RECORD_SCHEMA = "run_id string, name string, value string"


def record_hash(record: dict) -> str:
    """SHA-256 of the sorted-key compact JSON of a settings record."""
    text = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True,
                      allow_nan=False)
    return sha256(text.encode("ascii")).hexdigest()


def run_identity(settings: dict, inputs: dict[str, DataFrame]) -> dict:
    """Settings plus the content hash of every input table (a single row each)."""
    hashes = {name: dataset_hash(frame, frame.columns, frame.columns[0]).first().dataset_hash
              for name, frame in sorted(inputs.items())}
    identity = {"settings": settings, "inputs": hashes}
    return {**identity, "run_id": record_hash(identity)}


def identity_rows(spark: SparkSession, identity: dict) -> DataFrame:
    rows = [(identity["run_id"], f"input:{k}", v) for k, v in identity["inputs"].items()]
    rows += [(identity["run_id"], f"setting:{k}", json.dumps(v, sort_keys=True))
             for k, v in identity["settings"].items()]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def identity_conflicts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Names whose value differs between two identities, or that only one has."""
    both = previous.select("name", F.col("value").alias("previous")).join(
        current.select("name", F.col("value").alias("current")), "name", "full_outer")
    return both.where(~F.col("previous").eqNullSafe(F.col("current")))


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def claim_output(spark: SparkSession, path: str, identity: dict) -> bool:
    """Record an identity beside an output folder, before anything is written there.

    Returns False when the same run has finished (``finish_output``), True when there is work
    left, be it a new folder or one that an earlier run claimed and never finished; raises when
    the folder belongs to other inputs or settings, or holds files but no record.
    """
    root = path.rstrip("/")
    record = f"{root}/_identity"
    current = identity_rows(spark, identity)
    # A record is whole only with its marker: a run may have died while it wrote it.
    if _exists(spark, f"{record}/_SUCCESS"):
        previous = spark.read.schema(RECORD_SCHEMA).json(record)
        conflicts = identity_conflicts(previous, current).limit(5).collect()
        if conflicts:
            names = ", ".join(r["name"] for r in conflicts)
            raise ContractViolation(f"{path} was made from other inputs or settings: {names}")
        return not _exists(spark, f"{root}/_finished/_SUCCESS")
    if _exists(spark, path) and not _exists(spark, record):
        raise ContractViolation(f"{path} exists without an identity record")
    current.coalesce(1).write.mode("overwrite").json(record)
    return True


def finish_output(spark: SparkSession, path: str, identity: dict) -> None:
    """The second phase of a claim: the output is whole."""
    spark.createDataFrame([(identity["run_id"],)], "run_id string").coalesce(1).write.mode(
        "overwrite").json(f"{path.rstrip('/')}/_finished")


def completed_runs(todo: DataFrame, summaries: DataFrame) -> DataFrame:
    """Runs still to do: those without a completed summary of the same identity."""
    done = summaries.where("completed").select("name", "run_id")
    return todo.join(done, ["name", "run_id"], "left_anti")
