"""Table access and the few session settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster's setting ``spark.checkpoint.dir`` wins. Where neither it nor a folder set
    through the API is there, a session on one machine (master ``local``) gets a folder of
    its own; on a cluster that is an error, as no machine's folder is shared.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or os.path.join(tempfile.gettempdir(), "lodestrand-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    A lost executor costs a re-read of the written files, never a recomputation of
    the whole history; there is no machine-local copy.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes_estimate(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan in bytes; used to gate hints, never results."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def micros(col) -> F.Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column that means UTC."""
    return F.unix_micros(F.to_timestamp(col))
