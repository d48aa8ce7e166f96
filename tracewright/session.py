"""Session helpers: table access, fresh column names and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package wherever they run; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tracewright-"), "tracewright.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)  # the driver hands it to every executor
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where none is set (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tracewright-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Estimated bytes per core below which rows are put on all cores before work in Python.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if the planner takes it for small; it is left as it is otherwise. Nothing runs for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < cores * SPREAD_BYTES else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    A checkpointed plan keeps the size estimate and the constraints of the plan it replaces. Over the
    rounds of a loop these multiply with every join until the driver does nothing else, so the rows are
    put under a plan that knows neither; adaptive execution measures what it needs.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    jdf = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not hold, compared as Spark compares names."""
    held = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in held:
        name = f"_{stem}_{uuid.uuid4().hex[:8]}"
    return name
