"""Session helpers shared by all operators: table loading, lineage cuts, spreading
of small inputs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, once for each application.

    Workers that find it by PYTHONPATH need nothing; others, executors that join later
    among them, fetch an archive of its sources from the driver.
    """
    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _SHIPPED or root in on_path or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="codequarry-"), "codequarry.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the package goes to the workers with the first one."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share, and read again.

    The folder is the session's spark.checkpoint.dir. Only a local master may go
    without it; then a temporary folder of this machine serves.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="codequarry-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Input bytes a core should have before a Python stage takes the table's own splits.
SPLIT_BYTES = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over enough partitions for a Python stage.

    A large table has many input splits and passes through untouched; only a table of
    less than SPLIT_BYTES a core (often one file, one row group) is exchanged. Without
    keys the rows go round robin, so one hot key cannot fill a partition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
