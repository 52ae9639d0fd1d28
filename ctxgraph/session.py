"""Session helpers: worker imports, table readers, shared-folder checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session.

    Local masters share the driver's file system, so the repository root is put on the workers' path; otherwise the
    package is zipped once for each context and distributed with ``addPyFile``.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        path = sc.environment.get("PYTHONPATH", "")
        if ROOT not in path.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    elif not getattr(sc, "_ctxgraph_shipped", False):
        import zipfile

        target = os.path.join(tempfile.mkdtemp(prefix="ctxgraph"), "ctxgraph.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in (Path(ROOT) / "ctxgraph").rglob("*.py"):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(target)
        sc._ctxgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the cluster names none, one of our own (tests, single machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = getattr(sc, "_ctxgraph_dir", None)
        if named is None:
            named = sc._ctxgraph_dir = "file://" + tempfile.mkdtemp(prefix="ctxgraph-checkpoint-")
            import atexit
            import shutil

            atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
    return named


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. Survives the loss of any executor. All tables of an
    application are in one folder of its own there, ``scratch_dir``, which is to be deleted when its results are read."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ctxgraph_path = path
    return out


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ctxgraph-{spark.sparkContext.applicationId}"


def _cuts(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_ctxgraph_cuts"):
        sc._ctxgraph_cuts = []
    return sc._ctxgraph_cuts


def cuts_so_far(spark: SparkSession) -> int:
    return len(_cuts(spark))


def drop_cuts(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete what ``cut`` wrote since then, but for one table; only when no later plan reads the others."""
    made = _cuts(spark)
    for path in [p for p in made[since:] if p != keep._ctxgraph_path]:
        _delete(spark, path)
        made.remove(path)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote; only for a table that no later plan reads."""
    _delete(df.sparkSession, df._ctxgraph_path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
