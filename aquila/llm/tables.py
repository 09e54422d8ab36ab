"""Reading inputs and cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a context."""
    context = spark.sparkContext
    if getattr(context, "_aquila_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="aquila-code-")  # the driver's file server reads it until the application ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/aquila.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(f"{folder}/aquila.zip")
    context._aquila_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only in local mode, where nothing else is set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="aquila-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it survives lost executors, is computed once, and
    its size on disk lets the planner choose joins. ``release`` deletes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._aquila_path = path
    return out


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, name: str, col: str) -> DataFrame:
    """As ``written``, in buckets of a column, so that joins on it move only their other side. ``df`` is dealt by the column
    into as many partitions, ``buckets``."""
    spark = df.sparkSession
    table = f"aquila_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/llm/{table}"
    df.write.format("parquet").bucketBy(buckets(spark), col).sortBy(col).option("path", path).saveAsTable(table)
    _written.append((spark, path))
    out = spark.table(table)
    out._aquila_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if (table := path.rpartition("/")[2]).startswith("aquila_"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    path = table._aquila_path
    _written.remove((table.sparkSession, path))
    _delete(table.sparkSession, path)


def opened() -> list[tuple[SparkSession, str]]:
    """The tables of ``written`` that are still there."""
    return list(_written)


def close(tables: list[tuple[SparkSession, str]]) -> None:
    for table in tables:
        if table in _written:
            _written.remove(table)
            _delete(*table)


def release() -> None:
    """Deletes all tables of ``written``; call it once the results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; what it wrote goes with the checkpoint folder
            continue


atexit.register(release)
