"""Session and lineage helpers shared by the operators, tests and benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tagloom.functions.patterns import sql_text


def local_session(cores: int | str = "*", app: str = "tagloom") -> SparkSession:
    """A local session with the settings the results rely on (UTC, AQE)."""
    parallelism = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session; they may not see the driver's folders."""
    context = spark.sparkContext
    if getattr(context, "_tagloom_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tagloom-")) / "tagloom.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, Path(package.name) / source.relative_to(package))
    # Spark itself serves the file to executors, also to those that join later
    context.addPyFile(str(archive))
    context._tagloom_shipped = True


def small_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A fixed list of values as a table whose size the optimiser knows."""

    def literal(value: object) -> str:
        return sql_text(value) if isinstance(value, str) else str(value).upper()

    listed = ", ".join(f"({', '.join(literal(v) for v in row)})" for row in rows)
    names = ", ".join(f"`{c}`" for c in columns)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Without that setting it is a folder in the warehouse, which a session always names and which
    its executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and reread: computed once, and its size is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return a frame that reads it there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
