"""Session settings and the places where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "tracewright", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's settings win."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "6g"} | conf
    return builder.config(map=settings).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it read back.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where that setting is
    absent and the master is local (tests, a laptop) is a folder of this process used, which is
    removed when it ends; on a cluster without the setting this fails, as executors would write to
    disks of their own. Files in the folder outlive an executor, so a later stage never depends on
    a lost one. Set spark.cleaner.referenceTracking.cleanCheckpoints to have them removed.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Rows up to which a table is small enough to go to every executor.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A table of slim rows that is expected to be small: written once, counted, and broadcast in joins only if it has at most ``rows`` rows."""
    told = cut_lineage(df)
    return F.broadcast(told) if told.count() <= rows else told


def ship_package(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers, wherever they start. Once per application."""
    context = spark.sparkContext
    if not getattr(context, "_tracewright_shipped", False):
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(here.rglob("*.py")):
                archive.write(file, file.relative_to(here.parent))
        context.addPyFile(str(target))
        context._tracewright_shipped = True
    return spark
