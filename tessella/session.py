"""Session factory: one place for the settings every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and partitions sized for local runs.

    On a cluster the master and the shuffle partitions come from spark-submit; both are
    only set here when a local master is asked for.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoints(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one the cluster names in spark.checkpoint.dir. Only local runs without one get a
    temporary folder; on a cluster a folder of one machine would lose checkpoints, so that raises."""
    import tempfile

    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that it needs no installation there."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "tessella.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(path)
