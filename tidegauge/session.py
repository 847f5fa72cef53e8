"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    app: str = "tidegauge",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    shared: str | None = None,
) -> SparkSession:
    """A session with the settings the operators are planned for.

    Stamps in device captures carry no zone, so the session zone is fixed to
    UTC. AQE coalesces small shuffle partitions and splits skewed ones, so on a
    cluster ``shuffle_partitions`` is best left high (a few per core).
    ``shared`` is a folder that all executors reach, for stored tables and streams.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # sessions of one hot label shrink before the streaming shuffle
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it is not installed.

    Tasks that call into it (corpus operators, file listing) import it there.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    # the driver serves the archive as long as the session lives, also to executors that come later
    folder = tempfile.mkdtemp(prefix="tidegauge-package-")
    archive = shutil.make_archive(f"{folder}/tidegauge", "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)


#: Own folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset,
    and only in local mode, one temporary folder per application takes its
    place: executors of a cluster could not see one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tidegauge-")
        root = _OWN[app]
    return f"{root.rstrip('/')}/tidegauge/{purpose}-{uuid.uuid4().hex}"
