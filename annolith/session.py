"""Session defaults shared by the bench, the tests and the entry point."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Folders of sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir. Where that is unset, in one of our own, in
    local mode only: the executors of a cluster could not read it."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="annolith-")
        shared = _OWN[context.applicationId]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def build_session(app: str = "annolith", master: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings a cluster would have, but few shuffle partitions. On a cluster (another master)
    spark.checkpoint.dir must be given: a folder that all machines share."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app)
    if master.startswith("local["):
        conf = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix=f"{app}-")} | conf
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
