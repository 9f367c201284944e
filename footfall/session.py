"""Session settings the engine relies on for right results."""

from __future__ import annotations

import os
from hashlib import sha256

from pyspark.sql import SparkSession

# Buckets are UTC buckets, and a repeated JSON key keeps its last value.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that answers depend on; safe to call repeatedly."""
    for name, value in REQUIRED_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def check_session(spark: SparkSession) -> None:
    """Fail early instead of returning buckets cut in another time zone."""
    for name, value in REQUIRED_SETTINGS.items():
        actual = spark.conf.get(name, None)
        if actual is None or actual.upper() != value.upper():
            raise ValueError(
                f"session setting {name} is {actual!r}, expected {value!r}; "
                "call footfall.session.configure(spark) first"
            )


def checkpoint_location(
    spark: SparkSession, name: str, target: str, folder: str | None = None
) -> str:
    """Folder for the offsets of stream ``name`` that writes to ``target``.

    A ``folder`` that is given holds. Else the offsets lie under the shared folder that the
    cluster names in ``spark.checkpoint.dir``, in a place of this target's own, as two targets
    that shared offsets would each miss what the other has read; and where that setting is
    absent, next to what the stream writes.
    """
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return f"{target.rstrip('/')}/_offsets/{name}"
    own = sha256(target.rstrip("/").encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{own}/{name}"


def local_session(app: str = "footfall", cores: str | None = None, **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
