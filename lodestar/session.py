"""SparkSession construction and the shared-folder rules every operator follows."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "lodestar", master: str | None = None, **overrides: str) -> SparkSession:
    """A session with the engine's defaults; `overrides` use `__` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in overrides.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions; what is dealt by key is sized from it, so it follows the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`.

    Where it is unset, a temporary folder is taken in local mode only, as a machine-local folder would
    lose data on a cluster.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "spark.lodestar.shared" not in _LOCAL:
        _LOCAL["spark.lodestar.shared"] = tempfile.mkdtemp(prefix="lodestar-")
    return "file://" + _LOCAL["spark.lodestar.shared"]


_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that Python workers import it anywhere.

    The archive goes to the shared folder, from where Spark hands it out.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    to = f"{shared_folder(spark)}/lodestar-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(held.getvalue())
    out.close()
    spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)
