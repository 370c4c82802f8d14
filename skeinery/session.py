"""Session factory, shared-folder materialisation and size estimates."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skeinery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; ``conf`` adds or overrides settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests on one
    machine) a temporary folder of this machine stands in for it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="skeinery-")
    sc.setCheckpointDir(own)
    return f"file://{own}"


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    Cuts the lineage at a place that survives the loss of an executor, and
    gives later stages exact sizes.  The tables are removed when the driver
    process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing will read it again."""
    path = getattr(df, "_written_to", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM is gone; the folder belongs to the cluster
            return


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the sources below ``df``: for file scans the size of the files.

    Sources of unknown size (local rows, RDDs) count nothing; estimates of
    joins, which Catalyst multiplies, are not used.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 60)


def parts_for(df: DataFrame, bytes_each: int, least: int | None = None) -> int:
    """How many partitions hold ``df`` at about ``bytes_each`` of its source files."""
    spark = df.sparkSession
    least = least if least is not None else spark.sparkContext.defaultParallelism
    return int(min(1_000_000, max(1, least, -(-estimated_bytes(df) // bytes_each))))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skeinery-code-"), "skeinery_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("skeinery", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
