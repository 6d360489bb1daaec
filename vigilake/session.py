"""Session defaults, table access and shared scratch space."""

from __future__ import annotations

import os
import pathlib
import site
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vigilake", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings every module assumes (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a session, where they would not
    find it by themselves (neither installed, nor on PYTHONPATH, nor in the working
    folder)."""
    root = pathlib.Path(__file__).resolve().parent.parent
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    context = spark.sparkContext
    if str(root) in {os.path.realpath(p) for p in found if p} or getattr(context, "_vigilake_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="vigilake-"), "vigilake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.glob("vigilake/**/*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(archive)
    context._vigilake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be on any file system Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(warehouse: str) -> str:
    """The warehouse's folder, refused where it is a machine's own."""
    if "://" not in warehouse or warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is `spark.checkpoint.dir` of the session. Where that is unset, a local
    session (tests) gets a temporary folder and a cluster gets a folder in the
    warehouse, if that is on a shared file system: a cluster without either is
    refused, since executors do not share a machine's own folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="vigilake-")
        else:
            root = shared_folder(spark.conf.get("spark.sql.warehouse.dir")) + "/_vigilake"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/vigilake-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    _MADE.append(fs.makeQualified(folder).toString())
    return f"{fs.makeQualified(folder).toString()}/{name}"


def scratch_mark() -> int:
    """A point in the order of the folders made, for `release`."""
    return len(_MADE)


def release(spark: SparkSession, since: int, keep: str) -> None:
    """Remove the folders made after `since`, but the one that holds `keep`: what was
    computed from them must be written."""
    for folder in _MADE[since:]:
        if not keep.startswith(folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE[since:] = [folder for folder in _MADE[since:] if keep.startswith(folder)]


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends here
    and a lost executor costs nothing that was already computed."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
