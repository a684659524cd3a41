"""Session helpers shared by every module: shared storage, materialisation, code shipping."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(app: str = "quire", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for; a cluster brings its own."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder in it."""
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def discard(*paths: str) -> None:
    """Delete intermediate tables. What can't be deleted stays; nothing depends on it."""
    for path in paths:
        with contextlib.suppress(OSError, ValueError):
            store, folder = open_store(path)
            store.delete_dir(folder)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes the shared tables that were made inside, when their results have been written elsewhere."""
    before = len(_made)
    try:
        yield
    finally:
        discard(*_made[before:])
        del _made[before:]


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage ends here, lost executors don't matter."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    discard(*[t._quire_path for t in tables if hasattr(t, "_quire_path")])


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out over the cores; larger scans stay as they are.

    Small inputs come as a file or two; without this, heavy row-local work on them runs in one task. It places rows, and changes no result."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_code(spark: SparkSession) -> None:
    """Send the package to Python workers unless they can import it from their own path already."""
    context = spark.sparkContext
    on_path = [str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in on_path or getattr(context, "_quire_shipped", False):
        return
    handle, name = tempfile.mkstemp(prefix="quire-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as archive:
        for path in (ROOT / "quire").rglob("*.py"):
            archive.write(path, str(path.relative_to(ROOT)))
    context.addPyFile(name)
    if name in sys.path:  # the driver keeps importing from the source tree
        sys.path.remove(name)
    context._quire_shipped = True
