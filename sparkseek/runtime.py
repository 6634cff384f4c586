"""Helpers that every operator shares: shared storage, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

_local_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary one stands in only in local mode; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="sparkseek-"))
        atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
    return f"file://{_local_dirs[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. On a file system that the driver sees as such it is removed when the driver ends; elsewhere
    the folder's own clean-up applies."""
    path = f"{shared_dir(spark)}/sparkseek/{name}-{uuid.uuid4().hex}"
    local = local_path(spark, path)
    if local:
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return path


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the driver's file system has it; None on another file system."""
    fs, p = hadoop_path(spark, path)
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers of the application, once: they may lack the folder it was imported from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="sparkseek-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "sparkseek_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("sparkseek", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sparkseek_path = path
    return back


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of the files of a table that ``materialize`` gave; None for anything derived from one."""
    path = getattr(df, "_sparkseek_path", None)
    if path is None:
        return None
    fs, p = hadoop_path(df.sparkSession, path)
    return fs.getContentSummary(p).getLength()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a side whose size is known: at most ``max_bytes`` in Parquet and ``max_rows`` rows.

    The side is written first unless ``materialize`` gave it, so its plan runs once, and both figures come from the files (the rows from
    their footers). Beyond either bound it is joined as any table: a shuffle join, whose hot keys AQE splits.
    """
    df = df if stored_bytes(df) is not None else materialize(df, "side")
    return F.broadcast(df) if stored_bytes(df) <= max_bytes and df.count() <= max_rows else df


def commit_file(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Make ``content`` visible as ``folder/name`` at once; False if that name is taken. Rename without overwrite is atomic on HDFS-like stores."""
    fs, tmp = hadoop_path(spark, f"{folder}/{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(content.encode()))
    out.close()
    target, local = hadoop_path(spark, f"{folder}/{name}")[1], local_path(spark, f"{folder}/{name}")
    try:
        if local:  # POSIX renames overwrite, links don't
            os.link(tmp.toUri().getPath(), local)
            return True
        return not fs.exists(target) and fs.rename(tmp, target)
    except FileExistsError:
        return False
    except OSError:  # a file system without links
        return not fs.exists(target) and fs.rename(tmp, target)
    finally:
        fs.delete(tmp, False)


def last_committed(spark: SparkSession, folder: str) -> int:
    """The greatest number that ``commit_file`` took as a name in ``folder``; 0 if none."""
    fs, p = hadoop_path(spark, folder)
    return max((int(n) for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit()), default=0) if fs.exists(p) else 0


def read_committed(spark: SparkSession, folder: str, name: str | int) -> str:
    fs, p = hadoop_path(spark, f"{folder}/{name}")
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
