"""Spark session for local use, and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: str = "8", app: str = "runlens", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own, since
    there driver and executors are one process.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="runlens-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/runlens/{purpose}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder this package has written, if it is there."""
    store, path = _store(spark, folder)
    store.delete(path, True)


def make_folder(spark: SparkSession, folder: str) -> None:
    """Create a folder unless it is there."""
    store, path = _store(spark, folder)
    store.mkdirs(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    store, path = _store(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file the driver has written, None if it is not there."""
    store, at = _store(spark, path)
    if not store.exists(at):
        return None
    data = store.open(at)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def write_note(spark: SparkSession, path: str, text: str, new: bool = False) -> None:
    """Write a small file whole or not at all; with ``new`` it must not be there yet."""
    store, at = _store(spark, path)
    _, aside = _store(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not new and store.exists(at):
        store.delete(at, False)
    if not store.rename(aside, at):
        store.delete(aside, False)
        raise FileExistsError(path)


@contextmanager
def staging(spark: SparkSession, purpose: str) -> Iterator[str]:
    """A folder for tables that live as long as one job; removed at its end."""
    folder = new_folder(spark, purpose)
    try:
        yield folder
    finally:
        delete(spark, folder)
