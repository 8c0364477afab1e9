"""Small files on the shared store: the version log, pins, removal of folders.

Paths of the local file system (tests, or a folder that is mounted everywhere)
are used directly, all others through Hadoop's file system of the session.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid

from pyspark.sql import SparkSession


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the local file system, if that is where it points to."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme:
        return re.sub(r"^file:(//(?=/))?", "", path) if scheme[1] == "file" else None
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return path if (conf.get("fs.defaultFS") or "file:///").startswith("file:") else None


def _hadoop(spark: SparkSession, path: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = fs.Path(path)
    return fs, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder with their time of change (seconds); none if it does
    not exist."""
    if local := _local(spark, folder):
        if not os.path.isdir(local):
            return {}
        found = {}
        with os.scandir(local) as entries:
            for e in entries:
                try:
                    found[e.name] = e.stat().st_mtime
                except FileNotFoundError:  # removed meanwhile
                    pass
        return found
    _, place, system = _hadoop(spark, folder)
    if not system.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in system.listStatus(place)}


def read(spark: SparkSession, path: str) -> str | None:
    """Content of a file; None if it does not exist."""
    if local := _local(spark, path):
        try:
            with open(local, encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None
    _, place, system = _hadoop(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content at once, unless it exists. Of any
    number of writers at most one is told True."""
    folder, name = path.rsplit("/", 1)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if local := _local(spark, path):
        aside = _local(spark, aside)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(aside, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(aside, local)  # fails where the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
    fs, place, system = _hadoop(spark, path)
    out = system.create(fs.Path(aside), False)
    out.write(bytearray(text.encode()))
    out.close()
    gateway, rename = spark.sparkContext._gateway, getattr(fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    from py4j.protocol import Py4JJavaError
    try:
        fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
            fs.Path(aside), place, options)
        return True
    except Py4JJavaError as e:
        system.delete(fs.Path(aside), False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; nothing if there is none."""
    if local := _local(spark, path):
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
        elif os.path.exists(local):
            os.unlink(local)
        return
    _, place, system = _hadoop(spark, path)
    system.delete(place, True)
