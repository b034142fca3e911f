"""Small files that appear whole or not at all: what makes a version or a save count."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the constructor of its paths."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path_of


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, path_of = file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path_of(folder))] if fs.exists(path_of(folder)) else []


def put_if_absent(spark: SparkSession, path: str, content: dict) -> bool:
    """Makes the file with this content unless there is one of that name; tells whether it did.

    The content is written under another name first and closed, then the name is given to it in one step that fails if the name
    is taken: a hard link on local disks, a rename without overwriting elsewhere. That step is atomic on
    HDFS and local disks. Object stores have no such rename: there one writer at a time has to be
    ensured from outside.
    """
    jvm = spark.sparkContext._jvm
    fs, path_of = file_system(spark, path)
    folder, name = path.rsplit("/", 1)
    draft, final = path_of(f"{folder}/.draft-{name}-{uuid.uuid4().hex}"), path_of(path)
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            nio = jvm.java.nio.file.Paths.get
            none = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
            local = lambda p: nio(p.toUri().getPath(), none)
            jvm.java.nio.file.Files.createLink(local(final), local(draft))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def read_commit(spark: SparkSession, path: str) -> dict | None:
    """The file's content; None where it is torn, which no file made by put_if_absent is."""
    fs, path_of = file_system(spark, path)
    stream = fs.open(path_of(path))
    try:
        held = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()
    return held if isinstance(held, dict) else None
