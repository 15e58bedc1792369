"""Where work tables go, and files of the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: What Spark raises for files that are missing, of another format, or damaged.
UNREADABLE = (PySparkException, Py4JJavaError, ValueError)


#: Environment of Python workers: large arrays go back to the system when they are freed.
MALLOC = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "16777216", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows with contents that an Arrow batch holds at most.
BATCH_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder they start in. On a cluster that folder
    is shared, or the package is installed. Bounds what workers hold too: the session's Arrow batches, whose default of 10,000 rows is
    meant for rows of a few numbers, and memory that is freed but kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    for k, v in MALLOC.items():
        spark.sparkContext.environment.setdefault(k, v)
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may do without that setting."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='treeplan-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of the shared one that nothing else uses; it is not made yet."""
    return f"{shared_folder(spark)}/treeplan/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop objects: paths may be in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def remove(spark: SparkSession, path: str) -> None:
    place, files = hadoop_path(spark, path)
    files.delete(place, True)


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Makes a file with this content, all at once, unless there is one: it is written under another name and renamed."""
    part, files = hadoop_path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = files.create(part, True)
    out.write(bytearray(data))
    out.close()
    place, jvm = hadoop_path(spark, path)[0], spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(part, place, options)
    except Exception:
        files.delete(part, False)
        if files.exists(place):
            return False
        raise
    return True
