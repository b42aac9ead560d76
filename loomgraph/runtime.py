"""Session helpers: the folder all executors share, written tables, and the Python path of the workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only on a local master that names none (tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set(CHECKPOINT_DIR, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def trim(spark: SparkSession) -> str:
    """Give the memory that the driver's JVM has freed outside its heap back to the system; says how much, or nothing.

    Hundreds of Spark's threads, and the compiler's, free into arenas of their own, which the C library keeps. JVMs
    that have no such command are left alone.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    none = new_array(jvm.java.lang.Object, 0), new_array(jvm.java.lang.String, 0)
    given = new_array(jvm.java.lang.Object, 4)
    try:
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1], given[2], given[3] = "systemTrimNativeHeap", *none
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # By the interface: the server's own class is closed to callers.
        method = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        return method.invoke(server, given)
    except Py4JError:
        return ""


def spread(df: DataFrame, *keys: str, times: int = 2) -> DataFrame:
    """df dealt out by the keys to a fixed number of tasks: adaptive plans would join small groups of long work in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), times * spark.sparkContext.defaultParallelism), *keys)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialise(); other frames are left alone."""
    path = getattr(df, "_loomgraph_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch between Spark and its Python workers, where the session leaves the default: texts are long.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Make the workers find this checkout, whatever folder the driver was started in, keep their batches small, and trim the driver."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    trim(spark)
