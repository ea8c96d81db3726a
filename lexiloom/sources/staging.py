"""Tables written once into the folder that driver and executors share, and even scans of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it goes when the application ends.

    Only a local session without that setting gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    if named := spark.conf.get("spark.checkpoint.dir", None):
        home = f"{named.rstrip('/')}/lexiloom/{app}"
    elif spark.sparkContext.master.startswith("local["):
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='lexiloom-')}"
        home = _own[app]
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if home not in _marked:
        at = spark._jvm.org.apache.hadoop.fs.Path(home)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _marked.add(home)
    return home


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends here.

    A lost executor costs its running tasks only; the files stay.
    """
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name), compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    if path := getattr(df, "_staged_path", None):
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Files below this size are not worth an exchange.
LEAST_BYTES = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer row groups than cores, dealt out once by round robin; others as they are.

    A row group is read by one task, however files are split. Only where there are fewer files than
    cores are their footers looked at, so the driver never reads more footers than there are cores.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups = size = 0
    for f in files:
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        size += status.getLen()
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
        groups += reader.getRowGroups().size()
        reader.close()
    return df.repartition(2 * cores) if groups < cores and size >= LEAST_BYTES else df
