"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent a local master gets a folder of its own; any
    other master must name one, because executors cannot see a local folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="symgraph-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def files_for(rows: int, each: int) -> int:
    """How many files hold so many rows, `each` of them in one."""
    return max(1, -(-rows // each))


def materialize(df: DataFrame, name: str, codec: str | None = None, files: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    codec is Parquet's, where the session's own is not wanted. files bounds their number, and
    that of the tasks which write them, where the rows are known to be few: else each shuffle
    partition writes one, unless adaptive execution merges them. A bound above the partitions changes nothing.
    """
    if files is not None:
        df = df.coalesce(files)
    path = fresh_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that materialize() returned."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _path(spark: SparkSession, path: str):
    """A Hadoop path and the file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables as one new version below root; readers see it when the pointer is renamed, or nothing of it."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    staged, store = _path(spark, f"{root}/CURRENT-{version}")
    out = store.create(staged)
    out.write(bytearray("\n".join([version, *sorted(tables)]).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(store.makeQualified(staged), store.makeQualified(_path(spark, f"{root}/CURRENT")[0]), overwrite)
    return version


def committed_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version that the pointer names; none where nothing was committed."""
    pointer, store = _path(spark, f"{root}/CURRENT")
    if not store.exists(pointer):
        return {}
    version, *names = [r.value for r in spark.read.text(f"{root}/CURRENT").collect()]
    return {name: spark.read.parquet(f"{root}/{version}/{name}") for name in names}
