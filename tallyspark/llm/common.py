"""Helpers that the text operators share: shared storage, batch bounds, small numeric pieces."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; with texts of some KB a batch stays at a few MB.
ARROW_ROWS = 1000
#: Bytes of one Arrow batch, about, where the engine can bound them.
ARROW_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            base = tempfile.mkdtemp(prefix="tallyspark-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut and a lost
    executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a table that `stored` wrote, once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = shared_dir(spark)
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop.Path(parent)
        if base.split(":", 1)[-1].lstrip("/") in parent:
            path.getFileSystem(conf).delete(path, True)


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Before Python runs on executors: hands them this package, and lowers the rows and bytes of an Arrow batch,
    so that long texts don't fill a worker. Plans run later, so the session keeps these settings."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyspark_sent", None) is None:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tallyspark-code-")) / "tallyspark.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, f"{package.name}/{source.relative_to(package)}")
        sc.addPyFile(str(archive))
        sc._tallyspark_sent = True
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def joined_by_hot_key(left: DataFrame, right: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """left LEFT JOIN right, which has one row a key, where one key may be that of a third of left.

    Up to `most` rows of right are broadcast; of more, the `most` with the largest weight (rows of left) are, and only
    rows of other keys are dealt by key. Null keys are never dealt.
    """
    if right.count() <= most:
        return left.join(F.broadcast(right), key, "left")
    heavy = right.orderBy(F.desc(weight), key).limit(most)
    mark = free_name(left, "_heavy")
    near = left.join(F.broadcast(heavy.withColumn(mark, F.lit(True))), key, "left")
    far = left.where(F.col(key).isNotNull()).join(F.broadcast(heavy.select(key)), key, "left_anti").join(right, key, "left")
    return near.where(F.col(mark).isNotNull() | F.col(key).isNull()).drop(mark).unionByName(far)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
