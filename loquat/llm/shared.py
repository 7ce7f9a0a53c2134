"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see (`spark.checkpoint.dir`).

    Where the session names none and runs on one machine, as in tests, a
    temporary folder is made and set; a cluster has to name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loquat-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the
    lineage ends there, and a lost executor costs a read, not a recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `materialise` wrote for these frames.  Only for frames that
    nothing reads any more: all that came of them has been written itself."""
    for f in frames:
        path = getattr(f, "written_to", None)
        if path:
            at = f.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(f.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def addressed(df: DataFrame, first: str, second: str) -> DataFrame:
    """Add two longs that name a row wherever it is read again: the hash of its
    file's path and its place in the file.  Rows of no file are written first."""
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(first), F.col("_metadata.row_index").alias(second))
    except AnalysisException:
        return addressed(materialise(df, "rows"), first, second)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Bound the batches that go to Python workers by bytes, as texts may be
    long, unless the session has a bound of its own."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, size)
    return spark


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids count as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: tuple[int, int], longest: int = 200_000):
    """A bounded sample of labelled training rows: whole texts of at most
    `longest` characters.

    Of the classes 0 and 1 the per_class[0] and per_class[1] rows with the smallest hash of
    doc_id, without the rows whose crc bucket is `held_out`.  Returns the list
    of (text, label) and the number of labelled training rows of each class.
    Rows with a null id or label are left out; where an id is labelled twice
    the larger label holds; where an id has several texts the largest holds."""
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_bucket("doc_id", modulus) != held_out))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("label = 0").orderBy(*order).limit(per_class[0]).unionByName(
        known.where("label = 1").orderBy(*order).limit(per_class[1]))
    rows = (
        docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .where(F.length("text") <= longest)
        .join(F.broadcast(picked), "doc_id")  # at most sum(per_class) rows
        .groupBy("doc_id", "label").agg(F.max("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    return [(r["text"], r["label"]) for r in rows], totals


def free(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh(df: DataFrame, name: str) -> str:
    """`name`, if `df` has no such column yet: an output never replaces one."""
    if free(df, name) != name:
        raise ValueError(f"there is a column {name!r} already; give another output name")
    return name
