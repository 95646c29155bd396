"""Helpers that the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; resolved on whichever machine runs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    A folder of this machine is set up where that is unset, if the master is
    local too; elsewhere that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "sieveline-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame: files in the shared folder, removed when no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> str:
    """Write a frame as Parquet into the shared folder; its path there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``write_table`` made and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it again."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def rowed(docs: DataFrame) -> Column:
    """All columns of ``docs`` but the text as one struct ``row``, so that none clashes with an operator's own."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")


def unrowed(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from ``row`` and ``text``."""
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], *, salts: int = 16, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; a key's rows of ``left`` are dealt over ``salts`` tasks by the hash of ``spread``."""
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return dealt.join(many, [*on, "__salt"], how).drop("__salt")


def heavy_keys(sizes: DataFrame, key: str, weight: str, total: int) -> list[int]:
    """The keys (long) with more than a thousandth of all ``total`` rows by ``weight``: fewer than 1000."""
    return sorted(r[0] for r in sizes.where(F.col(weight) > total / 1000).select(key).collect())


def heavy_join(left: DataFrame, right: DataFrame, key: str, heavy: list[int]) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key.

    A key of very many rows would make one long task; the rows of the
    ``heavy`` ones stay where they are, and their side of ``right`` is broadcast.
    """
    if not heavy:
        return left.join(right, key)
    hot = F.col(key).isin(heavy)
    return left.where(hot).join(F.broadcast(right.where(hot)), key).unionByName(left.where(~hot).join(right.where(~hot), key))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once per row, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value``, kept in a column of its own: a filter above is not pushed below it with a copy.

    Copies would land inside lambdas and be computed for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def word_list(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
