"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "captionlake-"
_made: ContextVar[list | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a new folder in local mode (tests); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix=PREFIX)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what was computed survives the loss of any executor, is computed once
    (checkpoint() computes its plan twice) and has the same rows in the same files for every later reader.
    ``batch``: rows that Python tasks get at a time meanwhile, for rows that can be large.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/{PREFIX}{uuid.uuid4().hex}"
    before = spark.conf.get(name)
    try:
        if batch:
            spark.conf.set(name, str(batch))
        df.write.parquet(path)
    finally:
        if batch:
            spark.conf.set(name, before)
    made = _made.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[-1].startswith(PREFIX):
                _delete(df.sparkSession, folder)


def tidy(operator: Callable) -> Callable:
    """Delete the tables that ``operator`` has written once it returns, except those that its result reads."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        outer, made = _made.get(), []
        token = _made.set(made)
        try:
            out = operator(*args, **kwargs)
        finally:
            _made.reset(token)
        read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
        kept = [path for path in made if path.rsplit("/", 1)[-1] in read]
        for path in set(made) - set(kept):
            _delete(out.sparkSession, path)
        if outer is not None:
            outer += kept
        return out

    return run


#: Bits of a filter for each key, and in all (32 MB, in 8,192 chunks): beyond 8 million keys a filter lets more through.
FILTER_BITS, MOST_BITS = 32, 1 << 28


def split_by_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have one of ``keys`` (a written table), and those that surely have none.

    A bitmap of the keys' hashes, whose size is bounded, is sent to all tasks, so rows that are not asked for stay where
    they are, however many keys there are; only the first part has to meet the keys by a shuffle. Rows with a null among the columns are in the second part.
    """
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(15, (FILTER_BITS * keys.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    chunks = written(keys.select(place.alias("p")).groupBy((F.col("p") / 32768).cast("long").alias("_chunk")).agg(F.bitmap_construct_agg((F.col("p") % 32768).cast("long")).alias("_bits")))
    put = rows.withColumn("_p", F.when(reduce(Column.__or__, [F.col(c).isNull() for c in on]), F.lit(None)).otherwise(place))
    put = put.withColumn("_chunk", (F.col("_p") / 32768).cast("long")).join(F.broadcast(chunks), "_chunk", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_p") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_b, cast(_p % 8 AS int)) % 2 = 1"), F.lit(False))
    put = put.withColumn("_b", byte).withColumn("_hit", hit)
    return put.filter("_hit").select(*rows.columns), put.filter("NOT _hit").select(*rows.columns)


def runs(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Whole groups of rows of one value of ``column``, from batches that are sorted by it (values are hashes or numbers, never null)."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        v = b[column].to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1), len(v)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0][column].iat[0] != v[lo]:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(b.iloc[lo:hi])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def vocabulary_path(file: str) -> str:
    """A vocabulary file by its path, or by its name among the public tokenizers."""
    if "/" in file:
        return file
    import public_tokenizers

    return public_tokenizers.path(file)
