"""Writers: versioned upserts, snapshots behind a pointer, exports, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table after changes: of each key the row of the greatest version, of equal ones the change."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_new"))).alias("_r")).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in current.columns])


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows of a table and a checksum that doesn't hang on their order: the sum of two hashes of each row."""
    cells = [F.to_json(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes]
    both = df.select(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b"))
    r = both.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    return r["n"], f"{r['a'] or 0}:{r['b'] or 0}"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of each file under a path: what a conversion reports of both of its sides."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_snapshot(df: DataFrame, root: str, name: str, expected: tuple[int, str] | None = None) -> tuple[int, str]:
    """Write a snapshot, read it back, and only if its digest is that of ``df`` (and ``expected``, if it is given) let the pointer go to it.

    A pointer is a folder pointer-<number>-<name> that is made under another name and renamed; the greatest number counts, so readers
    see the old or the new snapshot at every moment, and what fails before the rename changes nothing that they see.
    """
    spark, path = df.sparkSession, f"{root}/snapshot={name}"
    df.write.mode("overwrite").parquet(path)
    found = digest(spark.read.parquet(path))
    if found != digest(df) or (expected is not None and found != tuple(expected)):
        raise ValueError(f"snapshot {name} isn't what it should be: {found}")
    fs, folder = _fs(spark, f"{root}/.making-{name}")
    fs.mkdirs(folder)
    number = max([n for n, _ in _pointers(spark, root)], default=0) + 1
    if not fs.rename(folder, spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer-{number:012d}-{name}")):
        raise OSError(f"the pointer to {name} can't be set")
    return found


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, p = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [(int(n.split("-", 2)[1]), n.split("-", 2)[2]) for n in names if n.startswith("pointer-")]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    _, name = max(_pointers(spark, root))
    return spark.read.parquet(f"{root}/snapshot={name}")


def batch_sink(path: str, dead: str, bad: Callable[[DataFrame], Column]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: good rows under ``path``, rows that are ``bad`` (or can't be told) under ``dead``, each batch in a folder of its own that a repeated batch overwrites."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            good, rest = split_bad(kept, bad(kept))
            good.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            rest.write.mode("overwrite").json(f"{dead}/batch={batch_id:012d}")
        finally:
            kept.unpersist()

    return run


def replay(spark: SparkSession, dead: str, schema: str, write: Callable[[DataFrame], None]) -> int:
    """Hand the dead letters to ``write`` again, oldest batch first, each removed once it is written; the first failure stops, and the rest is kept. Returns the batches written."""
    fs, p = _fs(spark, dead)
    names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
    done = 0
    for name in (n for n in names if n.startswith("batch=")):
        try:
            write(spark.read.schema(schema).json(f"{dead}/{name}"))
        except Exception:
            return done
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{dead}/{name}"), True)
        done += 1
    return done


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Gzipped JSON lines in order across files: the ranges of files follow the order, so no task sorts the whole."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path, compression="gzip")


def split_bad(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to write, and rows for the dead-letter table (with a null condition too)."""
    is_bad = F.coalesce(bad, F.lit(True))
    return df.filter(~is_bad), df.filter(is_bad)


def guarded_csv(df: DataFrame, path: str) -> None:
    """CSV whose string cells can't be formulas: one that begins with = + - @ tab or return gets an apostrophe."""
    risky = lambda c: F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r")
    cells = [F.when(risky(F.col(c)), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)
