"""Readers of files: JSON lines, glossaries, phrase packs, dictionaries, logs, subtitles, audio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that can't be parsed is a row whose _corrupt is the line. Count those with bad_lines()."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def bad_lines(rows: DataFrame) -> DataFrame:
    return rows.select(CORRUPT).agg(F.count(CORRUPT).alias("bad"), F.count("*").alias("lines"))


def strict_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of JSON lines. A bad line fails the read; an empty or repeated key fails the query that reads it."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    fine = (F.col("_n") == 1) & F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    checked = n.select(F.col(key).alias("_k"), F.when(fine, 1).otherwise(F.raise_error(F.concat(F.lit("bad or repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).alias("_ok"))
    return rows.join(checked, F.col(key).eqNullSafe(F.col("_k"))).filter("_ok = 1").drop("_k", "_ok")


def glossary(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Active terms (zh, en) of a CSV with a header, of a JSON list or of {"terms": [...]}."""
    if kind == "csv":
        rows = spark.read.schema("zh string, en string, status string").option("header", True).csv(path)
    else:
        term = "zh string, en string, status string"
        text = spark.read.text(path, wholetext=True)
        bare = F.trim("value").startswith("[")
        lists = F.when(bare, F.from_json("value", f"array<struct<{term}>>")).otherwise(F.from_json("value", f"struct<terms:array<struct<{term}>>>")["terms"])
        rows = text.select(F.explode(lists).alias("t")).select("t.*")
    return rows.filter(F.coalesce(F.col("status"), F.lit("active")) == "active").select("zh", "en")


def phrase_pack(spark: SparkSession, path: str, longest: int = 240) -> DataFrame:
    """zh, en, ja of a TSV file; rows with longer fields go, and of equal folded keys the first stays."""
    rows = spark.read.schema("zh string, en string, ja string").option("sep", "\t").option("quote", "").csv(path)
    fit = rows.filter((F.length("zh") > 0) & (F.greatest(*[F.length(F.coalesce(c, F.lit(""))) for c in ("zh", "en", "ja")]) <= longest))
    first = F.min_by(F.struct("zh", "en", "ja"), "at")
    return fit.withColumn("at", F.monotonically_increasing_id()).groupBy(F.lower(F.trim("zh")).alias("key")).agg(first.alias("r")).select("key", "r.*")


def cedict(spark: SparkSession, path: str) -> DataFrame:
    """word, alternative, pronunciation, en of "trad simp [pinyin] /defs/" lines; comments are skipped, other lines have rejected true."""
    pattern = r"^(\S+) (\S+) \[([^\]]*)\] /(.*)/\s*$"
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    bad = ~F.col("value").rlike(pattern) | F.contains("value", F.lit("�"))
    part = lambda i: F.when(~bad, F.regexp_extract("value", pattern, i))
    return lines.select(part(1).alias("word"), part(2).alias("alternative"), part(3).alias("pronunciation"), F.split(part(4), "/").alias("en"), bad.alias("rejected"))


def word_csv(spark: SparkSession, path: str) -> DataFrame:
    """word, phonetic, definition, translation, pos, tag, exchange of a CSV with quoted line breaks; rejected where a row has no word."""
    names = ["word", "phonetic", "definition", "translation", "pos", "tag", "exchange"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("rejected", F.coalesce(F.trim("word"), F.lit("")) == "")


def log_tail(spark: SparkSession, path: str, tag: str, schema: str, last: int) -> DataFrame:
    """The JSON of the last lines of the form "... TAG {json}"."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    found = lines.select("at", F.from_json(F.regexp_extract("value", rf"{tag} (\{{.*\}})\s*$", 1), schema).alias("r")).filter("r IS NOT NULL")
    return found.orderBy(F.desc("at")).limit(last).orderBy("at").select("r.*")


def cues(spark: SparkSession, path: str) -> DataFrame:
    """file, number, t0, t1 (ms), text of SRT and WebVTT files. A block without a time line is no cue; an hour may be missing."""
    time = r"(?:(\d{1,3}):)?([0-5]\d):([0-5]\d)[.,](\d{3})"
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    blocks = files.select("file", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("number", "block")).filter(F.col("block").rlike(rf"{time}\s*-->\s*{time}"))
    line = rf"(?s)^.*?{time}\s*-->\s*{time}[^\n]*\n?(.*)$"
    n = lambda i: F.coalesce(F.regexp_extract("block", line, i).try_cast("long"), F.lit(0))
    ms = lambda i: ((n(i) * 60 + n(i + 1)) * 60 + n(i + 2)) * 1000 + n(i + 3)
    return blocks.select("file", "number", ms(1).alias("t0"), ms(5).alias("t1"), F.regexp_replace(F.regexp_extract("block", line, 9), r"^\s+|\s+$", "").alias("text"))


def wave_info(spark: SparkSession, path: str) -> DataFrame:
    """file, rate, channels, seconds, rms of PCM16 WAV files; nulls where a file isn't one."""
    import io
    import wave

    import numpy as np
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    kind = StructType().add("rate", IntegerType()).add("channels", IntegerType()).add("seconds", DoubleType()).add("rms", DoubleType())

    @F.pandas_udf(kind)
    def info(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            try:
                with wave.open(io.BytesIO(bytes(c))) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype("float64") / 32768
                    rows.append((w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate(), float(np.sqrt((x * x).mean())) if len(x) else 0.0))
            except (wave.Error, EOFError, ValueError):
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["rate", "channels", "seconds", "rms"]).astype({"rate": "Int32", "channels": "Int32", "seconds": "float64", "rms": "float64"})

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), info("content").alias("i")).select("file", "i.*")


def metrics_tail(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The last typed rows of a rotating metrics file; lines of other types are left out."""
    rows = tolerant_jsonl(spark, path, "kind string, elapsed_ms double, ok boolean, at double").filter(f"{CORRUPT} IS NULL AND kind IS NOT NULL AND elapsed_ms >= 0").drop(CORRUPT)
    return rows.orderBy(F.desc("at"), "kind").limit(last)
