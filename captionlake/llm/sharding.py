"""Balanced sharding by sampled splitters (DataFrame functions only).

Records are ordered by key and a hash of their text. Size-weighted samples give the splitters of ranges; every
range is then measured exactly, and overfull ones are subdivided by splitters sampled in them. Byte positions
along that order cut it into shards, so the result doesn't depend on the samples, on files or on tasks. Equal
records are one row with a count until the end: a record that repeats a billion times is arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

#: Splitter ranges at each of two levels, expected sampled records for each of them, and different records that one cell should hold.
RANGES, SAMPLES_PER_RANGE, CELL_ROWS = 256, 48, 10_000
#: Splitters are searched in two steps, as a page of splitters and a place on that page.
PAGE = 16
#: Copies of a record that a task writes out.
COPIES = 10_000


def _place(at: Column, pages: Column) -> Column:
    """How many splitters are <= at; ``pages``: sorted splitters as an array of arrays of PAGE."""
    page = F.size(F.filter(pages, lambda p: F.get(p, 0) <= at))
    return F.when(pages.isNull() | (page == 0), 0).otherwise((page - 1) * PAGE + F.size(F.filter(F.get(pages, page - 1), lambda s: s <= at)))


def _splitters(drawn: DataFrame, parts: Column, by: list[str]) -> DataFrame:
    """by, pages: splitters at the quantiles of the weights of ``drawn`` (at, weight), sorted, in pages. Samples are bounded."""
    w = Window.partitionBy(*by)
    run = drawn.withColumns({"upto": F.sum("weight").over(w.orderBy("at")), "all": F.sum("weight").over(w)})
    cut = run.withColumn("part", F.floor((F.col("upto") - F.col("weight")) * parts / F.col("all"))).groupBy(*by, "part").agg(F.min("at").alias("at")).filter("part > 0")
    cuts = cut.groupBy(*by).agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / PAGE).cast("int")), lambda i: F.slice("cuts", i * PAGE + 1, F.lit(PAGE)))
    return cuts.select(*by, pages.alias("pages"))


@tidy
def shard_records(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", ranges: int = RANGES, samples_per_range: int = SAMPLES_PER_RANGE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Put every record into one of ``n_shards`` shards of nearly equal bytes.

    A record's size is the UTF-8 bytes of its text (null: none) plus 1. Shards follow the order of key (nulls
    first), xxhash64 of the text, CRC and size; a record goes where the middle of its bytes lies. Returns key,
    size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), one row for each input row.

    Repeated keys and repeated rows are kept and may fall on both sides of a cut: a key that holds a third of
    all rows is an overfull range, which is subdivided by hashes of its texts, and equal rows are one row with a
    count. Empty and null texts have size 1. A text larger than a shard's share has a shard in which others are
    few or none. Very long texts are only hashed and measured. An empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("k"), F.xxhash64(t).alias("h"), F.crc32(t.cast("binary")).alias("crc"), (F.octet_length(t) + 1).cast("long").alias("size"))
    base = written(own.groupBy("k", "h", "crc", "size").agg(F.count("*").alias("n")).withColumn("at", F.struct(F.col("k").isNotNull().alias("given"), "k", "h")))
    total = base.agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).first()["bytes"] or 0

    def drawn(df: DataFrame, expected: Column) -> DataFrame:
        """A sample with ``expected`` draws of each row; rows that expect more than one are one with that weight."""
        return df.filter(F.pmod(F.xxhash64("k", "h", F.lit("draw")), F.lit(1 << 40)) < expected * float(1 << 40)).withColumn("weight", F.greatest(expected, F.lit(1.0)))

    expected = F.col("size") * F.col("n") * (ranges * samples_per_range / max(total, 1))
    first = _splitters(drawn(base, expected).withColumn("every", F.lit(0)), F.lit(ranges), ["every"]).first()  # at most `ranges` splitters
    kind = docs.schema[key].dataType
    literal = lambda x: F.struct(F.lit(x["given"]).alias("given"), F.lit(x["k"]).cast(kind).alias("k"), F.lit(x["h"]).cast("long").alias("h"))
    placed = base.withColumn("range", _place(F.col("at"), F.array(*[F.array(*map(literal, page)) for page in first["pages"]])) if first else F.lit(0))
    # one row for each range, so at most `ranges` rows reach the driver
    measured = placed.groupBy("range").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("bytes")).orderBy("range").collect()
    if not measured:
        return base.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    of_range = lambda values: F.element_at(F.create_map(*[F.lit(x) for m, v in zip(measured, values, strict=True) for x in (m["range"], v)]), F.col("range"))
    before = lambda c: [sum(m[c] for m in measured[:i]) for i in range(len(measured))]
    parts = [min(ranges, -(-m["kinds"] // cell_rows)) for m in measured]

    wide = placed.withColumn("parts", of_range(parts))
    rate = of_range([p * samples_per_range / m["kinds"] if p > 1 else 0.0 for p, m in zip(parts, measured, strict=True)])
    second = written(_splitters(drawn(wide, rate), F.col("parts"), ["range"]))  # at most ranges ** 2 splitters
    celled = wide.join(F.broadcast(second), "range", "left").withColumn("cell", _place(F.col("at"), F.col("pages"))).drop("pages", "parts", "at")
    in_range = Window.partitionBy("range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy("range", "cell").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("bytes")).select(
        "range", "cell", *[(of_range(before(c)).cast("long") + F.coalesce(F.sum(c).over(in_range), F.lit(0))).alias(f"{c}0") for c in ("rows", "bytes")]
    )
    in_cell = Window.partitionBy("range", "cell").orderBy(F.col("k").asc_nulls_first(), "h", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c, x: F.col(f"{c}0") + F.coalesce(F.sum(x).over(in_cell), F.lit(0))
    ordered = celled.join(F.broadcast(written(cells)), ["range", "cell"]).select("k", "size", "crc", "n", start("rows", F.col("n")).alias("row"), start("bytes", F.col("size") * F.col("n")).alias("byte"))
    ordered = written(ordered)

    many = F.col("n") > COPIES
    chunks = ordered.filter(many).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("k", "row", "chunk")
    copy = lambda lo, hi: F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("i")
    each = ordered.filter(~many).select("*", copy(F.lit(0), F.col("n") - 1)).unionByName(
        chunks.select("*", copy(F.col("chunk") * COPIES, F.least((F.col("chunk") + 1) * COPIES, F.col("n")) - 1)).drop("chunk")
    )
    shard = F.least(F.floor((F.col("byte") + F.col("i") * F.col("size") + F.col("size") / 2) * n_shards / total), F.lit(n_shards - 1)).cast("int")
    out = written(each.select("k", "size", "crc", (F.col("row") + F.col("i")).alias("row"), shard.alias("shard")))
    first_row = out.groupBy("shard").agg(F.min("row").alias("row0"))  # n_shards rows
    return out.join(F.broadcast(first_row), "shard").select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("row0")).alias("slot"))
