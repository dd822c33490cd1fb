"""Joins that Spark plans as nested loops unless they are rewritten as equi-joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.run import kept


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last ``right`` row of its key whose ``on`` is not later; both sides are sorted once, in a union."""
    pick = [F.col(v) for v in values]
    r = right.select(*keys, F.col(on), F.struct(*pick).alias("_v"), F.lit(0).alias("_side"))
    cols = [c for c in left.columns if c not in (*keys, on)]
    both = left.withColumns({"_v": F.lit(None).cast(r.schema["_v"].dataType), "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return filled.select(*keys, on, *cols, *[F.col(f"_v.{v}").alias(v) for v in values])


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], bin_width: int) -> DataFrame:
    """Pairs of equal keys whose spans [start, end) overlap. Spans are put into bins; a pair meets in the bin of the later start only, so it comes once. Columns of a and b, except keys, must differ."""
    (a0, a1), (b0, b1) = a_span, b_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width)))
    x = a.filter(F.col(a1) > F.col(a0)).withColumn("_bin", bins(a0, a1))
    y = b.filter(F.col(b1) > F.col(b0)).withColumn("_bin", bins(b0, b1))
    once = F.col("_bin") == F.floor(F.greatest(a0, b0) / bin_width)
    return x.join(y, [*keys, "_bin"]).filter((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & once).drop("_bin")


#: Rows of a stripe of a group, about: a pair of stripes is what one task compares at least.
STRIPE = 8192


def edit_pairs(rows: DataFrame, keys: list[str], key: str, text: str, most: int, stripe: int = STRIPE) -> DataFrame:
    """a, b, d: pairs of rows of equal ``keys``, a's ``key`` being less than b's, whose texts are ``most`` edits apart or fewer.

    Equal texts are compared once, as one row with their keys. A group is cut into stripes by a hash, and pairs of stripes are dealt out
    to as many tasks as a shuffle has, however few bytes they are, since the work grows with the square of a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.select(*keys, F.col(key).alias("_i"), F.col(text).alias("_t")).filter("_i IS NOT NULL AND _t IS NOT NULL")
    sizes = r.groupBy(*keys).agg(F.ceil(F.count("*") / stripe).cast("int").alias("_n"))
    striped = r.join(sizes, keys).withColumn("_s", F.pmod(F.xxhash64("_i"), "_n").cast("int"))
    texts = striped.groupBy(*keys, "_n", "_s", "_t").agg(F.collect_list("_i").alias("_is"))
    x = texts.select(*keys, F.col("_s").alias("_low"), F.explode(F.sequence(F.col("_s"), F.col("_n") - 1)).alias("_high"), F.col("_t").alias("_x"), F.col("_is").alias("_xs"))
    y = texts.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_s"))).alias("_low"), F.col("_s").alias("_high"), F.col("_t").alias("_y"), F.col("_is").alias("_ys"))
    cell = [*keys, "_low", "_high"]
    met = x.repartition(parts, *cell).join(y, cell).filter("_low < _high OR _x <= _y")
    d = F.explode_outer(F.array(F.levenshtein("_x", "_y", most).cast("long")))  # a column of its own, so it is computed once
    near = met.select(((F.col("_low") == F.col("_high")) & (F.col("_x") == F.col("_y"))).alias("_same"), "_xs", "_ys", d.alias("d")).filter("d >= 0")
    each = near.select("_same", "_ys", "d", F.explode("_xs").alias("_i")).select("_same", "d", "_i", F.explode("_ys").alias("_j")).filter("_i < _j OR (_i > _j AND NOT _same)")
    return each.select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), "d")


def any_of(a: DataFrame, b: DataFrame, conditions: list[Column], a_id: list[str], b_id: list[str]) -> DataFrame:
    """Pairs that meet at least one of several equi-conditions: one join for each, and each pair once."""
    out = None
    for c in conditions:
        part = a.join(b, c)
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates([*a_id, *b_id])


#: Characters of the terms of a wave, about: its automaton takes some 100 MB in a task.
TERM_CHARS = 2 << 20


def hits_of(texts: DataFrame, terms: DataFrame, text: str, term: str, found: Callable, kind: str, most_chars: int = TERM_CHARS) -> DataFrame:
    """``texts`` with a column ``term`` of ``kind``: found(automaton, text) for an automaton of all distinct, non-empty terms.

    Terms are dealt into waves of about ``most_chars`` characters by a hash, whose automata go to all tasks one after the
    other, so any number of terms is looked for, whatever their lengths; with more than one wave a row comes once for each, and the waves' rows are written.
    """
    spark = texts.sparkSession
    distinct = terms.select(F.col(term).alias("_t")).filter(F.length("_t") > 0).distinct()
    size = distinct.agg(F.sum(F.length("_t")).alias("chars")).first()["chars"] or 0
    n_waves = max(1, -(-size // most_chars))

    def scan(sent):
        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = ahocorasick.Automaton()
            for word in sent.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for t in batches:
                yield t.map(lambda x: found(automaton, x) if x and sent.value else [])

        return run(F.col(text))

    out = None
    for wave in range(n_waves):
        words = distinct.filter(F.pmod(F.xxhash64("_t"), F.lit(n_waves)) == wave).collect()  # a wave's terms
        part = texts.withColumn(term, scan(spark.sparkContext.broadcast([r[0] for r in words])))
        part = part if n_waves == 1 else kept(part)
        out = part if out is None else out.unionByName(part)
    return out


def containment(texts: DataFrame, terms: DataFrame, text: str, term: str, most_chars: int = TERM_CHARS) -> DataFrame:
    """Pairs of a text's row and a distinct term that it holds, in time linear in the texts for each wave of terms (hits_of)."""
    held = hits_of(texts, terms, text, term, lambda automaton, x: sorted({w for _, w in automaton.iter(x)}), "array<string>", most_chars)
    return held.withColumn(term, F.explode(term))


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, change (added, removed, changed, same) and old and new fields."""
    o = old.select(*keys, F.struct(*fields).alias("_o"))
    n = new.select(*keys, F.struct(*fields).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, change.alias("change"), *[F.col(f"{s}.{f}").alias(f"{p}_{f}") for s, p in (("_o", "old"), ("_n", "new")) for f in fields])
