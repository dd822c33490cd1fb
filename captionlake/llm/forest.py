"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits vectors at the middle of their projections on a random direction, again and again, until a leaf is small;
vectors near a split go to both sides. Splits are fitted on a bounded sample of a node's vectors, every vector is routed,
and leaves that stay too large are split again in the same way. Vectors are compared within leaves in double precision;
verified links are joined into components, and the links of a component's members are counted in the end.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, runs, tidy, written
from .components import connected_components

#: Vectors of a leaf (about), and twice that at most; vectors of a sample that a node's splits are fitted on (about), and of a sample's leaf at least.
LEAF, SAMPLE, LEAST_SAMPLE = 2048, 16384, 64
#: Part of a node's vectors on each side of a split that go to the other side as well.
OVERLAP = 0.05
#: Chance with which two vectors that are just similar enough meet in some leaf, by which the number of trees is chosen; trees at least.
RECALL, LEAST_TREES = 0.99, 4
#: Slack of angles (radians) within which a bound doesn't decide a pair.
SLACK = 1e-6
#: Rows of vectors that a task reads at a time.
ROWS_AT_ONCE = 16384


def trees_needed(n: int, similarity: float, leaf: int = LEAF, overlap: float = OVERLAP, recall: float = RECALL) -> int:
    """Trees in which two of n vectors of just that cosine meet with the wanted chance, if directions are spread evenly."""
    levels = math.ceil(max(0.0, math.log(max(n, 1) / leaf)) / math.log(1 / (0.5 + overlap)))
    if not levels:
        return 1
    normal, ratio = NormalDist(), math.sqrt(2 * (1 - similarity))
    u = 2 * normal.inv_cdf(0.5 + overlap) / ratio
    lost = normal.pdf(0) * ratio * 2 * (normal.pdf(u) - u * (1 - normal.cdf(u)))
    together = max(1e-6, (1 - lost) ** levels)
    return max(LEAST_TREES, math.ceil(math.log(1 - recall) / math.log1p(-together))) if together < 1 else LEAST_TREES


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    """Vectors of one length as rows of unit length in double precision."""
    m = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype("float64")
    m = m / np.abs(m).max(1, keepdims=True)  # squares of very large or small components stay in range
    return m / np.sqrt((m * m).sum(1, keepdims=True))


@functools.lru_cache(maxsize=1 << 12)
def _direction(node: int, split: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([node & ((1 << 64) - 1), split]).standard_normal(dim)
    return v / np.sqrt(v @ v)


def _jitter(ids: np.ndarray) -> np.ndarray:
    """A tiny number for each vector, by which vectors of one direction are still split."""
    x = ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(12)).astype("float64") * (1e-9 / 2**52)


def _split(node: int, x: np.ndarray, jitter: np.ndarray, n: float, leaf: int, least: int, overlap: float) -> list[tuple[float, float, int, int]]:
    """Splits of a node of n vectors, fitted on the sample x: (low, high, left, right); what is at most ``high`` goes left, what is at least ``low`` right. -1: a leaf."""
    out: list[tuple[float, float, int, int]] = []
    todo = [(np.arange(len(x)), n, -1, False)]
    while todo:
        rows, size, parent, right = todo.pop()
        if size <= leaf or len(rows) < least:
            continue
        at = len(out)
        p = np.sort(x[rows] @ _direction(node, at, x.shape[1]) + jitter[rows])
        low, high = p[int((0.5 - overlap) * (len(p) - 1))], p[math.ceil((0.5 + overlap) * (len(p) - 1))]
        out.append((low, high, -1, -1))
        if parent >= 0:
            a = out[parent]
            out[parent] = (*a[:3], at) if right else (*a[:2], at, a[3])
        p = x[rows] @ _direction(node, at, x.shape[1]) + jitter[rows]
        for side, go in ((False, p <= high), (True, p >= low)):
            todo.append((rows[go], size * go.mean(), at, side))
    return out


def _route(node: int, splits: np.ndarray, x: np.ndarray, jitter: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of x that reach it); a leaf is told by the split above it and the side."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        low, high, left, right = splits[at]
        p = x[rows] @ _direction(node, at, x.shape[1]) + jitter[rows]
        for side, child, go in ((0, int(left), p <= high), (1, int(right), p >= low)):
            if go.any():
                if child >= 0:
                    todo.append((child, rows[go]))
                else:
                    yield 2 * at + side, rows[go]


def _joined(near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first member, other members) of each component of a symmetric matrix of links."""
    n = len(near)
    left = near.sum(1) > near.diagonal()
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        inside, wave = np.zeros(n, bool), np.zeros(n, bool)
        wave[i] = True
        while wave.any():
            inside |= wave
            wave = near[wave].any(0) & ~inside
        left &= ~inside
        yield i, np.flatnonzero(inside)[np.flatnonzero(inside) != i]


@tidy
def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = 0.9, leaf: int = LEAF, sample: int = SAMPLE, overlap: float = OVERLAP, recall: float = RECALL, block: int = LEAF) -> DataFrame:
    """Link vectors whose cosine is ``similarity`` or more, in double precision; group them by what links reach.

    Returns a row for each input row: key, n_links (other vectors that it is linked with, by their keys), component_id
    (the smallest key that its links reach, itself included) and kept (whether it is that one). No link below the similarity is counted;
    links are found with the chance that ``recall`` asks for where the pair alone connects its ends, and all links between
    members of a component are counted.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows with a null key, which
    have a null component and are kept. Vectors of other lengths aren't compared. Equal vectors are one node with the
    smallest of their keys, so copies cost an aggregate; a row repeated as a whole counts once, and a key with two vectors
    is one node in what links reach. Other columns are not read; an empty table gives an empty result. Keys are longs.

    Each task holds one leaf or one pair of blocks. The sample of a node is about ``sample`` vectors; every vector is routed.
    """
    kind = "<f4" if "float" in vectors.schema[vector].dataType.simpleString() else "<f8"
    slim = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for v in b["v"]:
                x = None
                if v is not None and len(v):
                    v = np.array([np.nan if e is None else e for e in v] if getattr(v, "dtype", None) == object else v, "float64")
                    x = v if np.isfinite(v).all() and v.any() else None
                data.append(None if x is None else (x + 0.0).astype(kind).tobytes())
            yield pd.DataFrame({"k": b["k"].astype("Int64"), "dim": pd.array([None if d is None else len(d) // int(kind[2]) for d in data], "Int32"), "fp": pd.array([None if d is None else xxhash.xxh3_64_intdigest(d) - (1 << 63) for d in data], "Int64"), "data": data})

    packed = written(slim.mapInPandas(pack, "k long, dim int, fp long, data binary"), ROWS_AT_ONCE)
    nodes = packed.filter("k IS NOT NULL AND data IS NOT NULL").groupBy("fp", "data", "dim").agg(F.min("k").alias("rep"), F.count_distinct("k").alias("many"))
    nodes = written(nodes.select("rep", "fp", "dim", "many", "data"))  # fp beside data: data is compared where fp is equal

    # the roots: trees for each length
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row for each length of vectors
    plan = [(r["dim"], trees_needed(r["n"], similarity, leaf, overlap, recall)) for r in sizes]
    if not plan:
        return packed.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    trees = F.create_map(*[F.lit(x) for p in plan for x in p])
    slim = nodes.select("rep", "fp", "data", F.explode(F.sequence(F.lit(1), trees[F.col("dim")])).alias("tree"), "dim")
    slim = slim.select("rep", "fp", "data", F.xxhash64("dim", "tree").alias("node"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, "node"):
            node, x = int(g["node"].iat[0]), _matrix(g["data"], kind)
            splits = _split(node, x, _jitter(g["fp"].to_numpy()), float(g["n"].iat[0]), leaf, LEAST_SAMPLE, overlap)
            yield pd.DataFrame({"node": [node], "splits": [np.array(splits, "<f8").tobytes()]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, nodes = [], []
            for node, own in b.groupby("node").indices.items():
                g = b.iloc[own]
                splits = np.frombuffer(g["splits"].iat[0], "<f8").reshape(-1, 4)
                # a sample too small to split by: the node is tried again under another name, by another sample and other directions
                sides = _route(int(node), splits, _matrix(g["data"], kind), _jitter(g["fp"].to_numpy())) if len(splits) else [("again", np.arange(len(own)))]
                for side, rows in sides:
                    at.append(own[rows])
                    nodes.append(np.full(len(rows), xxhash.xxh3_64_intdigest(f"{node}/{side}") - (1 << 63)))
            if at:
                yield b[["rep", "fp", "data"]].iloc[np.concatenate(at)].assign(node=np.concatenate(nodes))

    leaves: list[DataFrame] = []
    todo = slim
    while True:
        many = written(todo.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > (2 * leaf if leaves else leaf)))
        if many.isEmpty():
            leaves.append(todo)
            break
        few = (lambda x: x) if leaves else F.broadcast  # the roots are one row for each tree and length of vectors; later nodes are many and none is hot
        leaves.append(todo.join(few(many), "node", "left_anti"))
        big = todo.join(few(many), "node")
        drawn = big.filter(F.pmod(F.xxhash64("fp", "node"), F.lit(1 << 30)) < F.col("n") ** -1 * (sample * float(1 << 30)))
        splits = written(drawn.repartition("node").sortWithinPartitions("node").mapInPandas(fit, "node long, splits binary"), ROWS_AT_ONCE)
        routed = big.drop("n").join(few(splits), "node").select("rep", "fp", "data", "node", "splits")
        todo = written(routed.mapInPandas(route, "rep long, fp long, data binary, node long"), ROWS_AT_ONCE)
    placed = leaves[0]
    for more in leaves[1:]:
        placed = placed.unionByName(more)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links that span each component of a leaf."""
        for g in runs(batches, "node"):
            rep, x = g["rep"].to_numpy(), _matrix(g["data"], kind)
            for i, others in _joined(x @ x.T >= similarity):
                yield pd.DataFrame({"a": np.minimum(rep[i], rep[others]), "b": np.maximum(rep[i], rep[others])})

    links = placed.select("node", "rep", "data").repartition("node").sortWithinPartitions("node").mapInPandas(compare, "a long, b long")
    links = written(links.distinct(), ROWS_AT_ONCE)
    found = connected_components(links)
    members = written(nodes.join(found.withColumnRenamed("node", "rep"), "rep").select("rep", "fp", "many", "data", "dim", "component"))
    counts = _count_links(members, kind, similarity, block)
    judged = nodes.join(counts, ["rep", "fp"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    judged = judged.select("fp", "data", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("comp"))
    out = packed.join(judged, (packed["fp"] == judged["fp"]) & (packed["data"] == judged["data"]), "left").select("k", "n_links", "comp")
    component = F.when(F.col("k").isNotNull(), F.coalesce("comp", "k"))
    links = F.when(F.col("k").isNotNull(), F.col("n_links"))
    return out.select(F.col("k").alias(key), F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))


def _count_links(members: DataFrame, kind: str, similarity: float, block: int) -> DataFrame:
    """rep, fp, links: for each member of a component the others of it that it is linked with (copies counted each).

    Members are ordered by their angle to their component's mean direction and cut into blocks. Two blocks whose
    largest angles add up to less than the link's angle are linked throughout, blocks whose angles are further apart than that
    not at all; both are told from counts. Only what is left is compared, a pair of blocks in a task.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (c, d), g in b.groupby(["component", "dim"]):
                yield pd.DataFrame({"component": [c], "dim": [d], "sum": [_matrix(g["data"], kind).sum(0).tolist()]})

    # one row for each component and batch of rows; adding them up goes by place
    mean = members.select("component", "dim", "data").mapInPandas(sums, "component long, dim int, sum array<double>").select("component", "dim", F.posexplode("sum").alias("i", "x"))
    mean = mean.groupBy("component", "dim", "i").agg(F.sum("x").alias("x")).groupBy("component", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    mean = written(mean)  # so that the rows of a hot component can be split where they meet it

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = []
                for _, g in b.groupby("dim"):
                    x, m = _matrix(g["data"], kind), np.stack(g["mean"].to_list()).astype("float64")
                    size = np.sqrt((m * m).sum(1, keepdims=True))
                    m = np.where(size > 0, m / np.where(size > 0, size, 1), np.eye(1, m.shape[1]))
                    out.append(g[["component", "dim", "rep", "fp", "many", "data"]].assign(angle=np.arccos(np.clip((x * m).sum(1), -1, 1))))
                yield pd.concat(out)

    turned = written(members.join(mean, ["component", "dim"]).mapInPandas(angles, "component long, dim int, rep long, fp long, many long, data binary, angle double"), ROWS_AT_ONCE)
    # blocks of about the wanted size: steps of the angle from a histogram, cut on by a hash where a step is too full
    step = F.floor(F.col("angle") * 1024)
    bins = turned.withColumn("step", step).groupBy("component", "dim", "step").agg(F.count("*").alias("n"), F.sum("many").alias("all"))
    bins = written(bins.withColumn("parts", F.ceil(F.col("n") / block).cast("long")))
    whole = written(bins.groupBy("component", "dim").agg(F.sum("n").alias("n"), F.max("step").alias("far")))
    reach = math.acos(similarity)
    near_by = F.col("n") <= block  # a small component is one block
    blocks = turned.withColumn("step", step).join(bins.select("component", "dim", "step", "parts"), ["component", "dim", "step"]).join(whole, ["component", "dim"])
    blocks = blocks.withColumn("step", F.when(near_by, F.lit(-1)).otherwise(F.col("step"))).withColumn("part", F.when(near_by, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts"))))
    small = blocks.filter("step = -1").select("component", "dim", "rep", "fp", "many", "data").withColumn("g", F.xxhash64("component", "dim"))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, "g"):
            x, many = _matrix(g["data"], kind), g["many"].to_numpy()
            near = x @ x.T >= similarity
            np.fill_diagonal(near, False)
            yield pd.DataFrame({"rep": g["rep"], "fp": g["fp"], "links": near @ many})

    counted = small.repartition("g").sortWithinPartitions("g").mapInPandas(within, "rep long, fp long, links long")

    # large components: (step, step) is certain, compared or apart
    left, right = bins.join(whole.filter(~near_by).select("component", "dim"), ["component", "dim"]), F.lit(1.0 / 1024)
    a = left.select("component", "dim", F.col("step").alias("s"), F.col("parts").alias("ps"))
    b = left.select("component", "dim", F.col("step").alias("t"), F.col("parts").alias("pt"), "all")
    both = written(a.join(b, ["component", "dim"]))  # steps of a component: 3217 at most, by 3217
    low, high = (F.abs(F.col("s") - F.col("t")) - 1) * right, (F.col("s") + F.col("t") + 2) * right
    certain = both.filter(high < reach - SLACK).groupBy("component", "dim", F.col("s").alias("step")).agg(F.sum("all").alias("sure"))
    itself = F.when((2 * F.col("step") + 2) * right < reach - SLACK, F.col("many")).otherwise(0)  # where its own step is among the certain ones
    sure = blocks.filter("step >= 0").join(certain, ["component", "dim", "step"]).select("rep", "fp", (F.col("sure") - itself).alias("links"))
    open_ = both.filter((high >= reach - SLACK) & (low <= reach + SLACK))
    big = blocks.filter("step >= 0").select("component", "dim", "step", "part", "rep", "fp", "many", "data")
    # block (s, part) asks block (t, part of t): both travel under the pair's key
    pairs = open_.select("component", "dim", "s", "t", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), "pt").select("component", "dim", "s", "t", "p", F.explode(F.sequence(F.lit(0), F.col("pt") - 1)).alias("q"))
    pairs = pairs.withColumn("g", F.xxhash64("component", "dim", "s", "p", "t", "q"))
    asks = big.join(pairs.select("component", "dim", F.col("s").alias("step"), F.col("p").alias("part"), "g"), ["component", "dim", "step", "part"]).withColumn("asks", F.lit(True))
    told = big.join(pairs.select("component", "dim", F.col("t").alias("step"), F.col("q").alias("part"), "g"), ["component", "dim", "step", "part"]).withColumn("asks", F.lit(False))
    columns = ["g", "asks", "rep", "fp", "many", "data"]

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, "g"):
            asks = g["asks"].to_numpy()
            x, y = g[asks], g[~asks]
            near = _matrix(x["data"], kind) @ _matrix(y["data"], kind).T >= similarity
            near &= ~((x["rep"].to_numpy()[:, None] == y["rep"].to_numpy()[None, :]) & (x["fp"].to_numpy()[:, None] == y["fp"].to_numpy()[None, :]))
            yield pd.DataFrame({"rep": x["rep"], "fp": x["fp"], "links": near @ y["many"].to_numpy()})

    dealt = asks.select(*columns).unionByName(told.select(*columns)).repartition("g").sortWithinPartitions("g")
    counted = counted.unionByName(sure).unionByName(dealt.mapInPandas(across, "rep long, fp long, links long"))
    out = written(counted.groupBy("rep", "fp").agg(F.sum("links").alias("links")), ROWS_AT_ONCE)
    drop_written(turned, mean, bins, whole, both)
    return out
