"""Embedding near-deduplication by an epsilon grid order join.

Cosine >= THRESHOLD between unit vectors is a distance of at most eps = sqrt(2 - 2 * THRESHOLD).
Unit vectors are projected on leading principal directions (orthonormal, so projecting never
increases a distance; they are fitted on SAMPLE vectors, which affects speed, never the result),
laid on a grid of width eps and sorted by label and cell on the first ORDER of them, in epsilon grid
order, across the cluster. The sorted sequence is cut into intervals of at most INTERVAL vectors with
their bounds in the projection; the vectors go to files in the shared folder, FILE intervals in each.

The join is recursive over the sequence: FAN consecutive intervals of a label make a run, FAN runs a
larger run, up to one for the whole label. From the pair of that run with itself, pairs are replaced by
the pairs of their parts, and those whose bounds are over eps apart are dropped with all that is in
them, level by level, until pairs of intervals are left. A pair of intervals is joined recursively in
the same way by halves; leaves are compared in double precision on the whole vectors, which workers
map from the files, so no vector is shuffled for the join.

Equal vectors of a label are one node with a weight; a node is known outside by two 64-bit hashes of its
vector (a clash among n vectors has a chance of about n^2 / 2^129). A pair of intervals returns a count for
each node and the links that connect its nodes, never the pairs.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite components, and null
labels, link with nothing and are their own component; vectors of different lengths never link;
repeated rows are vectors of their own with n_links between them; null vec_ids take part, but are never a
component_id unless the component has no other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Opened, bounded, discard, fresh_path, map_shared, materialize, table, write_shared
from .components import connected_components
from .simhash_dedup import Sets, forest

THRESHOLD, DIMENSIONS, ORDER, INTERVAL, LEAF, SAMPLE = 0.98, 16, 6, 1024, 128, 2000
#: Intervals in a file, parts of a run, and files that a task maps at a time.
FILE, FAN, OPEN_FILES = 32, 16, 64


def basis(sample: list[list[float]], size: int, k: int = DIMENSIONS) -> np.ndarray:
    """size x k orthonormal directions: the principal ones of the sample's vectors of that size."""
    own = np.array([v for v in sample if len(v) == size], dtype=np.float64).reshape(-1, size)
    if len(own) < 2:
        return np.eye(size)[:, :k]
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    _, _, vt = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)
    return vt[: min(k, size)].T


def _apart(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return float(np.sqrt((gap * gap).sum()))


class Joiner:
    """Joins two intervals; what it finds is in counts and links."""

    def __init__(self, a, b, wa, wb, directions, threshold, same):
        self.same, self.threshold = same, threshold
        self.eps = np.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-12
        self.a, self.b = a.astype(np.float64), b.astype(np.float64)
        self.na, self.nb = np.sqrt((self.a * self.a).sum(axis=1)), np.sqrt((self.b * self.b).sum(axis=1))
        self.pa, self.pb = (self.a / self.na[:, None]) @ directions, (self.b / self.nb[:, None]) @ directions
        self.wa, self.wb = wa, wb
        self.ca, self.cb = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0

    def run(self, i: int, j: int, k: int, m: int) -> None:
        """Rows i to j of a with rows k to m of b."""
        if i == j or k == m or self.same and k + 1 > m or self.same and m <= i:
            return
        p, q = self.pa[i:j], self.pb[k:m]
        if _apart(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)) > self.eps:
            return
        if j - i > LEAF or m - k > LEAF:
            if j - i >= m - k:
                h = (i + j) // 2
                self.run(i, h, k, m)
                self.run(h, j, k, m)
            else:
                h = (k + m) // 2
                self.run(i, j, k, h)
                self.run(i, j, h, m)
            return
        self.compared += (j - i) * (m - k)
        cos = (self.a[i:j] @ self.b[k:m].T) / (self.na[i:j, None] * self.nb[None, k:m])
        x, y = np.nonzero(cos >= self.threshold)
        x, y = x + i, y + k
        if self.same:
            up = x < y
            x, y = x[up], y[up]
        if len(x):
            np.add.at(self.ca, x, self.wb[y])
            np.add.at(self.cb, y, self.wa[x])
            self.links.append((x, y))


def intervals(nodes: DataFrame, directions: dict[int, np.ndarray], threshold: float, root: str) -> DataFrame:
    """nodes(label, size, embedding, weight, first, h1, h2) -> intervals in epsilon grid order: part,
    nth (place in the sequence), label, size, lo, hi (bounds of the projection), n, and the nodes' weight,
    first, h1, h2; their vectors and weights are in the file root/part-(nth / FILE)."""
    eps = float(np.sqrt(2 - 2 * threshold))

    def projected(v: np.ndarray) -> np.ndarray:
        u = v.astype(np.float64)
        return (u / np.sqrt((u * u).sum(axis=1, keepdims=True))) @ directions.get(v.shape[1], np.eye(v.shape[1])[:, :DIMENSIONS])

    def cells(batches):
        for b in batches:
            sizes, data = b.column("size").to_numpy(), b.column("embedding")
            cell = np.zeros((len(sizes), ORDER), dtype=np.int32)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = np.floor(projected(data.take(pa.array(own)).flatten().to_numpy().reshape(-1, size))[:, :ORDER] / eps)
                cell[own, : x.shape[1]] = x
            yield b.append_column("cell", pa.FixedSizeListArray.from_arrays(pa.array(cell.ravel()), ORDER).cast(pa.list_(pa.int32())))

    def cut(batches):
        part, count, held, of, file = TaskContext.get().partitionId(), 0, [], None, []

        def block():
            nonlocal count
            v = np.array([x[0] for x in held], dtype=np.float32)
            w, first, h1, h2 = ([x[k] for x in held] for k in (1, 2, 3, 4))
            p = projected(v)
            file.extend([v.tobytes(), np.array(w, dtype="<i8").tobytes()])
            row = {"part": part, "nth": count, "label": of[0], "size": of[1], "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist(), "n": len(held), "offset": sum(map(len, file[:-2])), "weight": w, "first": first, "h1": h1, "h2": h2}
            count += 1
            if count % FILE == 0:
                save(count // FILE - 1)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        def save(number: int) -> None:
            write_shared(f"{root}/{part}-{number}", *file)
            file.clear()

        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        schema = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("lo", doubles), ("hi", doubles), ("n", pa.int32()), ("offset", pa.int64()), ("weight", longs), ("first", longs), ("h1", longs), ("h2", longs)])
        for b in batches:
            for label, size, *node in zip(*(b.column(c).to_pylist() for c in ("label", "size", "embedding", "weight", "first", "h1", "h2"))):
                if held and ((label, size) != of or len(held) == INTERVAL):
                    yield block()
                    held = []
                of = (label, size)
                held.append(node)
        if held:
            yield block()
        if file:
            save((count - 1) // FILE)

    names = ["label", "size", "embedding", "weight", "first", "h1", "h2"]
    kinds = "label long, size int, embedding array<float>, weight long, first long, h1 long, h2 long"
    x = bounded(nodes.select(*names)).mapInArrow(cells, kinds + ", cell array<int>")
    order = ["label", "size", *[F.col("cell")[k] for k in range(ORDER)]]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order, "h1", "h2")
    return x.mapInArrow(cut, "part int, nth long, label long, size int, lo array<double>, hi array<double>, n int, offset long, weight array<long>, first array<long>, h1 array<long>, h2 array<long>")


def numbered(blocks: DataFrame) -> DataFrame:
    """Adds block: the place of an interval in the whole sequence."""
    own = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.count("*").alias("k"))  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("k").over(own), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(parts), "part").withColumn("block", F.col("before") + F.col("nth"))


def _near(a: str, b: str, eps: float) -> Column:
    gaps = F.zip_with(F.zip_with(f"lo_{a}", f"hi_{b}", lambda x, y: x - y), F.zip_with(f"lo_{b}", f"hi_{a}", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x) <= eps * eps * (1 + 1e-8) + 1e-15


def pairs_of(blocks: DataFrame, eps: float, fan: int = FAN) -> DataFrame:
    """blocks(block, label, size, lo, hi) -> (a, b), a <= b: intervals of one label whose bounds are within
    eps, by recursion over the runs of the sequence. A pair is replaced by fan^2 pairs at most."""
    levels = [blocks.select("label", "size", F.col("block").alias("id"), "lo", "hi")]
    most = blocks.agg(F.max("block")).first()[0]
    while most is not None and most >= fan ** (len(levels) - 1):
        bounds = lambda c, f: F.transform(F.sequence(F.lit(0), F.size(F.first(c)) - 1), lambda i: f(F.collect_list(c), i))
        low = lambda c, i: F.array_min(F.transform(c, lambda x: x[i]))
        high = lambda c, i: F.array_max(F.transform(c, lambda x: x[i]))
        up = levels[-1].groupBy("label", "size", F.floor(F.col("id") / fan).alias("id")).agg(bounds("lo", low).alias("lo"), bounds("hi", high).alias("hi"))  # fan rows at most
        levels.append(materialize(up, "ego-runs"))
    pairs = levels[-1].select("label", "size", F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        parts = level.withColumn("up", F.floor(F.col("id") / fan))
        side = lambda c: parts.select("label", "size", F.col("up").alias(c), F.col("id").alias(f"id_{c}"), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"))
        both = pairs.join(side("a"), ["label", "size", "a"]).join(side("b"), ["label", "size", "b"])
        both = both.where((F.col("id_a") <= F.col("id_b")) & _near("a", "b", eps))
        pairs = materialize(both.select("label", "size", F.col("id_a").alias("a"), F.col("id_b").alias("b")), "ego-pairs")
    return pairs.select("a", "b")


def classify(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, a row for each."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad, F.lit(False))
    rows = rows.select("vec_id", "label", ok.alias("ok"), F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2"), "embedding")
    known = rows.where("ok").groupBy("label", "h1", "h2", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    nodes = materialize(known.withColumn("size", F.size("embedding")), "ego-nodes")
    sample = [r["embedding"] for r in nodes.orderBy("h1", "label").limit(SAMPLE).select("embedding").collect()]
    directions = {n: basis(sample, n) for n in {len(v) for v in sample}}
    root = fresh_path(spark, "ego-vectors")
    cuts = materialize(intervals(nodes, directions, threshold, root), "ego-cuts")
    blocks = materialize(numbered(cuts), "ego-intervals")
    discard(nodes, cuts)
    pairs = pairs_of(blocks, float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9))
    side = lambda c: blocks.select(F.col("block").alias(c), F.concat("part", F.lit("-"), F.floor(F.col("nth") / FILE)).alias(f"file_{c}"), F.col("offset").alias(f"at_{c}"), F.col("n").alias(f"n_{c}"), *([F.col("size")] if c == "a" else []))
    work = pairs.join(side("a"), "a").join(side("b"), "b").repartitionByRange("a", "b").sortWithinPartitions("a", "b")

    def join(batches):
        files = Opened(root, map_shared, OPEN_FILES)

        def part(r: dict, c: str) -> tuple[np.ndarray, np.ndarray]:
            raw, n = files(r[f"file_{c}"]), r[f"n_{c}"]
            at, upto = r[f"at_{c}"], r[f"at_{c}"] + 4 * n * r["size"]
            return raw[at:upto].view("<f4").reshape(n, r["size"]), raw[upto : upto + 8 * n].view("<i8")

        for t in batches:
            nodes_, others, counts = [], [], []
            for r in t.to_pylist():
                (va, wa), (vb, wb) = part(r, "a"), part(r, "b")
                d = directions.get(r["size"])
                j = Joiner(va, vb, wa, wb, np.eye(r["size"])[:, :DIMENSIONS] if d is None else d, threshold, r["a"] == r["b"])
                j.run(0, len(va), 0, len(vb))
                for block, c in ((r["a"], j.ca), (r["b"], j.cb)):
                    own = np.flatnonzero(c)
                    nodes_.append(block * INTERVAL + own)
                    others.append(np.full(len(own), -1))
                    counts.append(c[own])
                if j.links:
                    x, y = (np.concatenate(z) for z in zip(*j.links))
                    links = np.array(Sets().join(*forest(r["a"] * INTERVAL + x, r["b"] * INTERVAL + y)), dtype=np.int64)
                    nodes_.append(links[:, 0])
                    others.append(links[:, 1])
                    counts.append(np.zeros(len(links), dtype=np.int64))
            if nodes_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (nodes_, others, counts)], ["node", "other", "n"])

    found = materialize(work.mapInArrow(join, "node long, other long, n long"), "ego-found")
    counts = found.where("other < 0").groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = blocks.select("block", "label", F.posexplode(F.arrays_zip("weight", "first", "h1", "h2")).alias("i", "x")).select((F.col("block") * INTERVAL + F.col("i")).alias("node"), "label", "x.*")
    known = placed.join(counts, "node", "left").join(roots, "node", "left")
    known = materialize(known.select("label", "h1", "h2", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "ego-known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    of = known.join(least, "root").select(F.col("label").alias("l"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "n_links", "component_id")
    out = rows.select("vec_id", "label", "ok", "h1", "h2").join(of, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns: as the
    module says."""
    return classify(table(spark, sf_dir, "embeddings"))
