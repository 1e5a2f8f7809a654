"""SimHash near-deduplication by the generalised pigeonhole principle.

Fingerprints of 64 bits link at MAX_DISTANCE or fewer differing bits. Bits are dealt into
partitions, correlated bits together; partition i gets a threshold t_i (-1: unused) so that the
t_i + 1 sum to MAX_DISTANCE + 1: two fingerprints within MAX_DISTANCE are then within t_i in some
partition, so nothing is missed. Partitions and thresholds come from a dynamic program over the
estimated cost of signatures and candidates at the real number of fingerprints (pair distances are
estimated on SAMPLE fingerprints; they affect cost, never the result). Every distinct fingerprint
is indexed by its bits in each partition and probes the larger keys within t_i of its own; what
meets is verified on all 64 bits.

A task keeps the links that join two of its sets and drops the others, so a dense group of n
fingerprints yields about n links, not their square, and candidates are compared, never emitted. A
key with more than HOT indexed fingerprints is divided again by the same principle, DIVISIONS times at
most: the bits that it has not fixed yet are dealt into MAX_DISTANCE + 1 parts, of which two near
fingerprints agree on one at least, and its rows go to the keys of these parts. What is crowded even
then holds mostly near fingerprints; it is dealt into blocks of HOT over several tasks, each of which
sees all of its rows. Equal fingerprints are one node whatever their number.

Defined cases: a null or empty text has no words and fingerprint zero, which links like any other;
repeated rows share a fingerprint; null doc_ids take part but are never a component_id unless the
component has no other; very long texts are read whole; other columns are ignored, and pass through
drop_near_copies() whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, keep_rows, materialize, table, tidied
from .components import connected_components

SHINGLE, SEED, MAX_DISTANCE, BITS = 4, 42, 4, 64
SAMPLE, HOT, DIVISIONS, PAIRS = 2048, 4096, 2, 1 << 20
#: Seconds that a signature row and a candidate take, by order of magnitude.
SIGNATURE_S, CANDIDATE_S = 1.5e-6, 2e-8


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = len(words) - shingle + 1
    sums = np.zeros(BITS, dtype=np.int64)
    a, b = starts[:last].tolist(), ends[shingle - 1 :].tolist()
    for k in range(0, last, 1 << 14):
        own = np.array([h(joined[i:j], seed) for i, j in zip(a[k : k + (1 << 14)], b[k : k + (1 << 14)])], dtype="<u8")
        sums += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, fp (the 64 bits as a long)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x.as_py() or "", shingle, seed) for x in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    return bounded(rows).mapInArrow(tidied(run), "doc_id long, row_key long, fp long")


# -- the plan: partitions and thresholds


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each starts with a free bit and takes the free bits that are
    most correlated with its own. bits: sample x BITS of 0 and 1."""
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1
    corr = np.abs((x / norm).T @ (x / norm))
    free, groups = list(range(BITS)), []
    for k in range(m):
        want = len(free) // (m - k)
        own = [free.pop(0)]
        while len(own) < want:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        groups.append(sorted(own))
    return groups


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Least total of costs[i][u_i] with the u_i summing to units (u_i = threshold + 1)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for u in range(min(units - used, len(own) - 1) + 1):
                if used + u not in nxt or c + own[u] < nxt[used + u][0]:
                    nxt[used + u] = (c + own[u], [*chosen, u])
        best = nxt
    return best[units]


def plan(sample: np.ndarray, n: int, distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use, for n fingerprints of which sample (uint64) is one."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    found = None
    for m in range(1, distance + 2):
        groups = group_bits(bits, m) if len(sample) else [list(range(k, BITS, m)) for k in range(m)]
        costs = []
        for own in groups:
            mask = np.uint64(sum(1 << b for b in own))
            x = np.bitwise_count((sample[:, None] & mask) ^ (sample[None, :] & mask)) if len(sample) else np.zeros((0, 0), dtype=np.uint8)
            pairs = max(1, len(sample) * (len(sample) - 1))
            row = [0.0]
            for t in range(distance + 1):
                share = max((int((x <= t).sum()) - len(sample)) / pairs, sum(comb(len(own), j) for j in range(t + 1)) / 2.0 ** len(own))
                row.append(n * sum(comb(len(own), j) for j in range(t + 1)) * SIGNATURE_S + n * n / 2 * share * CANDIDATE_S)
            costs.append(row)
        total, units = allocate(costs, distance + 1)
        if found is None or total < found[0]:
            found = (total, [(own, u - 1) for own, u in zip(groups, units) if u])
    return found[1]


# -- probing


def _signature(part: int, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part + 1) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def signatures(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """fp -> (sig, probe, fp, free): one indexed row (probe false) for each partition, and a probing
    row for every larger key within the partition's threshold. Signatures are hashes of partition and
    key; a clash only adds candidates. free: the bits beside the partition."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for k, (own, t) in enumerate(parts):
                mask = sum(1 << x for x in own)
                key = fp & np.uint64(mask)
                yield _rows(_signature(k, key), fp, False, ~mask & (1 << BITS) - 1)
                for j in range(1, t + 1):
                    for flips in combinations(own, j):
                        other = key ^ np.uint64(sum(1 << x for x in flips))
                        up = other > key
                        if up.any():
                            yield _rows(_signature(k, other[up]), fp[up], True, ~mask & (1 << BITS) - 1)

    return distinct.select("fp").mapInArrow(run, "sig long, probe boolean, fp long, free long")


def divided(rows: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """rows(sig, probe, fp, free) -> the same rows under the keys of distance + 1 parts of their free bits."""

    def run(batches):
        for b in batches:
            sig, probe, fp, free = (b.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "probe", "fp", "free"))
            sig, fp, free = sig.view(np.uint64), fp.view(np.uint64), free.view(np.uint64)
            for mask in np.unique(free):
                own, bits = free == mask, [x for x in range(BITS) if int(mask) >> x & 1]
                for k in range(distance + 1):
                    part = sum(1 << x for x in bits[k :: distance + 1])
                    for p in (False, True):
                        use = own & (probe == p)
                        if use.any():
                            with np.errstate(over="ignore"):
                                yield _rows(_signature(k, (fp[use] & np.uint64(part)) ^ sig[use] * np.uint64(0xFF51AFD7ED558CCD)), fp[use], p, int(mask) & ~part)

    return rows.select("sig", "probe", "fp", "free").mapInArrow(run, "sig long, probe boolean, fp long, free long")


def _rows(sig: np.ndarray, fp: np.ndarray, probe: bool, free: int) -> pa.RecordBatch:
    bits = np.full(len(sig), free, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.full(len(sig), probe)), pa.array(fp.view(np.int64)), pa.array(bits)], ["sig", "probe", "fp", "free"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links (a, b) connect."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        nxt = label.copy()
        np.minimum.at(nxt, label[i], low)
        np.minimum.at(nxt, label[j], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


class Sets:
    """Union-find over what a task has linked; join() keeps the links that join two sets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out.append((x, y))
        return out


def verify(rows: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """rows(sig, probe, fp), partitioned and sorted by sig, probe -> links (a, b) that connect all
    fingerprints within distance that share a sig, one of them indexed there."""

    def run(batches):
        sets = Sets()
        held = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64))
        for b in batches:
            new = (b.column("sig").to_numpy(), b.column("probe").to_numpy(zero_copy_only=False), b.column("fp").to_numpy().view(np.uint64))
            old = len(held[0])
            sig, probe, fp = (np.concatenate(x) for x in zip(held, new))
            n = len(sig)
            if n == 0:
                continue
            begins = np.concatenate([[True], sig[1:] != sig[:-1]])
            group = np.cumsum(begins) - 1
            start = np.flatnonzero(begins)
            indexed = np.bincount(group, weights=~probe).astype(np.int64)
            partners = np.minimum(np.arange(n) - start[group], indexed[group])
            partners[:old] = 0  # compared already
            first = start[group]
            total = np.cumsum(partners)
            at = 0
            while at < n:
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
                own = np.arange(at, upto)
                count = partners[at:upto]
                right = np.repeat(own, count)
                left = np.arange(len(right)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at:upto], count)
                near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
                a, c = fp[left[near]], fp[right[near]]
                if len(a):
                    links = sets.join(*forest(a, c))
                    if links:
                        x = np.array(links, dtype=np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy().view(np.int64)), pa.array(x[:, 1].copy().view(np.int64))], ["a", "b"])
                at = upto
            keep = (group == group[-1]) & ~probe  # the last group may go on
            held = (sig[keep], probe[keep], fp[keep])

    return rows.select("sig", "probe", "fp").mapInArrow(run, "a long, b long")


def link(distinct: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT) -> DataFrame:
    """Links (a, b) with the components of all distinct fingerprints (fp) within distance."""
    n = distinct.count()
    sample = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    rows, parts = materialize(signatures(distinct, plan(sample, n, distance)), "simhash-signatures"), []
    for level in range(DIVISIONS + 1):
        crowded = rows.where(~F.col("probe")).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > hot)
        crowded = materialize(crowded.select("sig", F.ceil(F.col("n") / hot).cast("long").alias("blocks")), "simhash-crowded")
        if crowded.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(crowded, "sig", "left_anti"))
        if level < DIVISIONS:
            rows = materialize(divided(rows.join(crowded, "sig", "left_semi"), distance), "simhash-signatures")
        else:
            dealt = rows.join(crowded, "sig").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            parts.append(dealt.select(F.xxhash64("sig", "block").alias("sig"), (F.col("probe") | (F.col("own") != F.col("block"))).alias("probe"), "fp"))
    even = parts[0].select("sig", "probe", "fp")
    for x in parts[1:]:
        even = even.unionByName(x.select("sig", "probe", "fp"))
    return verify(even.repartition("sig").sortWithinPartitions("sig", "probe"), distance)


def classify(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, row_key, fp, component_id."""
    rows = materialize(fingerprints(docs), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(link(distinct, distance))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of = materialize(of, "simhash-roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "row_key", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest doc_id stays."""
    decided = materialize(classify(docs), "simhash-decided")
    of = decided.groupBy("doc_id", "row_key").agg(F.any_value("component_id").alias("component_id"), F.count("*").alias("m"))
    top = of.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("row_key").alias("top_key"))
    top = top.select(F.col("component_id").alias("c"), "top_key")
    is_top = F.col("top_key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("top_key"))
    stay = of.join(top, F.col("component_id").eqNullSafe(F.col("c")), "left").select("doc_id", "row_key", "m", F.when(is_top, 1).otherwise(0).alias("stay"))
    return keep_rows(docs, materialize(stay.where("stay < m").select("doc_id", "row_key", "stay"), "simhash-gone"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns: as the
    module says."""
    got = classify(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
