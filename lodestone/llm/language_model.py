"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting: words are hashed with XXH64 (a clash among n words has a chance of about n^2 / 2^65) and
counted; the sorted hashes, cut into word shards, give every word an id of up to 40 bits, its rank.
Bigrams of a word shard are keyed by the first word's place in it and the second word's id, and sent
to shards that are ranges of these keys: ranges are cut from the word counts so that each holds
about SHARD_TOKENS tokens, and a context of more tokens than that is dealt over several ranges by the
second word. Senders combine repeated bigrams first and send packed arrays. A shard is written once,
as one file of sorted arrays in the shared folder: bigrams, counts and the statistics of each
context; continuation counts, the ranges, and the statistics of contexts in several ranges go to
files by word shard. Counts are kept as wide as the largest of a file needs, up to 64 bits. The
driver holds one number for each word shard.

Scoring: workers map the files into memory (nothing is loaded) and look up the distinct bigrams of a
block of documents by binary search. Files in a store that can't be mapped are copied to the worker
and unlinked when mapped. What is read follows the corpus: all words and bigrams of all training
documents are kept.

p(w|u) = (c(uw) - D(c(uw))) / c(u) + g(u) p(w);  p(w) = (n(w) - D'(n(w))) / n + g' / (V + 1)
with n(w) the number of distinct words before w and discounts D from counts of counts. A text is
scored from a begin mark through its end token; an unknown word has the share g' / (V + 1), and
after an unknown word the unigram part alone is used.

Defined cases: a null or empty text is its end token alone; with no training document every token
has probability 1 / (V + 1) = 1; repeated rows count as often as they occur; very long texts are
scored whole; null doc_ids are scored and stay null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Opened, bounded, discard, fold_of, fresh_path, materialize, pack, table, tidied, unpack, write_shared

SHARD_WORDS, SHARD_TOKENS, FLUSH_WORDS, FLUSH_PAIRS = 1 << 20, 1 << 20, 250_000, 2_000_000
BLOCK_CHARS, CACHE_WORDS, OPEN_FILES = 4_000_000, 300_000, 64


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers (not negative) in as few bytes as they need."""
    most = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max))


#: Bits of a second word's id in a bigram's key; the first word's place in its shard has the rest.
ID_BITS = 40


@dataclass
class Meta:
    """What workers know of a model; its size follows the number of word shards."""

    root: str
    bits: int  # of a word's hash that name its shard
    starts: np.ndarray  # first id of each word shard, and the number of words
    documents: int
    tokens: int  # with end tokens
    words: int  # distinct, with the end token
    d2: list = field(default_factory=lambda: [0.0] * 4)
    d1: list = field(default_factory=lambda: [0.0] * 4)
    bigrams: int = 0
    gamma: float = 1.0

    @property
    def end(self) -> int:
        return int(self.starts[-1])

    @property
    def begin(self) -> int:
        return self.end + 1

    @property
    def unknown(self) -> int:
        return self.end + 2

    def shards(self, first: np.ndarray):
        """(shard, i, j) of the runs of first words, which ascend through the words' ids; those of
        the begin mark come last, as a shard of their own, and unknown words are in none."""
        tail = int(np.searchsorted(first == self.begin, True))
        known = int(np.searchsorted(first[:tail], self.end))
        cuts = [0, *np.searchsorted(first[:known], self.starts[1:-1]).tolist(), known]
        yield from ((s, i, j) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j)
        if tail < len(first):
            yield len(self.starts) - 1, tail, len(first)

    def keys(self, shard: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        low = self.begin if shard == len(self.starts) - 1 else int(self.starts[shard])
        return (first - low).astype(np.uint64) << np.uint64(ID_BITS) | second.astype(np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def blocks(texts):
    """Consecutive texts, as word lists, of about BLOCK_CHARS characters in all."""
    held, size = [], 0
    for t in texts:
        t = t.as_py()
        held.append(words_of(t))
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


class Ids:
    """Ids of words by the mapped vocabulary; unknown words get meta.unknown."""

    def __init__(self, meta: Meta):
        self.meta, self.files, self.cache = meta, Opened(meta.root, unpack, OPEN_FILES), {}

    def learn(self, words: set[bytes]) -> None:
        import xxhash

        if len(self.cache) > CACHE_WORDS:
            self.cache = {w: i for w, i in self.cache.items() if w in words}
        new = list(words.difference(self.cache))
        if not new:
            return
        h = np.fromiter(map(xxhash.xxh64_intdigest, new), dtype=np.uint64, count=len(new))
        order = np.argsort(h)
        ids = np.full(len(new), self.meta.unknown, dtype=np.int64)
        cuts = np.searchsorted(h[order], np.arange(1, 1 << self.meta.bits, dtype=np.uint64) << np.uint64(64 - self.meta.bits)) if self.meta.bits else np.zeros(0, int)
        bounds = [0, *cuts.tolist(), len(new)]
        for s, (i, j) in enumerate(zip(bounds, bounds[1:])):
            if i < j and self.meta.starts[s] < self.meta.starts[s + 1]:
                keys = self.files(f"words-{s}")[0]
                own = h[order[i:j]]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                ids[order[i:j][hit]] = self.meta.starts[s] + at[hit]
        self.cache.update(zip(new, ids.tolist()))

    def __call__(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of the documents, each with its end token, and their numbers."""
        self.learn(set().union(*docs))
        get = self.cache.__getitem__
        sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs)) + 1
        out = np.full(int(sizes.sum()), self.meta.end, dtype=np.int64)
        inner = np.ones(len(out), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = np.fromiter((get(w) for d in docs for w in d), dtype=np.int64, count=int(inner.sum()))
        return out, sizes


def bigrams(ids: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a block, which of them each token is, the distinct bigrams (first and second
    word's ids; by first word, those of the begin mark last) and which of them each token ends."""
    word, inverse = np.unique(ids, return_inverse=True)
    before = np.empty(len(ids), dtype=np.uint64)
    before[1:] = inverse[:-1]
    before[np.cumsum(sizes) - sizes] = len(word)
    pair, which = np.unique(before << np.uint64(32) | inverse.astype(np.uint64), return_inverse=True)
    return word, inverse, np.append(word, begin)[(pair >> np.uint64(32)).astype(np.int64)], word[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)], which


# -- counting


def count_words(docs: DataFrame) -> DataFrame:
    """h, n: hashes of the words of docs(text) and their counts."""

    def run(batches):
        import xxhash

        held: Counter = Counter()

        def out():
            h = np.fromiter(map(xxhash.xxh64_intdigest, held), dtype=np.uint64, count=len(held))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.fromiter(held.values(), dtype=np.int64, count=len(held)))], ["h", "n"])

        for b in batches:
            for t in b.column("text"):
                held.update(words_of(t.as_py()))
                if len(held) > FLUSH_WORDS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return bounded(docs.select("text")).mapInArrow(tidied(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def write_words(counts: DataFrame, root: str, documents: int) -> Meta:
    """Writes the sorted hashes of each shard with their counts, and cuts the bigram ranges."""
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bits = max(0, (total["v"] // SHARD_WORDS).bit_length())
    ids = total["v"] + 3  # and the end, begin and unknown marks
    if ids >> ID_BITS:
        raise ValueError(f"over 2^{ID_BITS} distinct words")

    def run(batches):
        for shard, (h, n) in grouped(batches, "shard", ("h", "n")):
            if len(h) >> 64 - ID_BITS:
                raise ValueError("a word shard has more words than a key has places")
            write_shared(f"{root}/words-{shard}", *pack(h.view(np.uint64), narrow(n)))
            # where a range of about SHARD_TOKENS tokens begins: a word, or for one with more tokens a second word
            cuts, at, upto = [0], 0, np.cumsum(n)
            while at < len(n):
                mass = int(upto[at - 1]) if at else 0
                nxt = int(np.searchsorted(upto, mass + SHARD_TOKENS, side="right"))
                cuts.append(at << ID_BITS)
                if nxt == at:
                    parts = int(n[at] // SHARD_TOKENS) + 1
                    cuts += [at << ID_BITS | k * ids // parts for k in range(1, parts)]
                    nxt = at + 1
                at = nxt
            write_shared(f"{root}/edges-{shard}", *pack(np.unique(np.array(cuts, dtype=np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(h)], pa.int64())], ["shard", "size"])

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = counts.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", F.col("h") < 0, "h")  # as unsigned numbers
    found = {r["shard"]: r["size"] for r in rows.mapInArrow(run, "shard long, size long").collect()}  # one row per word shard
    starts = np.cumsum([0, *(found.get(s, 0) for s in range(1 << bits))])
    # texts begin with every word: their context may need several ranges as well
    parts = documents // SHARD_TOKENS + 1
    write_shared(f"{root}/edges-{1 << bits}", *pack(np.unique(np.array([k * ids // parts for k in range(parts)], dtype=np.uint64))))
    return Meta(root, bits, starts, documents, total["n"] + documents, total["v"] + (documents > 0))


def grouped(batches, key: str, columns: tuple[str, ...]):
    """(key, arrays) of consecutive rows with one key; number columns are joined, binary ones listed."""
    held, of = [], None
    for b in batches:
        keys = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and keys[i] != of:
                yield of, [np.concatenate(x) if isinstance(x[0], np.ndarray) else [z for y in x for z in y] for x in zip(*held)]
                held = []
            of = int(keys[i])
            held.append([c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy().copy() for c in (b.column(n).slice(i, j - i) for n in columns)])
    if held:
        yield of, [np.concatenate(x) if isinstance(x[0], np.ndarray) else [z for y in x for z in y] for x in zip(*held)]


def combined(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (shard, key) with the sums of their counts."""
    order = np.lexsort((keys, shards)) if (shards != shards[:1]).any() else np.argsort(keys, kind="stable")
    s, k, c = shards[order], keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])) if len(k) else np.zeros(0, int)
    return s[first], k[first], np.add.reduceat(c, first) if len(first) else c


def count_pairs(docs: DataFrame, meta: Meta) -> DataFrame:
    """shard, first, low, high, n: packed sorted bigrams of docs(text), combined by the sender; the
    shard is the word shard and the number of its range, the second word's id is in low and high."""
    held_meta = docs.sparkSession.sparkContext.broadcast(meta)

    def run(batches):
        m = held_meta.value
        ids, held, size, tokens = Ids(m), [], 0, 0

        def out():
            s, k, c = combined(*(np.concatenate(x) for x in zip(*held)))
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            rows = []
            for i, j in zip(cuts, cuts[1:]):
                inner = [i, *(i + np.searchsorted(k[i:j], ids.files(f"edges-{s[i]}")[0][1:])).tolist(), j]
                rows += [(int(s[i]) << 32 | r, x, y) for r, (x, y) in enumerate(zip(inner, inner[1:])) if x < y]
            parts = ((k >> np.uint64(ID_BITS)).astype("<u4"), k.astype("<u4"), (k >> np.uint64(32)).astype("<u1"), c.astype("<u4"))
            for g in range(0, len(rows), 64):
                own = rows[g : g + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in own], pa.int64()), *(pa.array([x[i:j].tobytes() for _, i, j in own], pa.binary()) for x in parts)], ["shard", "first", "low", "high", "n"])

        for b in batches:
            for own in blocks(b.column("text")):
                _, _, first, second, which = bigrams(*ids(own), m.begin)
                shard, key = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.uint64)
                for s, i, j in m.shards(first):
                    shard[i:j], key[i:j] = s, m.keys(s, first[i:j], second[i:j])
                held.append((shard, key, np.bincount(which, minlength=len(first))))
                size += len(first)
                tokens += len(which)
                if size >= FLUSH_PAIRS or tokens >= 1 << 31:  # so that a count fits in 32 bits
                    yield from out()
                    held, size, tokens = [], 0, 0
        if held:
            yield from out()

    return bounded(docs.select("text")).mapInArrow(tidied(run), "shard long, first binary, low binary, high binary, n binary")


def write_pairs(pairs: DataFrame, meta: Meta) -> DataFrame:
    """Writes a file for each shard: bigrams, counts, contexts, their totals and numbers of bigrams
    seen once, twice, more. Returns kind 0: (counts of counts), 1: word shard, place and statistics
    of the shard's first and last context, 2: packed (words, contexts before them) by word shard."""
    held_meta = pairs.sparkSession.sparkContext.broadcast(meta)

    def run(batches):
        m = held_meta.value
        for shard, (first, low, high, n) in grouped(batches, "shard", ("first", "low", "high", "n")):
            s, number = shard >> 32, shard & 0xFFFFFFFF
            join = lambda parts, kind: np.concatenate([np.frombuffer(x, kind) for x in parts])
            keys = join(first, "<u4").astype(np.uint64) << np.uint64(ID_BITS) | join(high, "<u1").astype(np.uint64) << np.uint64(32) | join(low, "<u4")
            _, k, c = combined(np.zeros(len(keys), dtype=np.int64), keys, join(n, "<u4").astype(np.int64))
            u = (k >> np.uint64(ID_BITS)).astype(np.uint32)
            start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            stats = [np.add.reduceat(x.astype(np.int64), start) for x in (c, c == 1, c == 2, c >= 3)]
            write_shared(f"{m.root}/pairs-{s}-{number}", *pack(k, narrow(c), u[start], *map(narrow, stats)))
            rows = [{"kind": 0, "key": s, "numbers": [len(k), *(int((c == r).sum()) for r in (1, 2, 3, 4))]}]
            rows += [{"kind": 1, "key": s, "numbers": [int(u[start][i]), *(int(x[i]) for x in stats)]} for i in {0, len(start) - 1}]
            w, before = np.unique(k & np.uint64((1 << ID_BITS) - 1), return_counts=True)
            at = np.minimum(np.searchsorted(m.starts, w.astype(np.int64), side="right") - 1, len(m.starts) - 2)
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(w)]
            for i, j in zip(cuts, cuts[1:]):
                own = w[i:j].astype(np.int64) - int(m.starts[at[i]])
                rows.append({"kind": 2, "key": int(at[i]), "a": own.astype("<u4").tobytes(), "b": before[i:j].astype("<u4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("numbers", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary())])
    return pairs.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "kind int, key long, numbers array<long>, a binary, b binary")


def write_split(rows: DataFrame, meta: Meta) -> None:
    """Writes the statistics of the contexts that several ranges hold, by word shard. Such a context is
    the first or last one of each of its ranges."""
    root = meta.root

    def run(batches):
        for shard, columns in grouped(batches, "key", ("place", "n0", "n1", "n2", "n3")):
            write_shared(f"{root}/split-{shard}", *pack(*columns))
            yield pa.RecordBatch.from_arrays([pa.array([len(columns[0])], pa.int64())], ["size"])

    ends = rows.where("kind = 1").groupBy("key", F.col("numbers")[0].alias("place")).agg(F.count("*").alias("m"), *[F.sum(F.col("numbers")[k + 1]).alias(f"n{k}") for k in range(4)]).where("m > 1")
    ends.repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, "size long").agg(F.sum("size")).collect()  # one number


def write_before(rows: DataFrame, meta: Meta) -> list[int]:
    """Writes the number of distinct words before each word, by word shard; returns how many words
    have 1, 2, 3, 4 and any number of them."""
    held_meta = rows.sparkSession.sparkContext.broadcast(meta)

    def run(batches):
        m = held_meta.value
        for shard, (w, n) in grouped(batches, "key", ("a", "b")):
            lo, hi = int(m.starts[shard]), int(m.starts[shard + 1])
            hi += shard == len(m.starts) - 2  # the end token is the last word
            total = np.zeros(hi - lo, dtype=np.int64)
            for x, y in zip(w, n):
                total[np.frombuffer(x, "<u4")] += np.frombuffer(y, "<u4")
            write_shared(f"{m.root}/before-{shard}", *pack(narrow(total)))
            yield pa.RecordBatch.from_pylist([{"n": [*(int((total == r).sum()) for r in (1, 2, 3, 4)), int((total > 0).sum())]}])

    found = rows.where("kind = 2").select("key", "a", "b").repartition("key").sortWithinPartitions("key").mapInArrow(run, "n array<long>").collect()  # one row per word shard
    return np.array([r["n"] for r in found], dtype=np.int64).reshape(-1, 5).sum(axis=0).tolist()


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D(0), D(1), D(2), D(3 or more); where a count of counts is missing, plain fractions stand in."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))]


def train(docs: DataFrame) -> Meta:
    """Counts docs(text), writes the model in the shared folder and returns what workers need."""
    spark = docs.sparkSession
    root = fresh_path(spark, "lm")
    documents = docs.count()
    counts = materialize(count_words(docs), "lm-words")
    meta = write_words(counts, root, documents)
    discard(counts)
    if not documents:
        return meta
    rows = materialize(write_pairs(count_pairs(docs, meta), meta), "lm-statistics")
    sums = rows.where("kind = 0").agg(*[F.sum(F.col("numbers")[k]).alias(f"n{k}") for k in range(5)]).first()
    meta.bigrams, meta.d2 = sums[0], discounts(*sums[1:])
    write_split(rows, meta)
    n = write_before(rows, meta)
    meta.d1 = discounts(*n[:4])
    meta.gamma = (meta.d1[1] * n[0] + meta.d1[2] * n[1] + meta.d1[3] * (n[4] - n[0] - n[1])) / meta.bigrams
    discard(rows)
    return meta


# -- scoring


class Scorer:
    def __init__(self, meta: Meta):
        self.meta, self.ids, self.files = meta, Ids(meta), Opened(meta.root, unpack, OPEN_FILES)

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers of words before, of sorted ids."""
        m = self.meta
        c, n = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        if not m.documents:
            return c, n
        cuts = np.searchsorted(ids, m.starts[1:-1])
        bounds = [0, *cuts.tolist(), int(np.searchsorted(ids, m.begin))]
        for s, (i, j) in enumerate(zip(bounds, bounds[1:])):
            if i < j:
                own = ids[i:j] - int(m.starts[s])
                before = self.files(f"before-{s}")[0]
                n[i:j] = before[own]
                word = own < m.starts[s + 1] - m.starts[s]
                if word.any():
                    c[i:j][word] = self.files(f"words-{s}")[1][own[word]]
        c[ids == m.end] = m.documents
        return c, n

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, context total and weight of the unigram part for each of the distinct bigrams."""
        m = self.meta
        c, total, weight = np.zeros(len(first), dtype=np.int64), np.ones(len(first)), np.ones(len(first))
        if not m.documents:
            return c, total, weight
        for s, i, j in m.shards(first):
            keys = m.keys(s, first[i:j], second[i:j])
            cuts = [0, *np.searchsorted(keys, self.files(f"edges-{s}")[0][1:]).tolist(), len(keys)]
            for number, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if x == y or (held := self.files(f"pairs-{s}-{number}")) is None:  # a range without bigrams
                    continue
                k, counts, contexts, *stats = held
                own, at = keys[x:y], np.minimum(np.searchsorted(k, keys[x:y]), len(k) - 1)
                c[i + x : i + y] = np.where(k[at] == own, counts[at], 0)
                self.fill(contexts, stats, own, total[i + x : i + y], weight[i + x : i + y])
            if (held := self.files(f"split-{s}")) is not None:
                self.fill(held[0], held[1:], keys, total[i:j], weight[i:j])
        return c, total, weight

    def fill(self, contexts: np.ndarray, stats: list[np.ndarray], keys: np.ndarray, total: np.ndarray, weight: np.ndarray) -> None:
        """Sets total and weight where the context of a key is known."""
        u, d = (keys >> np.uint64(ID_BITS)).astype(contexts.dtype), self.meta.d2
        at = np.minimum(np.searchsorted(contexts, u), len(contexts) - 1)
        hit = contexts[at] == u
        t, n1, n2, n3 = (x[at[hit]].astype(np.float64) for x in stats)
        total[hit], weight[hit] = t, (d[1] * n1 + d[2] * n2 + d[3] * n3) / t

    def score(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score of each document."""
        m = self.meta
        ids, sizes = self.ids(docs)
        begins = np.cumsum(sizes) - sizes
        word, inverse, first, second, which = bigrams(ids, sizes, m.begin)
        c, n = self.words(word)
        base = np.log10((c + 1) / (m.tokens + m.words + 1))
        unigram = np.maximum(n - np.array(m.d1)[np.minimum(n, 3)], 0) / max(m.bigrams, 1) + m.gamma / (m.words + 1)
        cp, total, weight = self.pairs(first, second)
        p = (cp - np.array(m.d2)[np.minimum(cp, 3)]) / total + weight * unigram[np.searchsorted(word, second)]
        logs = np.log10(p)
        return [sizes, np.add.reduceat((c > 0).astype(np.int64)[inverse], begins), np.add.reduceat(base[inverse], begins), np.add.reduceat(logs[which], begins)]


def score(docs: DataFrame, meta: Meta) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(meta)

    def run(batches):
        scorer = Scorer(held.value)
        for b in batches:
            at = 0
            for own in blocks(b.column("text")):
                tokens, known, base, logs = scorer.score(own)
                full = np.full(len(own), held.value.tokens, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(own)), pa.array(tokens), pa.array(known), pa.array(full), pa.array(base), pa.array(logs), pa.array(10 ** (-logs / tokens))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
                at += len(own)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(rows).mapInArrow(tidied(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its scores by a model of six sevenths of them. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns: as the
    module says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    meta = train(docs.where(fold_of(F.col("doc_id"), 7) != 2))
    got = score(docs, meta).withColumn("held_out", fold_of(F.col("doc_id"), 7) == 2)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
