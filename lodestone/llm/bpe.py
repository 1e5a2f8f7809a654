"""Byte-level BPE with a pair occurrence index, and token count reports on top of it.

A worker cuts each whole text into pre-tokens, collects those of a block of documents that its
cache lacks, and encodes them together: one index maps every mergeable pair to all its positions in
the block; ranks are applied in ascending order, every occurrence of a rank at once, and only the
lists of the pairs beside a merge are updated. A merge can only create pairs of higher rank,
because a pair that holds token t was learned after t, so one ascending sweep equals the usual
word-by-word greedy procedure.

Defined cases: a null text counts as empty and has no tokens; a special token's string inside a
text becomes that token; very long texts are encoded whole; repeated rows give repeated rows; an
empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, table, tidied

#: Splits at white space the way the full pattern does; the rest of the pattern then works inside a
#: chunk alone, so chunks can be cached whole.
WHITE = r"\t-\r \x85\xa0  -     　"
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Fixed value: the pre-token pattern of the vocabulary file, inside a chunk.
INNER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that a worker handles at once (a longer text alone), and bytes that its cached
#: chunks may take between blocks; a worker outlives its task, so the cache is emptied when one ends.
BLOCK_CHARS, CACHE_BYTES = 1_000_000, 32 << 20
#: Bytes of a cached chunk besides its characters and ids: two object headers and the entry.
ENTRY_BYTES = 180


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices data[start : start + size], one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return data[shift + np.arange(len(shift))]


class Bpe:
    """A vocabulary file of the tokenizers library with byte-level BPE."""

    def __init__(self, data: str):
        import regex

        spec = json.loads(data)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.id_of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        self.base = 1 + max(self.bytes_of)
        sizes = [len(self.bytes_of.get(i, b"")) for i in range(self.base)]
        self.size_of, self.start_of = np.array(sizes, dtype=np.int64), np.cumsum([0, *sizes[:-1]])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self.base)), dtype=np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.left, self.right = keys // self.base, keys % self.base
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.byte_ranks = self.rank(np.repeat(self.id_of_byte, 256), np.tile(self.id_of_byte, 256)).astype(np.int32)
        self.inner = regex.compile(INNER)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.cache_bytes = 0

    def forget(self, keep: set[str] = frozenset()) -> None:
        """Empties the cache but for the chunks to keep."""
        self.cache = {c: x for c, x in self.cache.items() if c in keep}
        self.cache_bytes = sum(ENTRY_BYTES + len(c) + len(x) for c, x in self.cache.items())

    def _remember(self, chunks: list[str], ids: list[bytes]) -> None:
        self.cache.update(zip(chunks, ids))
        self.cache_bytes += sum(map(len, chunks)) + sum(map(len, ids)) + ENTRY_BYTES * len(ids)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none (a negative symbol is a border)."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.base + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of each piece's ids, by the pair
        occurrence index over all of them."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"\0".join([*pieces, b""]), dtype=np.uint8)
        borders = np.cumsum(sizes + 1) - 1
        n = len(raw)
        sym = self.id_of_byte[raw].astype(np.int32)
        sym[borders] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        stamp = np.zeros(n, dtype=np.int32)
        after[-1:] = n - 1
        few = len(self.made) <= 1 << 16
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            use = ranks >= 0
            at, ranks = at[use], ranks[use]
            if not len(at):
                return
            order = np.argsort(ranks.astype(np.uint16) if few else ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(starts, starts[1:]):
                r = int(ranks[i])
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        first = self.byte_ranks[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        first[borders[:-1]] = -1
        first[borders[borders > 0] - 1] = -1
        add(np.arange(max(n - 1, 0), dtype=np.int32), first)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if not len(at):
                continue
            # a position may be listed twice: its last mention counts
            each = np.arange(len(at), dtype=np.int32)
            stamp[at] = each
            at = at[stamp[at] == each]
            if a == b and len(at) > 1:  # in a run of one symbol every second position starts a merge
                at.sort()
                chained = np.flatnonzero(after[at[:-1]] == at[1:]) + 1
                if len(chained):
                    skip = np.zeros(len(at), dtype=bool)
                    for i in chained.tolist():
                        skip[i] = not skip[i - 1]
                    at = at[~skip]
            gone = after[at]
            nxt = after[gone]
            sym[at] = new
            sym[gone] = -2
            after[at] = nxt
            before[nxt] = at
            prev = before[at]
            left = sym[prev]
            left[prev < 0] = -1
            add(np.concatenate([prev, at]), self.rank(np.concatenate([left, sym[at]]), np.concatenate([sym[at], sym[nxt]])))
        ids = sym[sym != -2]
        ends = np.flatnonzero(ids == -1)
        return ids[ids >= 0], np.diff(ends, prepend=-1) - 1

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of chunks, as little-endian bytes, in the cache."""
        names = [c for c in chunks if not c.isspace()]
        blank = [c for c in chunks if c.isspace()]  # a chunk of white space is one pre-token
        # line ends between chunks are pre-tokens of their own and mark where a chunk ends
        pieces = [*self.inner.findall("\n".join([*names, ""])), *blank]
        where = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        ids, counts = self.encode_pieces([p.encode() for p in where])
        which = np.fromiter(map(where.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        is_mark = which == where.get("\n", -1)
        is_mark[len(pieces) - len(blank) :] = False
        counts_of = counts[which]
        counts_of[is_mark] = 0
        starts_of = (np.cumsum(counts) - counts)[which]
        data = gather(ids.astype("<u4"), starts_of, counts_of).tobytes()
        ends = np.cumsum(counts_of) * 4
        own = ends[is_mark].tolist()
        self._remember(names, [data[i:j] for i, j in zip([0, *own], own)])
        tail = [*own[-1:], *ends[len(pieces) - len(blank) :].tolist()] if own else [0, *ends.tolist()]
        self._remember(blank, [data[i:j] for i, j in zip(tail, tail[1:])])

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut.split(t) if self.cut else [t] for t in texts]
        found = [[CHUNK.findall(s) if i % 2 == 0 else s for i, s in enumerate(parts)] for parts in cut]
        seen = {c for parts in found for own in parts[::2] for c in own}
        if self.cache_bytes > CACHE_BYTES:  # what this block needs stays
            self.forget(seen)
        self._learn(seen.difference(self.cache))
        get = self.cache.__getitem__
        out = []
        for parts in found:
            out.append(b"".join([b"".join(map(get, x)) if i % 2 == 0 else int(self.special[x]).to_bytes(4, "little") for i, x in enumerate(parts)]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian); invalid UTF-8 becomes U+FFFD."""
        at = np.frombuffer(ids, dtype="<u4")
        return gather(self.all_bytes, self.start_of[at], self.size_of[at]).tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def _loaded(data: str) -> Bpe:
    return Bpe(data)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def blocks(texts: pa.Array):
    """(first row, texts) of consecutive rows that hold about BLOCK_CHARS characters."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if held and size + len(t) > BLOCK_CHARS:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def encode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked, ids (array of int) and the digests of ids and decoded text.
    vocabulary: path of the vocabulary file, read by the driver and sent to the workers."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size
    schema = "doc_id long, n_tokens long" + (", ids array<int>" if with_ids else "") + (", ids_sha256 string, decoded_sha256 string" if with_digests else "")

    def run(batches):
        bpe = _loaded(held.value)
        try:
            for b in batches:
                for first, texts in blocks(b.column("text")):
                    ids = bpe.encode_block(texts)
                    cols = [b.column("doc_id").slice(first, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                    if with_ids:
                        offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
                        cols.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))))
                    if with_digests:
                        cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                        cols.append(pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])
        finally:
            bpe.forget()

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, text; null ids count as none."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = _loaded(held.value)
        for b in batches:
            texts = [bpe.decode(np.asarray(x.as_py() or [], dtype="<u4").tobytes()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return bounded(encoded.select("doc_id", "ids")).mapInArrow(tidied(run), "doc_id long, text string")


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The exact histogram (n_tokens, n_docs) of encoded lengths; documents are counted by the
    workers that encode them, so what is shuffled is distinct lengths."""
    lengths = encode(docs, vocabulary, with_ids=False)
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """Answers for every context limit that is a length of the histogram, by suffix sums.

    n_tokens, n_docs; docs_at_least, tokens_at_least (documents of this length or longer, and their
    tokens); docs_total, tokens_total; truncated_total (tokens left when every document is cut at
    this length); lost_tokens; quantile (share of documents of this length or shorter). A limit
    between two lengths L1 < x < L2 keeps truncated_total(L1) + (x - L1) * docs_at_least(L2).
    An empty table gives no rows. The windows run over distinct lengths, in blocks of lengths:
    sums within a block of 1024 lengths, and sums of whole blocks, are added.
    """
    h = materialize(histogram.withColumn("block", F.floor(F.col("n_tokens") / 1024)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "length-histogram")
    above = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    x = h.withColumn("d_in", F.sum("n_docs").over(above)).withColumn("t_in", F.sum("tokens").over(above)).join(sums, "block")
    x = x.withColumn("docs_at_least", F.col("d_in") + F.col("d_later")).withColumn("tokens_at_least", F.col("t_in") + F.col("t_later"))
    x = x.withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
    return x.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total", "truncated_total", (F.col("tokens_total") - F.col("truncated_total")).alias("lost_tokens"), ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the digests of its ids and of what they decode to. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns:
    as the module says."""
    return encode(table(spark, sf_dir, "documents"), with_ids=False, with_digests=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every distinct encoded length of all documents. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns:
    as the module says."""
    return context_report(length_histogram(table(spark, sf_dir, "documents")))
