"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed character n-grams (orders 1 to 3 of the lower-cased letters, runs
of anything else as one blank; square roots of counts, unit length). A linear model over language
families decides the family first (softmax regression); within a family every pair of languages
has a linear support vector machine (squared hinge loss), and the language with the most wins,
margins breaking ties, is the prediction. Score: the family's probability times the mean logistic
of the winner's margins; 1 where there is nothing to choose from.

Training reads at most MAX_PER_LANGUAGE labelled documents of each language (whole texts, chosen by
a hash of doc_id and text against a share of the language's count, so the bound holds in
expectation and is cut exactly on the driver); prediction reads every whole text. Features are
computed on the executors; the driver fits MAX_PER_LANGUAGE x languages vectors of DIMENSIONS. Of more
than MAX_LANGUAGES values of lang the most frequent ones are learned (of equally frequent ones the
first), as stray labels are no languages; texts of the others are predicted like all texts.

Defined cases: null texts and texts without a letter are `und` with score 0; a null lang is not
learned from; with no labelled document everything is `und`, with one language all texts with a
letter are that language; a lang that no family lists is a family of its own; repeated rows count and
are predicted each; equal scores go to the last language in order; null doc_ids are predicted and stay
null; texts of any length are read whole; other columns pass through keep_known() whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, by_position, fold_of, table, tidied

DIMENSIONS, MAX_PER_LANGUAGE, MAX_LANGUAGES, UNKNOWN, MIN_SCORE = 1 << 12, 400, 100, "und", 0.2
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
    "sinitic": ["zh", "yue"],
}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, itself when it is a letter, else 0."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            out[c] = c
    return out


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Unit vector of the whole text; None where it has no letter."""
    if not text:
        return None
    total = np.zeros(dimensions)
    some, tail = False, np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), 1 << 18):
        own = np.frombuffer(text[at : at + (1 << 18)].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        x = _letters()[own]
        some = some or bool(x.any())
        if not some:
            tail = np.zeros(1, dtype=np.uint32)
            continue
        x = np.concatenate([tail, x])
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        known = min(len(tail), 2)
        for n, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
            if len(x) < n:
                continue
            h = x[: len(x) - n + 1].astype(np.uint32)
            for k in range(1, n):
                h = h * np.uint32(0x01000193) + x[k : len(x) - n + 1 + k]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(salt)
            h = (h ^ (h >> np.uint32(13)))[max(0, known - n + 1) :]
            total += np.bincount(h % np.uint32(dimensions), minlength=dimensions)
        tail = x[-2:]
    if not some:
        return None
    total = np.sqrt(total)
    return total / np.linalg.norm(total)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine (y is -1 or 1) by accelerated gradient descent."""
    n = len(y)
    balance = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    xb = np.hstack([x, np.ones((n, 1))])
    w = v = np.zeros(xb.shape[1])
    step, reg = 1.0 / (4 * c * balance.max() + 1 / n * c), 1.0 / n
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (xb @ v))
        grad = reg * np.append(v[:-1], 0) - 2 * c * (xb.T @ (balance * slack * y)) / n
        new = v - step * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _softmax(x: np.ndarray, of: np.ndarray, k: int, rounds: int = 200, reg: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    one = np.eye(k)[of]
    weight = (len(of) / (k * np.maximum(1, one.sum(axis=0))))[of][:, None] / len(of)
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    vw, vb = w, b
    for t in range(rounds):
        z = x @ vw + vb
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = weight * (z / z.sum(axis=1, keepdims=True) - one)
        nw, nb = vw - 8.0 * (x.T @ g + reg * vw), vb - 8.0 * g.sum(axis=0)
        vw, vb = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
    return w, b


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, list[str]] = FAMILIES):
        self.langs = sorted(set(langs))
        family = {v: f for f, own in families.items() for v in own}
        self.family_of = {v: family.get(v, f"={v}") for v in self.langs}
        self.families = sorted(set(self.family_of.values()))
        labels = np.array(langs)
        of = np.array([self.families.index(self.family_of[v]) for v in langs], dtype=np.int64)
        self.w, self.b = _softmax(x, of, len(self.families)) if len(self.families) > 1 else (None, None)
        self.pairs = {}
        for f in self.families:
            own = [v for v in self.langs if self.family_of[v] == f]
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    use = (labels == a) | (labels == b)
                    w, bias = _svm(x[use], np.where(labels[use] == a, 1.0, -1.0))
                    self.pairs[a, b] = (w.astype(np.float32), bias)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return UNKNOWN, 0.0
        at, sure = 0, 1.0
        if self.w is not None:
            z = v @ self.w + self.b
            z = np.exp(z - z.max())
            at = int(z.argmax())
            sure = float(z[at] / z.sum())
        own = [x for x in self.langs if self.family_of[x] == self.families[at]]
        wins = {x: [0, 0.0, []] for x in own}
        for (a, b), (w, bias) in self.pairs.items():
            if a in wins:
                m = float(v @ w + bias)
                for x, s in ((a, m), (b, -m)):
                    wins[x][0] += s > 0
                    wins[x][1] += s
                    wins[x][2].append(1 / (1 + np.exp(-3 * s)))
        best = max(own, key=lambda x: (wins[x][0], wins[x][1], x))
        return best, float(min(1.0, max(0.0, sure * (np.mean(wins[best][2]) if wins[best][2] else 1.0))))


def fit(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE, languages: int = MAX_LANGUAGES) -> Model:
    """Learns from the rows of docs(doc_id, text, lang) with a lang and a letter."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r["lang"]: r["n"] for r in counts.collect()}
    if not counts:
        return Model(np.zeros((0, DIMENSIONS)), [])
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_language / n))])
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    chosen = known.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share)

    def run(batches):
        for b in batches:
            out = [(v, h, x) for v, h, t in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("text")) if (x := features(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].astype(np.float16).tobytes() for x in out], pa.binary())], ["lang", "h", "x"])

    rows = bounded(chosen).mapInArrow(tidied(run), "lang string, h long, x binary").collect()  # at most about 1.5 x per_language for each language
    rows.sort(key=lambda r: (r["lang"], (r["h"] >> 11) & (1 << 53) - 1, r["x"]))
    kept, seen = [], {}
    for r in rows:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_language:
            kept.append(r)
    x = np.array([np.frombuffer(r["x"], dtype=np.float16) for r in kept], dtype=np.float64).reshape(-1, DIMENSIONS)
    return Model(x, [r["lang"] for r in kept])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_key, lang_pred, score for each row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers per family and pair of languages

    def run(batches):
        m = held.value
        for b in batches:
            out = [m.predict(x) if (x := features(t.as_py())) is not None else (UNKNOWN, 0.0) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "row_key", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    return bounded(rows).mapInArrow(tidied(run), "doc_id long, row_key long, lang_pred string, score double")


def training(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(fold_of(F.col("doc_id"), 3) != 1)


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is predicted with at least min_score; others are rejected."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training(docs)))
    plain, names, at = by_position(docs)
    text = at["text"]

    def run(batches):
        m = model.value
        for b in batches:
            keep = [(x := features(t.as_py())) is not None and m.predict(x)[1] >= min_score for t in b.column(text)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return bounded(plain).mapInArrow(tidied(run), plain.schema).toDF(*names)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language that two thirds of the labelled ones teach. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns: as the
    module says."""
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, fit(training(docs)))
    return got.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
