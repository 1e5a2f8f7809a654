"""Every stage of the pipeline against a plain version of it, and the pipeline as a whole."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lodestone.llm import bpe, mixing

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Columns with names that the stages use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _mix_copies string, copies int, row_key string, c0 string, stay int, gone_id long"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(200)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 90))) for _ in range(50)]
    texts += [None, "", " \t", "12 + 13", texts[3], texts[3].upper(), texts[4], "word " * 20000, texts[5] + " tail", "é"]
    rows = [(i, t, ["en", "de", "fr", None][i % 4], ["a", "b", None][i % 3], len(t or ""), "m", 7, "k", "z", 9, 5) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, texts[7], "en", "a", 1, None, None, None, None, None, None), (None, texts[7], "en", "a", 1, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_language(spark, docs):
    out = STAGES["language"](spark, docs, DATA)
    assert out.columns == docs.columns
    assert rows(out) == Counter({r: n for r, n in rows(docs).items() if r[1] and any(map(str.isalpha, r[1]))})


def low(t):
    return (t or "").encode().lower()


def test_exact(spark, docs):
    out = STAGES["exact"](spark, docs, DATA)
    best = {}
    for r in sorted(rows(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        best[low(r[1])] = r
    assert out.columns == docs.columns and rows(out) == Counter(best.values())


def fingerprint(t):
    w = low(t).split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_near(spark, docs):
    own = docs.where("doc_id is not null")
    all_ = sorted(rows(own), key=lambda r: r[0])
    fps, up = [fingerprint(r[1]) for r in all_], list(range(len(all_)))
    for _ in all_:  # labels spread until nothing changes
        new = [min(up[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
        if new == up:
            break
        up = new
    out = STAGES["near"](spark, own, DATA)
    assert out.columns == docs.columns and rows(out) == Counter(r for i, r in enumerate(all_) if up[i] == i)


def test_mix(spark, docs):
    out = STAGES["mix"](spark, docs, DATA)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter()
    for r, n in rows(out).items():
        got[r[0], r[3], len((r[1] or "").split())] += n
    assert out.columns == docs.columns and got == Counter({k: n for k, n in taken.items() if n})


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for r, n in rows(docs).items():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += n
    assert rows(STAGES["tokens"](spark, docs, DATA)) == want


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), DATA).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_stages(spark):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in out.collect()} <= ids and out.count() > 50
    assert list(STAGES) == ["language", "exact", "near", "mix", "tokens"]
