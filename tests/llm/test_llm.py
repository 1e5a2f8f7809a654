"""The training-data operators against plain versions, on rows with nulls, empty, repeated and long texts."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, embedding_dedup, exact_dedup, fuse_filter, language_id, language_model, license_scan, mixing, simhash_dedup
from lodestone.llm.common import materialize
from lodestone.llm.components import connected_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, fp string"


def make(spark, texts, source=lambda i: f"s{i % 4}", lang=lambda i: "en"):
    """Documents with two further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or ""), "x", "y") for i, t in enumerate(texts)], COLUMNS)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    out += [None, "", "   ", "one", out[0], out[0].upper(), out[1] + " more", "long " * 30000, "\x00<|endoftext|>\t日本  x\r\n"]
    return out


def union_find(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(341, links)
    assert all(got[i] == want[i] for i in got) and {i for x in links if x[0] != x[1] for i in x} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains(spark):
    """Chains of 1,000 nodes: ids that rise, that fall and that alternate, and a hub of the largest id."""
    n = 1000
    zigzag = [x for k in range(n // 2) for x in (k, n - 1 - k)]
    links = [(i, i + 1) for i in range(n - 1)] + [(2 * n - i, 2 * n - i - 1) for i in range(1, n)]
    links += [(2 * n + a, 2 * n + b) for a, b in zip(zigzag, zigzag[1:])] + [(4 * n - 1, 3 * n + i) for i in range(n - 1)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i // n * n for i in range(4 * n)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, 20000).astype(np.uint64) | np.uint64(1 << 63)
    data = fuse_filter.build(keys)
    assert fuse_filter.contains(data, keys).all() and fuse_filter.contains(data, others).mean() < 0.02


def test_license(spark):
    rows = ["Released under the MIT License.", "x " * 100 + "licensed under the apache license version 2 " + "y " * 50, "GENERAL public\nlicense mit-license", None, "", "mit", "this work is licensed under gnu general public license version 3", "plain words only"]
    got = license_scan.scan(make(spark, [*rows, rows[0]])).orderBy("doc_id").collect()
    assert [r["base_labels"] for r in got] == ["mit", "apache", "gpl,mit", "", "", "", "gpl", "", "mit"]
    assert [r["labels"] for r in got] == ["mit", "apache,apache-2.0", "gpl,mit", "", "", "", "gpl,gpl-3.0", "", "mit"]
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in got[:4]] == [(5, 1, 3, 3), (157, 1, 103, 103), (5, 2, 0, 3), (0, 0, None, None)]
    assert all(0 <= r["score"] <= 1 for r in got) and license_scan.scan(make(spark, [])).count() == 0


def test_license_wrapped(spark):
    """Notices as published, wrapped over lines; the words of a template far apart are none."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\r\n// License, v. 2.0. If a copy of the MPL was not distributed with this file"
    gpl = "This work is licensed under the GNU\nGeneral Public License version 3"
    fill = "\n".join(["lorem ipsum dolor sit amet"] * 40)
    far = "redistribution and use in source\n" + fill + "\nbinary forms with or without modification are permitted"
    rows = [bsd, mpl, gpl, bsd.replace(" ", "\n"), f"{fill}\n{bsd}\n{fill}\n{mpl}\n{fill}", far]
    for k in range(20, 45):  # at every place of the windows
        rows.append("w\n" * k + mpl)
    got = license_scan.scan(make(spark, rows)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got[:6]] == ["bsd-3-clause", "mpl-2.0", "gpl,gpl-3.0", "bsd-3-clause", "bsd-3-clause,mpl-2.0", ""]
    assert [r["score"] for r in got[:6]] == [1, 1, 1, 1, 1, 0] and {(r["labels"], r["score"]) for r in got[6:]} == {("mpl-2.0", 1.0)}


def test_mixing(spark):
    rnd = random.Random(3)
    docs = make(spark, [" ".join("w" * rnd.randint(1, 40)) for _ in range(900)] + [None, ""], lambda i: [None, "a", "b", "c", "c", "c"][i % 6])
    got = mixing.mix(docs).collect()
    assert len(got) == 902 and all(0 <= r["copies"] <= 3 for r in got)
    per = defaultdict(int)
    for r in got:
        per[r["source"]] += r["copies"] * r["size"]
    sizes = {r["source"]: r["source_size"] for r in got}
    want = {r["source"]: r["target"] for r in got}
    total, weights = sum(sizes.values()), {"a": 1, "b": 2, "c": 3, None: 1}
    capped: set = set()
    while True:  # the excess goes to the others by weight
        free = total - sum(3 * sizes[s] for s in capped)
        plain = {s: free * weights[s] / sum(w for x, w in weights.items() if x not in capped) for s in weights if s not in capped}
        over = {s for s, t in plain.items() if t > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in weights:
        assert want[s] == pytest.approx(plain.get(s, 3 * sizes[s])) and per[s] == pytest.approx(want[s], rel=0.03)
    assert [tuple(r) for r in mixing.mix(docs).orderBy("doc_id").collect()] == [tuple(r) for r in sorted(got, key=lambda r: r["doc_id"])]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(make(spark, [])).count() == 0


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    got = bpe.encode(make(spark, texts), with_digests=True).orderBy("doc_id").collect()
    for r, x in zip(got, texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    assert {r["text"] for r in bpe.decode(bpe.encode(make(spark, texts))).collect()} == {x or "" for x in texts}
    odd = ["aaaaaaaaa", "!!!!!!!", "a  b\n\n c \x1c\x85", "'s'll 're", "é́Ⅷ²", "x<|endoftext|><|endoftext|> y"]
    b = bpe._loaded(open(bpe.default_vocabulary()).read())
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_block(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]
    report = bpe.context_report(bpe.length_histogram(make(spark, texts))).collect()
    lengths = [r["n_tokens"] for r in got]
    for r in report:
        assert r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in lengths) and r["docs_at_least"] == sum(x >= r["n_tokens"] for x in lengths)
        assert r["tokens_total"] == sum(lengths) and r["quantile"] == pytest.approx(sum(x <= r["n_tokens"] for x in lengths) / len(lengths))
    assert bpe.encode(make(spark, [])).count() == 0 and bpe.context_report(bpe.length_histogram(make(spark, []))).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 64)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    v[100:200] = v[:100] + rng.normal(size=(100, 16)) * 0.05
    v[200:220] = v[0]
    rows = [(i, [float(np.float32(x)) for x in r], i % 2 if i < 200 else 0) for i, r in enumerate(v)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [1.0, None], 0), (305, rows[0][1], None), (306, [1.0, 2.0], 1), (307, [1.0, 2.0], 1)]
    rows = [(*r, "x", 1) for r in rows]
    got = {r["vec_id"]: r for r in embedding_dedup.classify(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, weight int")).collect()}
    near = np.zeros((308, 308), dtype=bool)
    for i in range(300):
        for j in range(300):
            near[i, j] = i != j and rows[i][2] == rows[j][2] and np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= 0.98
    near[306, 307] = near[307, 306] = True
    roots = union_find(308, zip(*np.nonzero(near)))
    for i in range(308):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), roots[i], roots[i] == i)


def test_language_model(spark, texts, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 400)
    monkeypatch.setattr(language_model, "SHARD_WORDS", 50)
    docs = make(spark, texts)
    train = docs.where("doc_id % 3 <> 0")
    got = {r["doc_id"]: r for r in language_model.score(docs, language_model.train(train)).collect()}
    words = [[*(t or "").encode().lower().split(), "<e>"] for t in texts]
    uni, bi = Counter(), Counter()
    for i, w in enumerate(words):
        if i % 3:
            uni.update(w)
            bi.update(zip(["<b>", *w], w))
    n, v = sum(uni.values()), len(uni)
    of, before = defaultdict(lambda: [0, 0, 0, 0]), Counter(w for _, w in bi)
    for (u, _), c in bi.items():
        of[u][0] += c
        of[u][min(c, 3)] += 1
    d2, d1 = (language_model.discounts(*(Counter(x.values())[k] for k in (1, 2, 3, 4))) for x in (bi, before))
    gamma = sum(d1[min(c, 3)] for c in before.values()) / len(bi)

    def p(u, w):
        one = max(before[w] - d1[min(before[w], 3)], 0) / len(bi) + gamma / (v + 1)
        if u not in of:
            return one
        total, *k = of[u]
        return (bi[u, w] - d2[min(bi[u, w], 3)]) / total + sum(a * b for a, b in zip(d2[1:], k)) / total * one

    for i, w in enumerate(words):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in uni for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<b>", *w], w)))
    assert sum(p("one", w) for w in uni) + gamma / (v + 1) * (sum(a * b for a, b in zip(d2[1:], of["one"][1:])) / of["one"][0] if "one" in of else 1) == pytest.approx(1, abs=0.02)
    empty = language_model.score(docs, language_model.train(docs.where("false"))).collect()
    assert all(r["base_score"] == r["score"] == 0 for r in empty)


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "PAIRS", 64)

    def plain(t):
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))

    fps = [plain(t) for t in texts]
    got = simhash_dedup.classify(make(spark, texts)).orderBy("doc_id").collect()
    assert [r["fp"] & (1 << 64) - 1 for r in got] == fps
    n = len(fps)
    assert [r["component_id"] for r in got] == union_find(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    rng = random.Random(hot)
    own = [rng.getrandbits(64) for _ in range(60)] + [0b11]
    for _ in range(400):
        own.append(own[rng.randrange(len(own))] ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) & (1 << 64) - 1)
    own = sorted(set(own))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in own], "fp long")
    roots = connected_components(simhash_dedup.link(materialize(frame, "t"), hot=hot))
    links = [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 4]
    want = union_find(len(own), links)
    groups = defaultdict(set)
    for r in roots.collect():
        groups[r["root"]].add(r["node"] & (1 << 64) - 1)
    plain_groups = defaultdict(set)
    for i, w in enumerate(want):
        plain_groups[w].add(own[i])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in plain_groups.values() if len(g) > 1)


def test_simhash_stage(spark, texts):
    docs = make(spark, texts)
    left = simhash_dedup.drop_near_copies(docs.union(docs.where("doc_id = 3")))
    ids = sorted(r["doc_id"] for r in left.collect())
    assert left.columns == docs.columns and ids == sorted({r["component_id"] for r in simhash_dedup.classify(docs).collect()})


def test_language(spark):
    rnd = random.Random(9)
    letters = {"en": "thewandoi", "de": "ßüchsenä", "fr": "éèlaqueu", "es": "ñóloscar", "xx": "щыж"}
    lang = lambda i: list(letters)[i % 5]
    texts = [" ".join("".join(rnd.choice(letters[lang(i)]) for _ in range(5)) for _ in range(30)) for i in range(200)] + [None, "", "12 !", "a" * 600000]
    docs = make(spark, texts, lang=lang)
    model = language_id.fit(language_id.training(docs))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == lang(i) for i in range(200)) >= 198
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    left = language_id.keep_known(docs)
    assert left.columns == docs.columns and left.where("doc_id < 200").count() == 200 and left.where("doc_id in (200, 201, 202)").count() == 0
    none = language_id.predict(docs, language_id.fit(docs.where("false"))).select("lang_pred").distinct().collect()
    assert [r["lang_pred"] for r in none] == ["und"]
    whole, cut = language_id.features("abc de " * 90000), language_id.features("abc de " * 1000)
    assert np.abs(whole - cut).max() < 0.01


def test_chat(spark):
    events = [
        (1, 0, "open", 0, "user", None), (1, 1, "delta", 0, None, "hel"), (1, 2, "delta", 0, None, "lo"),
        (1, 3, "open", 1, "assistant", None), (1, 4, "delta", 1, None, "bad"), (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "good <|im_end|>"),
        (1, 7, "open", 2, "user", None), (1, 8, "delta", 2, None, "gone"), (1, 9, "edit", 0, None, "hi"), (1, 10, "open", 1, "assistant", None), (1, 11, "delta", 1, None, "yes <\\|"),
    ]
    got = chat.reconstruct(spark.createDataFrame(events, chat.EVENTS)).orderBy("position").collect()
    assert [chat.parse(r["formatted"]) for r in got] == [("user", "hi"), ("assistant", "yes <\\|")]
    assert [chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in got if r["loss_start"] is not None] == ["yes <\\|"]
    for text in ("<|", "<\\|", "<\\\\|<|im_end|>", "<", "a<", "|>", "\\", ""):
        for role in ("user", "a\nb\\n<|"):
            turn, i, j = chat.render(role, text)
            assert chat.parse(turn) == (role, text) and turn[i:j].count("<|") == 0
    rows = [(1, 0, "user", "q", 0), (1, 0, "user", "q", 0), (1, 1, "assistant", None, 0), (None, 2, None, "x", 0)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.reconstruct(chat.turns_to_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\nq\nuser\nq\nassistant\n\n").hexdigest() and got[None]["loss_chars"] == 0


@pytest.mark.parametrize("clashes", [False, True])
def test_exact(spark, texts, clashes):
    docs = make(spark, texts)
    digest = (lambda data: bytes([zlib.crc32(data) % 7])) if clashes else exact_dedup.sha256
    got = exact_dedup.classify(docs, digest=digest).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").encode().lower()].append(i)
    of = {i: g for g in groups.values() for i in g}
    assert len(got) == len(texts)
    for r in got:
        g = of[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))


def test_exact_stage(spark, texts):
    docs = make(spark, texts)
    again = docs.union(docs.where("doc_id in (2, 3)"))
    left = exact_dedup.drop_copies(again)
    want = sorted(max(i for i, t in enumerate(texts) if (t or "").encode().lower() == k) for k in {(t or "").encode().lower() for t in texts})
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == want
    assert exact_dedup.classify(docs.where(F.lit(False))).count() == 0


def test_simhash_divides_crowded_keys(spark):
    """All share the bits of one partition; hot 3 divides again and again, and no link is lost."""
    rng = random.Random(4)
    own = sorted({rng.getrandbits(30) for _ in range(300)} | {1 << i for i in range(30)} | {0})
    frame = spark.createDataFrame([(x,) for x in own], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash_dedup.link(materialize(frame, "t"), hot=3)).collect()}
    want = union_find(len(own), [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 4])
    assert [roots.get(x, x) for x in own] == [own[w] for w in want] and len(set(want)) > 5


def test_license_texts(spark):
    """The templates as published, far into a long text, wrapped, with null ids and repeated rows."""
    mit = license_scan.TEMPLATES["mit-text"].upper().split()
    wrapped = "\n * ".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    long = "lorem ipsum " * 20000 + wrapped + " dolor sit" * 20000
    rows = [(1, long), (None, wrapped), (None, wrapped), (3, " ".join(mit[: len(mit) // 2])), (4, "see the license for the specific language")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in got) == [(0, "mit-text"), (0, "mit-text"), (1, "mit-text"), (3, ""), (4, "")]
    assert {r["n_words"] for r in got if r["doc_id"] == 1} == {80000 + len(mit)}


def test_mixing_rates_are_the_optimum(spark):
    """Rates against a plain bisection of the dual; every source ends within half of a short document."""
    rnd = random.Random(12)
    docs = make(spark, [" ".join(["w"] * rnd.choice([1, 2, 5, 40, 300])) for _ in range(400)] + ["w " * 9000, "w", "w"], lambda i: "abc"[min(2, i % 7)])
    got = mixing.mix(docs.union(docs.where("doc_id < 5"))).collect()
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        target, sizes = own[0]["target"], [r["size"] for r in own]
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            total = sum(s * min(3, math.exp(min(50, mid * s / 100))) for s in sizes)
            lo, hi = (mid, hi) if total < target else (lo, mid)
        if target < 3 * sum(sizes) * (1 - 1e-9):
            assert [r["rate"] for r in own] == pytest.approx([min(3, math.exp(min(50, lo * s / 100))) for s in sizes], rel=1e-3)
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 2
        assert all(0 <= r["copies"] <= 3 for r in own)


def test_mixing_does_not_hide_that_it_failed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        mixing.mix(make(spark, ["w " * (1 + i % 50) for i in range(60)])).collect()


def test_running_sums(spark):
    rows = [(f"s{i:03d}", i) for i in range(300)] + [(None, 7)]
    got = mixing.running(spark.createDataFrame(rows, "source string, n long"), [F.col("source").asc_nulls_last()], before=F.col("n")).collect()
    assert {r["source"]: r["before"] for r in got} == {f"s{i:03d}": i * (i - 1) // 2 for i in range(300)} | {None: 299 * 150}


def test_embeddings_edge_cases(spark, monkeypatch):
    empty = embedding_dedup.classify(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (9, None, 1)]
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.classify(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(-1, 2, 4, False), (4, 2, 4, True), (5, 2, 4, False), (9, 0, 9, True)]


def test_pairs_of_intervals_miss_none(spark):
    """The recursion over runs against all pairs."""
    rng = np.random.default_rng(3)
    lo = np.sort(rng.random((90, 2)), axis=0)
    rows = [(i, i // 50, 2, x.tolist(), (x + 0.02).tolist()) for i, x in enumerate(lo)]
    got = embedding_dedup.pairs_of(spark.createDataFrame(rows, "block long, label long, size int, lo array<double>, hi array<double>"), 0.05, fan=3)
    gap = lambda a, b: math.dist([0, 0], [max(0, x - z, y - w) for x, w, y, z in zip(a[3], a[4], b[3], b[4])])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] <= b[0] and a[1] == b[1] and gap(a, b) <= 0.05}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 90


def test_language_model_is_wide_enough():
    """Ids over 32 bits, counts over 32 bits, and files no wider than they need to be."""
    meta = language_model.Meta("", 1, np.array([0, (1 << 33) - 5, (1 << 33) + 5]), 1, 1, 1)
    word = np.array([3, 1 << 33, 1 << 33, meta.unknown, meta.begin, meta.begin])
    second = np.array([1 << 33, 7, meta.end, 7, 1, meta.end])
    assert [(s, i, j) for s, i, j in meta.shards(word)] == [(0, 0, 1), (1, 1, 3), (2, 4, 6)]
    keys = meta.keys(1, word[1:3], second[1:3])
    assert (keys >> np.uint64(40)).tolist() == [5, 5] and (keys & np.uint64((1 << 40) - 1)).tolist() == [7, meta.end]
    for top, kind in ((255, "u1"), (256, "u2"), (1 << 31, "u4"), (1 << 33, "u8")):
        assert language_model.narrow(np.array([0, top])).dtype == np.dtype(f"<{kind}") and language_model.narrow(np.array([0, top]))[1] == top
    s, k, c = language_model.combined(np.array([1, 0, 1]), np.array([5, 9, 5], dtype=np.uint64), np.array([1 << 40, 1, 1]))
    assert (s.tolist(), k.tolist(), c.tolist()) == ([0, 1], [9, 5], [1, (1 << 40) + 1])


def test_language_model_repeated_rows(spark, texts):
    docs = make(spark, texts[:12])
    twice = docs.union(docs)
    one = {r["doc_id"]: r for r in language_model.score(docs, language_model.train(twice)).collect()}
    assert all(r["train_tokens"] == 2 * sum(len((t or "").encode().lower().split()) + 1 for t in texts[:12]) for r in one.values())
    assert language_model.score(docs.limit(0), language_model.train(docs)).count() == 0
    null = language_model.score(spark.createDataFrame([(None, None)], "doc_id long, text string"), language_model.train(docs)).first()
    assert null["doc_id"] is None and null["n_tokens"] == 1


def test_languages_are_bounded(spark):
    rows = [(i, "abc def ghi", f"l{i % 30:02d}", "s", 1, "x", "y") for i in range(60)] + [(100 + i, "xyz uvw rst", "en", "s", 1, "x", "y") for i in range(40)]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = language_id.fit(docs, languages=3)
    assert model.langs == ["en", "l00", "l01"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert set(got.values()) <= {"en", "l00", "l01"} and all(got[100 + i] == "en" for i in range(40))
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_svm_against_a_plain_one():
    """The machine for a pair against plain gradient descent on the same loss."""
    rng = np.random.default_rng(1)
    y = np.where(rng.random(120) < 0.3, 1.0, -1.0)
    x = rng.normal(size=(120, 5)) + y[:, None] * np.array([1.0, 0.5, 0, 0, 0])
    w, b = language_id._svm(x, y, rounds=3000)
    n, c = len(y), 10.0
    weight = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    loss = lambda w, b: 0.5 / n * (w @ w) + c * np.mean(weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2)
    best = loss(w, b)
    for _ in range(300):
        d = rng.normal(size=6) * 0.02
        assert loss(w + d[:5], b + d[5]) > best - 1e-6


def test_chat_empty(spark):
    assert chat.read_back(chat.reconstruct(chat.turns_to_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


def test_exact_edge_cases(spark):
    rows = [(None, "Same"), (None, "same"), (7, "SAME"), (7, "same"), (None, "alone"), (None, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.classify(frame, batches=3).collect()
    assert len(got) == 7
    same = [r for r in got if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {7} and sum(r["kept"] for r in same) == 1
    assert [(r["keep_id"], r["kept"]) for r in got if r["group_size"] == 1] == [(None, True)]
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in got if r["group_size"] == 2) == [(0, False), (3, True)]
    assert sorted(r["text"] or "" for r in exact_dedup.drop_copies(frame).collect()) in (["", "SAME", "alone"], ["", "alone", "same"])


def test_exact_over_many_batches_and_buckets(spark, monkeypatch):
    """Copies within a batch and across three of them, in several buckets and check filters."""
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 40)
    monkeypatch.setattr(exact_dedup, "CHECK_KEYS", 16)
    rnd = random.Random(2)
    texts = [f"text {rnd.randrange(150)}" for _ in range(400)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classify(make(spark, texts), batches=4).collect()}
    of = defaultdict(list)
    for i, t in enumerate(texts):
        of[t].append(i)
    assert got == {i: (max(of[t]), len(of[t]), i == max(of[t])) for i, t in enumerate(texts)}


def test_written_tables_can_be_removed(spark):
    from lodestone.llm import common

    t = materialize(spark.range(3), "t")
    path = t._written.removeprefix("file:")
    assert os.path.isdir(path)
    common.discard(t, spark.range(1))
    assert not os.path.isdir(path)
    uri = common.fresh_path(spark, "file")
    common.write_shared(f"{uri}/x", *common.pack(np.arange(3), np.array([1.5])))
    a, b = common.unpack(f"{uri}/x")
    assert a.tolist() == [0, 1, 2] and b.tolist() == [1.5]


def test_simhash_null_ids_and_no_rows(spark):
    rows = [(None, "one two three"), (None, "one two three"), (4, "ONE two three"), (None, "alone in here"), (6, None), (5, " ")]
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash_dedup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 0), (0, 4), (0, 4), (4, 4), (5, 5), (6, 5)]
    assert simhash_dedup.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0
