"""The engine from files to answers, on small inputs against plain versions and given cases."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, chunking, communities, graph, hops, library, lookahead, resolution, store, tree
from lodestone.service import Service
from lodestone.settings import Settings
from lodestone.sources import demo, documents, remote
from lodestone.streaming import ingest


def naive_windows(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = max((i for i in range(at + size // 2, end) if text[i] in "\n "), default=-1)
            end = cut if cut > at else end
        out.append((at, end))
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def test_windows():
    rnd = random.Random(1)
    for size, overlap in ((10, 3), (7, 0), (3, 1), (1, 0), (40, 15)):
        for _ in range(60):
            text = "".join(rnd.choice("ab \n") if rnd.random() < 0.6 else "x" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 40)))
            assert list(chunking.windows(text, size, overlap)) == naive_windows(text, size, overlap)


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<noscript>a<noscript>b</noscript>c</noscript>d", "d"), ("a &lt;b&gt; &eacute;", "a <b> é"), ("<script>if (a < b) { '</p>' }</script>x", "x"), ("<style>p > a { }", ""),
        ("<p title='a > b'>x", "\nx"), ('<a href="x>y">z</a>', "z "), ("a<!-- <p>b</p> -->c", "ac"), ("<!doctype html><H1>T</H1>", "\nT "), ("a<br/>b", "a\n b"), ("a < b and 2<3", "a < b and 2<3"),
        ("<script>x", ""), ("<p", "\n"), ("<div><span>a</span><b>b</b></div>", "\na b  "), ("</noscript>a", "a"), (None, ""), ("<SCRIPT src='x'></SCRIPT >y", "y"), ("<li>one<li>two", "\none\ntwo"),
    ],
)
def test_html(markup, want):
    assert documents.html_text(markup) == want


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.html").write_text("<h1>T</h1><script>no</script><p>caf&eacute;")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-")
    (tmp_path / "c.htm").write_text("<style>x</style>")
    (tmp_path / "d.txt").write_text("x" * 2000)
    got = {r["filename"]: (r["text"], r["status"]) for r in documents.read_texts(spark, str(tmp_path), most_bytes=1500).collect()}
    assert got["a.html"] == ("\nT \ncafé", "ok") and got["c.htm"] == (None, "no readable text") and got["d.txt"] == (None, "over 1500 bytes")
    assert got["b.pdf"][0] is None and "PDF" in got["b.pdf"][1]

    class Reader:
        is_encrypted = False

        def __init__(self, file):
            names = {b"two": ["one", None], b"locked": ["x"], b"long": ["x"] * 1001}[file.read()]
            self.is_encrypted = names == ["x"]
            self.pages = [type("Page", (), {"extract_text": lambda self, t=t: t})() for t in names]

    assert documents.pdf_texts(b"two", Reader) == ["one", ""]
    for content, why in ((b"locked", "encrypted"), (b"long", "pages"), (b"else", "unreadable")):
        with pytest.raises(ValueError, match=why):
            documents.pdf_texts(content, Reader)


def test_settings():
    s = Settings.from_env({"LODESTONE_CHUNK_SIZE": "400", "LODESTONE_CRAG": "no", "LODESTONE_API_KEY": "secret", "OTHER": "1", "LODESTONE_DAMPING": "0.5"})
    assert (s.chunk_size, s.crag, s.damping) == (400, False, 0.5) and "secret" not in repr(s)
    for bad in ({"chunk_overlap": 450}, {"top_k": 13}, {"provider": "openai"}, {"embedding_provider": "ollama"}, {"base_url": "ftp://x"}, {"graph": "dfs"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings(embedding_provider="openai", embedding_model="m").space != Settings().space == "word-hash:384"


@pytest.fixture
def server():
    """Answers like model services do; what it was asked is in .asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body))
            if self.path == "/moved/embeddings":
                self.send_response(302)
                self.send_header("Location", "/embeddings")
                self.end_headers()
                return
            if self.path.endswith("embeddings"):
                out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path.endswith("embed"):
                out = {"embeddings": [[3.0, 4.0]] * (len(body["input"]) - self.path.startswith("/few"))}
            else:
                text = body["messages"][-1]["content"]
                answer = "not json" if "broken" in text else json.dumps({"claims": [{"text": "Redis fails over.", "source_id": "S1", "quote": "Redis fails over."}]})
                out = {"choices": [{"message": {"content": answer}}]}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    own = HTTPServer(("127.0.0.1", 0), Handler)
    own.asked = asked
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield own
    own.shutdown()


def test_services(spark, server):
    url = f"http://127.0.0.1:{server.server_port}"
    s = Settings(provider="openai", model="m", base_url=url, api_key="k", embedding_provider="openai", embedding_model="e", embedding_url=url, embedding_api_key="e-key")
    texts = ["x" * i for i in range(1, 71)]
    got = remote.vectors(texts, s)
    assert [v[0] / v[1] for v in got] == pytest.approx(range(1, 71)) and [len(a[2]["input"]) for a in server.asked] == [32, 32, 6] and server.asked[0][1] == "Bearer e-key"
    assert remote.vectors(["a"], Settings(embedding_provider="ollama", embedding_model="e", embedding_url=url)) == [[0.6, 0.8]]
    with pytest.raises(remote.ServiceError, match="number of vectors"):
        remote.vectors(["a"], Settings(embedding_provider="ollama", embedding_model="e", embedding_url=url + "/few"))
    with pytest.raises(remote.ServiceError) as e:
        remote.vectors(["a"], Settings(embedding_provider="openai", embedding_model="e", embedding_url=url + "/moved", embedding_api_key="e-key"))
    assert "e-key" not in str(e.value) and url not in str(e.value)
    rows = remote.embedded(spark.createDataFrame([(1, "abc"), (2, None)], "i int, text string"), s).collect()
    assert [v["vector"][0] / v["vector"][1] for v in rows] == pytest.approx([3, 0])
    q = spark.createDataFrame([(1, "how?", [("S1", "Redis fails over.")]), (2, "broken", [])], "qid int, question string, evidence array<struct<source_id:string,text:string>>")
    assert [(r["qid"], r["quote"], r["failed"]) for r in remote.drafts(q, s).orderBy("qid").collect()] == [(1, "Redis fails over.", False), (2, None, True)]


@pytest.mark.parametrize("content", ["[]", "{", '{"claims": [{}]}', '{"claims": [], "more": 1}', '{"claims": [{"text": "a", "source_id": "S1", "quote": "short"}]}', '{"claims": [{"text": "a", "source_id": "S1", "quote": "long enough", "x": 1}]}', "null", json.dumps({"claims": [{"text": "a", "source_id": "S1", "quote": "q" * 9}] * 9})])
def test_claims_schema(content):
    with pytest.raises(remote.ServiceError):
        remote.claims_of(content)


def test_claims_and_vectors():
    assert remote.claims_of('{"claims": []}') == [] and len(remote.claims_of(json.dumps({"claims": [{"text": "a", "source_id": "S1", "quote": "q" * 9}]}))) == 1
    assert remote.unit([3, 4]) == [0.6, 0.8] and remote.unit([0.0]) == [0.0]
    for bad in ([], [float("nan")], ["x"], None, [1.0] * 70000):
        with pytest.raises(remote.ServiceError):
            remote.unit(bad)


PAGES = "filename string, bytes long, page int, text string, status string"


def page(name, text):
    return (name, len(text), 1, text, "ok")


def test_ingest(spark, tmp_path):
    root, s = str(tmp_path / "index"), Settings()
    add = lambda rows, s=s: library.ingest(spark, root, spark.createDataFrame(rows, PAGES), s)
    assert add([page("a.txt", "one two"), page("b.txt", "three")]) == {"revision": 1, "added": 2, "replaced": 0, "unchanged": 0}
    assert add([page("b.txt", "three"), page("a.txt", "one two")]) == {"revision": 1, "added": 0, "replaced": 0, "unchanged": 2}
    assert add([page("a.txt", "one two"), page("b.txt", "four five"), page("c.txt", "six")]) == {"revision": 2, "added": 1, "replaced": 1, "unchanged": 1}
    _, t = store.load(spark, root)
    assert {r["text"] for r in t["passages"].collect()} == {"one two", "four five", "six"}
    assert add([page("a.txt", "one two")], Settings(chunk_size=500, chunk_overlap=10))["replaced"] == 1  # cut in another way
    with pytest.raises(ValueError, match="another model"):
        add([page("d.txt", "x")], Settings(embedding_provider="openai", embedding_model="m"))
    with pytest.raises(ValueError, match="at most"):
        add([page("d.txt", "x")], Settings(max_passages=3))
    with pytest.raises(ValueError, match="no passages"):
        add([page("d.txt", " ")])
    assert [(r["filename"], r["passages"]) for r in library.listed(spark, root).collect()] == [("a.txt", 1), ("b.txt", 1), ("c.txt", 1)]
    assert store.document(t["documents"], "b.txt").count() == 1 and store.document(t["documents"], "z").count() == 0
    with pytest.raises(KeyError):
        library.delete(spark, root, ["nothing"])
    ids = [r["document_id"] for r in library.listed(spark, root).collect()]
    assert library.delete(spark, root, ids) == 4 and library.listed(spark, root).count() == 0
    with pytest.raises(store.Conflict):
        store.publish(spark, root, {}, 3)
    assert store.load(spark, root)[1]["meta"].first()["space"] == ""


def test_late_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0])]
    p = spark.createDataFrame([(f"p{i}", d, v) for i, (d, v) in enumerate(rows)], "id string, document_id string, vector array<double>")
    got = {r["id"]: r["vector"] for r in library.in_context(p, 0.2).collect()}
    half = 0.2 * math.sqrt(0.5)
    size = math.hypot(0.8 + half, half)
    assert got["p0"] == pytest.approx([(0.8 + half) / size, half / size]) and got["p2"] == [1.0, 0.0]


def test_streams(spark, tmp_path):
    """Documents that come again in a later batch are replaced if they changed, else left alone."""
    root = str(tmp_path / "index")
    for k, rows in enumerate([[page("a.txt", "one two"), page("b.txt", "three")], [page("b.txt", "four"), page("a.txt", "one two")], [page("a.txt", "one two")]]):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start(spark.readStream.schema(PAGES).parquet(str(tmp_path / "in")), root, str(tmp_path / "log")).awaitTermination()
        assert store.load(spark, root)[0] == min(k + 1, 2)
    assert {r["text"] for r in store.load(spark, root)[1]["passages"].collect()} == {"one two", "four"}
    kind = "id string, created_at timestamp, payload string"
    spark.range(30).select(F.format_string("%02d", "id").alias("id"), F.timestamp_seconds("id").alias("created_at"), F.lit("{}").alias("payload")).write.parquet(str(tmp_path / "answers"))
    for _ in range(2):
        ingest.start_history(spark.readStream.schema(kind).parquet(str(tmp_path / "answers")), str(tmp_path / "history"), str(tmp_path / "log2"), 10).awaitTermination()
    assert sorted(r["id"] for r in store.load(spark, str(tmp_path / "history"), ("answers",))[1]["answers"].collect()) == [f"{i:02d}" for i in range(20, 30)]
    spark.range(40).select(F.col("id").cast("string").alias("entry_id"), F.timestamp_seconds(F.col("id") * 10).alias("stored_at")).write.parquet(str(tmp_path / "entries"))
    ingest.start_entries(spark.readStream.schema("entry_id string, stored_at timestamp").parquet(str(tmp_path / "entries")), str(tmp_path / "cache"), str(tmp_path / "log3"), 100).awaitTermination()
    assert {int(r["entry_id"]) for r in store.load(spark, str(tmp_path / "cache"), ("entries",))[1]["entries"].collect()} == set(range(30, 40))


def test_cache_keeps_what_is_used(spark):
    kind = "entry_id int, used_at int"
    e = store.put(spark.createDataFrame([(i, i) for i in range(5)], kind), spark.createDataFrame([(9, 9)], kind), 4)
    assert {r["entry_id"] for r in e.collect()} == {9, 4, 3, 2}
    e = store.put(store.touched(e, spark.createDataFrame([(2,)], "entry_id int"), F.lit(20)), spark.createDataFrame([(10, 10)], kind), 4)
    assert {r["entry_id"] for r in e.collect()} == {10, 9, 4, 2}
    s = store.cache_stats(spark.createDataFrame([("exact",), ("semantic",), (None,), (None,)], "kind string")).first()
    assert (s["exact_hits"], s["semantic_hits"], s["misses"], s["hit_rate"]) == (1, 1, 2, 0.5)


def test_clusters():
    v = np.array([[1, 0], [0, 1], [0.9, 0.1], [0, 0.9], [1, 0.05], [0.99, 0], [-1, 0]], dtype=float)
    d = np.zeros(7)
    assert tree.grouped(v, d, size=3) == [[0, 4, 5], [1, 3, 2, 6]]  # the last finds none and joins the last cluster
    assert tree.grouped(v[:3], d[:3], size=3) == [[0, 1, 2]] and tree.grouped(v[:0], d[:0]) == []


def test_summary_layers(spark):
    texts = [f"Sentence number {i} about redis. Sentence number {i} about redis. short" for i in range(9)]
    rows = [(f"p{i}", "d", "a.txt", t, 1, i * 100, i * 100 + 90, [1.0, 0.0]) for i, t in enumerate(texts)]
    p = spark.createDataFrame(rows, "id string, document_id string, filename string, text string, page int, start int, end int, vector array<double>")
    got = tree.layers(p, size=4).orderBy("layer").collect()
    assert [(r["layer"], len(r["members"]), r["page"]) for r in got][:1] == [(1, 4, 0)] and [r["layer"] for r in got] == [1, 1, 2]
    first = next(r for r in got if r["members"] == ["p0", "p1", "p2", "p3"])
    assert first["text"] == "[RAPTOR L1 Summary] " + " ".join(f"Sentence number {i} about redis." for i in range(4))
    assert first["vector"] == [1.0, 0.0] and first["id"].startswith("raptor:L1:") and tree.expanded(p).count() == 12


def test_graph_channel(spark):
    names = [("Redis", "redis"), ("redis cluster", "redis"), ("Sentinel", "sentinel"), ("Kafka", "kafka"), ("Zoo", "zoo")]
    n = spark.createDataFrame(names, "entity string, canonical string")
    q = spark.createDataFrame([(1, "What is a redis cluster?"), (2, "zebra"), (3, "kafka and zoo")], "qid int, text string")
    s = graph.seeds(n, q)
    assert {tuple(r) for r in s.collect()} == {(1, "redis"), (3, "kafka"), (3, "zoo")}
    of = spark.createDataFrame([("redis", "p1"), ("sentinel", "p1"), ("sentinel", "p2"), ("kafka", "p2"), ("zoo", "p3")], "entity string, id string")
    e = graph.both_ways(graph.edges(of))
    got = {(r["qid"], r["id"]): (r["score"], r["path"]) for r in graph.path_scores(of, graph.reached(e, s)).collect()}
    assert got[1, "p1"] == (1.0, ["redis"]) and got[1, "p2"] == (0.5, ["redis", "sentinel"]) and got[3, "p3"] == (1.0, ["zoo"]) and (1, "p3") not in got
    assert graph.reached(e, s.where("qid = 1"), most=2).count() == 2
    ranks = {(r["qid"], r["id"]): (r["score"], r["path"]) for r in graph.associated(e, of, s).collect()}
    assert max(v[0] for k, v in ranks.items() if k[0] == 1) == 1.0 and ranks[1, "p2"][1][0] == "redis"


def test_walks_of_several_questions(spark):
    """Each question's ranks are those of a walk alone, also where it swings between two sides."""
    edges = [("a", "b", 1.0), ("b", "a", 1.0), ("c", "d", 2.0), ("d", "c", 2.0), ("d", "e", 1.0)]
    start = [(1, "a", 1.0), (2, "c", 1.0), (2, "d", 1.0), (3, "nowhere", 1.0)]
    got = {(r["qid"], r["entity"]): r["rank"] for r in graph.walk_ranks(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(start, "qid int, entity string, weight double"), rounds=7).collect()}
    for qid, p in ((1, {"a": 1.0}), (2, {"c": 0.5, "d": 0.5})):
        r = {n: p.get(n, 0.0) for n in "abcde"}
        for _ in range(7):
            new = {n: (0.15 + 0.85 * r["e"]) * p.get(n, 0.0) for n in r}
            for s, t, w in edges:
                new[t] += 0.85 * r[s] * w / sum(x for y, _, x in edges if y == s)
            r = new
        assert {n: v for (q, n), v in got.items() if q == qid and v > 0} == pytest.approx({n: v for n, v in r.items() if v > 0})
    assert not any(q == 3 for q, _ in got)


def test_community_evidence(spark):
    r = spark.createDataFrame([("x", ["A", "B"], "A & B", "said"), ("y", ["C"], "C Cluster", "more")], "label string, hubs array<string>, title string, summary string")
    held = spark.createDataFrame([("x", "p1"), ("x", "p2"), ("y", "p1"), ("y", "p3")], "label string, id string")
    m = spark.createDataFrame([(1, 1, "x", 2.0), (1, 2, "y", 1.0), (2, 1, "y", 1.0)], "qid int, rank int, label string, score double")
    got = {(x["qid"], x["position"]): (x["id"], x["relevance"]) for x in communities.evidence(r, held, m).collect()}
    assert got == {(1, 1): ("p1", 0.9), (1, 2): ("p3", 0.85), (2, 1): ("p1", 0.85)}


def test_lookup_of_names(spark):
    c = resolution.resolved(spark.createDataFrame([("Redis",), ("redis cluster",), ("kafka",)], "entity string"))
    got = {r["name"]: (r["canonical"], r["confidence"]) for r in resolution.looked_up(spark.createDataFrame([("Redis  Clusters",), ("KAFKA",), ("new",)], "name string"), c).collect()}
    assert got == {"Redis  Clusters": ("redis", 0.98), "KAFKA": ("kafka", 1.0), "new": ("new", 1.0)}
    assert {r["canonical"]: r["forms"] for r in resolution.aliases(c).collect()} == {"redis": ["redis", "redis cluster"], "kafka": ["kafka"]}


def test_bridges(spark):
    q = spark.createDataFrame([(1, "Which store does Atlas use and how does it handle failover?", "hybrid")], "qid int, text string, mode string")
    e = spark.createDataFrame([(1, 1, "Atlas keeps jobs in Redis Cluster. The Redis Cluster is fast."), (1, 2, "Section Two names Kafka. Redis Cluster again.")], "qid int, position int, text string")
    got = hops.bridges(q, e).orderBy("rank").collect()
    assert got[0]["name"] == "redis cluster" and got[0]["worth"] == 6 and [r["rank"] for r in got] == [1, 2, 3]
    again = hops.next_questions(q, e).first()
    assert again["text"] == "How does redis cluster handle failover?"
    kind = "qid int, id string, position int, source_id string, relevance double, path array<string>"
    a = spark.createDataFrame([(1, "p1", 1, "S1", 0.5, None), (1, "p2", 2, "S2", 0.4, ["x"])], kind)
    b = spark.createDataFrame([(1, "p2", 1, "S1", 0.9, []), (1, "p3", 2, "S2", 0.45, [])], kind)
    got = hops.merged(a, b, 1).orderBy("position").collect()
    assert [(r["id"], r["source_id"], r["path"]) for r in got] == [("p1", "S1", ["multihop:hop_1"]), ("p3", "S2", ["multihop:hop_2"]), ("p2", "S3", ["x", "multihop:hop_1"])]


CLAIMS = "qid int, position int, source_id string, text string, quote string"
HELD = "qid int, source_id string, passage string"


def test_claims_in_doubt(spark):
    e = spark.createDataFrame([(1, "S1", "Redis fails over by itself. Kafka keeps a log.")], HELD)
    rows = [(1, 0, "S1", "Redis fails over by itself.", "Redis fails over"), (1, 1, "S9", "Kafka keeps a log.", "Kafka"), (1, 2, "S1", "zebra", "Redis fails over"), (1, 3, "S1", " ", "x"), (1, 4, "S1", "Redis", " "), (1, 5, "S1", "the", "Kafka")]
    c = spark.createDataFrame(rows, CLAIMS)
    assert [r["uncertain"] for r in answers.uncertain(c, e).orderBy("position").collect()] == [False, True, True, False, True, False]
    assert [r["position"] for r in lookahead.doubted(c, e).orderBy("position").collect()] == [1, 2]


def test_lookups(spark):
    kind = "qid int, position int, source_id string, id string, text string, relevance double"
    evidence = spark.createDataFrame([(1, 1, "S1", "p1", "Redis fails over by itself.", 0.9)], kind)
    claims = spark.createDataFrame([(1, 0, "S1", "Redis fails over by itself.", "Redis fails over by itself."), (1, 1, "S7", "Kafka keeps a log of events.", ""), (1, 2, "S7", "zebra stripes", "")], CLAIMS)
    pool = [("p2", "Noise. Kafka keeps a log of events. More.", 0.7), ("p1", "Redis fails over by itself.", 0.2)]

    def search(asked):
        rows = asked.select("qid", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("position"), F.lit(f"S{k + 1}").alias("source_id"), F.lit(i).alias("id"), F.lit(t).alias("text"), F.lit(r).alias("relevance")) for k, (i, t, r) in enumerate(pool)])).alias("e"))
        return rows.select("qid", "e.*")

    out, full, trace = lookahead.looked_up(claims, evidence, search)
    got = {r["position"]: (r["source_id"], r["quote"]) for r in out.collect()}
    assert got == {0: ("S1", "Redis fails over by itself."), 1: ("S2", "Kafka keeps a log of events."), 2: ("S7", "")}
    assert [(r["source_id"], r["id"]) for r in full.orderBy("position").collect()] == [("S1", "p1"), ("S2", "p2")]
    assert {r["position"]: (r["grounded"], r["relevance"]) for r in trace.collect()} == {1: (True, 0.7), 2: (False, 0.0)}


def test_rescue_and_pruning(spark):
    e = spark.createDataFrame([(q, "S1", "Redis fails over by itself.") for q in (1, 2, 3)], HELD)
    good, bad = ("S1", "Redis fails over.", "Redis fails over by itself."), ("S1", "Zebras are striped.", "not there")
    drafts = spark.createDataFrame([(1, 0, *good), (2, 0, *bad), (2, 1, *good), (4, 0, *bad)], CLAIMS)
    fallback = spark.createDataFrame([(1, 0, *bad), (2, 0, *good), (3, 0, *good), (4, 0, *bad)], CLAIMS)
    got = sorted((r["qid"], r["position"], r["text"], r["rescued"]) for r in answers.rescued(drafts, fallback, e).collect())
    assert got == [(1, 0, good[1], False), (2, 0, good[1], True), (3, 0, good[1], True), (4, 0, bad[1], False)]
    kept = answers.supported_only(drafts, e).collect()
    assert sorted((r["qid"], r["position"], r["support"]) for r in kept) == [(1, 0, "fully"), (2, 1, "fully"), (4, 0, "none")]
    w = answers.weak(spark.createDataFrame([(1,), (2,), (3,)], "qid int"), spark.createDataFrame([(1, 0.5), (2, 0.1)], "qid int, relevance double"))
    assert {r["qid"]: r["weak"] for r in w.collect()} == {1: False, 2: True, 3: True}


def test_service(spark, tmp_path):
    s = Service(spark, str(tmp_path / "index"))
    assert s.demo()["added"] == 4 and s.health() == {"revision": 1, "documents": 4, "passages": 4}
    asked = spark.createDataFrame([(i, q, "hybrid") for i, (q, _) in enumerate(demo.QUESTIONS)] + [(9, demo.UNKNOWN, "auto")], "qid int, text string, mode string")
    got = {r["qid"]: r for r in s.ask(asked).collect()}
    for i, (_, name) in enumerate(demo.QUESTIONS):
        assert got[i]["status"] == "supported" and name in {e["filename"] for e in got[i]["evidence"]}
        for c in got[i]["claims"]:
            assert c["quote"] in next(e["text"] for e in got[i]["evidence"] if e["source_id"] == c["source_id"])
    assert got[9]["status"] == "abstained" and got[9]["claims"] == [] and got[9]["confidence"] == 0
    again = s.ask_one("what HAPPENS to bookings when Gull  Gateway fails?")
    assert again["cached"] and again["answer"] == got[1]["answer"] and s.cache_stats()["exact_hits"] == 1
    assert s.history().count() == 7 and json.loads(s.export(s.ask(asked.where("qid = 0"))).first()["json"])["status"] == "supported"
    nodes, edges = s.graph()
    assert "tide ledger" in {r["entity"] for r in nodes.collect()} and edges.count() > 0 and s.communities().count() > 0 and s.aliases().count() > 0
    with pytest.raises(ValueError):
        s.ask_one("  ")
    with pytest.raises(ValueError):
        s.ask_one("x", "sideways")
    s.cache_clear()
    assert s.cache_stats()["size"] == 0
