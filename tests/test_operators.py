"""Core operators against plain simulations and inline fixtures."""

import json
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.config import EngineConfig
from marginalia.operators import chunking as C
from marginalia.operators import conversation as V
from marginalia.operators import goldens, layout, links, metrics, normalize, providers
from marginalia.operators import html as H
from marginalia.operators import retrieval as R
from marginalia.plans import pipeline
from marginalia.sources import corpus
from marginalia.streaming import jobs

BODY = "intro text\n\n<!-- loc page=1 -->\n# One\nPara a.\n\n```\n# not a heading\n| x |\n```\n\n| a | b |\n| c | d |\nafter\n\n<!-- loc page=2 -->\n## Two\n$$x$$ tail\n--- [FIGURE] ---\nfig\n--- [/FIGURE] ---\n"


def test_segments_and_sections():
    assert [s.kind for s in C.segments(BODY)] == ["prose", "page", "prose", "code_block", "prose", "table", "prose", "page", "prose", "formula", "prose", "figure", "prose"]
    got = C.sections(BODY)
    assert [(s.no, s.title, s.page_start, s.page_end) for s in got] == [(0, "preambule", 1, 1), (1, "One", 1, 2), (2, "Two", 2, 2)]


@pytest.mark.parametrize("n", [399, 400, 401, 749, 750, 751])
def test_paragraph_limits(n):
    text = ("word " * n)[: n - 1] + "."
    assert C.prose_units(text, 750) == ([text + "\n\n"] if n <= 750 else [text + "\n\n"])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab. ", min_size=1, max_size=300), max_size=12))
def test_chunks_keep_all_prose(paragraphs):
    text = "\n\n".join(paragraphs)
    chunks = C.pack([C.Segment("prose", text, None)])
    flat = lambda t: "".join(t.split())
    assert flat("".join(c.text for c in chunks)) == flat(text)
    assert all(c.kind == "prose" for c in chunks)


def test_chunking_documents(spark):
    docs = spark.createDataFrame([("k", "doc", "pdf", None, None, "doc.pdf", BODY), ("e", "none", "web", None, None, None, None)], "doc_key string, source string, source_type string, source_url string, title string, source_id string, body string")
    parents, children = C.chunk(docs)
    assert [r["parent_id"] for r in parents.orderBy("sec_no").collect()] == ["doc__sec000", "doc__sec001", "doc__sec002"]
    first = children.where("child_id = 'doc__sec001__c000'").first()
    assert first["embed_text"].startswith("[doc | One | page 1]\n# One") and first["child_type"] == "code_block+prose+table"


def _brute_bm25(docs, queries, k):
    toks = {i: t.lower().split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for q, text in queries:
        scores = {}
        for i, t in toks.items():
            c = Counter(t)
            if set(text.lower().split()) & set(t):
                scores[i] = round(sum((idf[w] if idf[w] >= 0 else eps) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.lower().split() if w in c), 6)
        out[q] = sorted(scores, key=lambda i: (-scores[i], i))[:k]
    return out


def test_bm25_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i:03d}", " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(80)] + [("e", "")]
    queries = [(i, " ".join(rng.choices(words, k=4))) for i in range(10)]
    got = R.bm25_topk(spark.createDataFrame(docs, "child_id string, text string").repartition(3), spark.createDataFrame(queries, "qid long, question string"), 5)
    by: dict[int, list] = {}
    for r in got.orderBy("qid", "rank").collect():
        by.setdefault(r["qid"], []).append(r["child_id"])
    want = _brute_bm25(docs, queries, 5)
    assert by == {q: w for q, w in want.items() if w}


def test_vector_search_skips_bad_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [0.9, 0.1])], "vec_id long, embedding array<double>")
    got = R.vector_topk(v, v.where("vec_id = 1").select(F.col("vec_id").alias("qid"), "embedding"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(2, 1), (5, 2)]


def test_round_robin_equals_a_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for q in range(30):
        lists = [rng.sample(range(8), rng.randint(0, 5)) for _ in range(3)]
        rows += [(q, i, j + 1, f"p{p}", 1.0) for i, x in enumerate(lists) for j, p in enumerate(x)]
        seen = []
        for j in range(5):
            for x in lists:
                if j < len(x) and x[j] not in seen and len(seen) < 4:
                    seen.append(x[j])
        want[q] = [f"p{p}" for p in seen]
    got = R.round_robin(spark.createDataFrame(rows, "qid long, q_idx int, rank int, parent_id string, score double")).orderBy("qid", "position").collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["qid"], []).append(r["parent_id"])
    assert by == {q: w for q, w in want.items() if w}


def test_calibration_equals_a_sweep(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = [(round(rng.random(), 1), rng.random() < 0.5) for _ in range(30)] + [(float("nan"), True), (None, False)]
        clean = [(s, u) for s, u in rows if s is not None and s == s]
        best = max(((sum((s < t) == u for s, u in clean) / len(clean), -t) for t in {s for s, _ in clean}))
        r = metrics.calibrate(spark.createDataFrame(rows, "score double, unanswerable boolean")).first()
        assert (r["accuracy"], -r["threshold"]) == best
    assert metrics.calibrate(spark.createDataFrame([], "score double, unanswerable boolean")).count() == 0


def test_ranking_metrics(spark):
    rows = [(1, 1, 0.1, 1), (1, 2, 0.2, 1), (1, 3, 0.9, 1), (2, 1, 0.0, 1), (3, 1, 0.5, 0)]
    r = {x["qid"]: x for x in metrics.ranking(spark.createDataFrame(rows, "qid long, rank int, relevance double, n_gold int")).collect()}
    assert r[1]["hit"] == 1 and r[1]["rr"] == 1 / 3 and r[1]["precision"] == 1 / 3
    assert r[2]["ndcg"] == 0 and r[3]["hit"] is None


def test_bootstrap(spark):
    s = spark.createDataFrame([("m", 0.0)] * 50 + [("m", 1.0)] * 50 + [("one", 0.5), ("m", None)], "metric string, score double")
    r = {x["metric"]: x for x in metrics.bootstrap(s).collect()}
    assert r["one"]["lower"] == r["one"]["upper"] == 0.5 and r["m"]["n"] == 100
    assert 0.35 < r["m"]["lower"] < 0.45 < 0.55 < r["m"]["upper"] < 0.65
    assert metrics.bootstrap_sequential([]) == (None, None, None)


def test_gate(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    h = spark.createDataFrame([(1, 0.05), (1, 0.5), (2, 0.05)], "qid long, score double")
    assert {r["qid"]: r["refuse"] for r in metrics.gate(h, q, 0.1119).collect()} == {1: False, 2: True, 3: True}
    assert {r["qid"]: r["refuse"] for r in metrics.gate(h, q, 0.1119, active=False).collect()} == {1: False, 2: False, 3: True}


def test_normalising(spark):
    one = lambda make, t: spark.createDataFrame([(t,)], "t string").select(make(F.col("t"))).first()[0]
    assert one(normalize.unify_headers, "1.1- Title\n1- Title 2\n3.10.2-.1 X\n# y") == "### 1.1- Title\n1- Title 2\n##### 3.10.2-.1 X\n# y"
    assert one(normalize.drop_exercises, "a\n## 2. Exercises\nx\n## Next\nb\n# Problems\nz") == "a\n## Next\nb\n"
    assert one(normalize.links_to_text, "![a](b) [c](d)") == "![a](b) c"
    assert one(normalize.unify_math, r"\[x\] \(y\) \vx") == r"$$x$$ $y$ \mathbf{x}"
    assert one(normalize.tidy, "café  \n\n\n\nb\n") == "café\n\nb\n"
    assert one(normalize.galleries_to_captions, "![a](b) |\n![](c)\n| one | two |\n") .startswith("*(figure — one ; two)*")
    assert one(normalize.unify_tables, "<table><tr><th>a</th></tr><tr><td>b|c</td><td>d</td></tr></table>") == "| a |  |\n| --- | --- |\n| b\\|c | d |"
    assert one(normalize.clean_web, None) is None


def test_front_matter(spark):
    rows = [("a", "---\ntitle: T\nsource_type: web\n---\n\nbody"), ("b", "no block"), ("c", "---\nsource_type: odd\n---\n<!-- page 3 -->\nx"), ("d", "---\n: [broken\n---\nx"), ("e", " ")]
    d = {r["source"]: r for r in corpus.documents(spark.createDataFrame(rows, "source string, raw string")).collect()}
    assert (d["a"]["source_type"], d["a"]["title"], d["a"]["body"]) == ("web", "T", "body\n")
    assert d["b"]["source_type"] == "pdf" and d["c"]["source_type"] == "pdf" and d["d"]["source_type"] == "web"
    assert d["e"]["error"] == "empty file" and d["e"]["body"] is None


def test_html():
    root = H.parse('<body><nav>menu</nav><main><h1>T¶</h1><p>a <b>b</b><p>c<ul><li>one<li>two</ul><pre class="language-py">x = 1\n</pre><script>"</p>"</script></main>')
    assert H.to_markdown(H._main(root)) == "# T\n\na **b**\n\nc\n\n- one\n- two\n\n```py\nx = 1\n```"
    m = H.parse("<math><mfrac><mi>a</mi><msqrt><mi>λ</mi></msqrt></mfrac><msubsup><mo>∑</mo><mi>i</mi><mn>2</mn></msubsup></math>").first("math")
    assert H.mathml_to_latex(m) == r"\frac{a}{\sqrt{λ}}\sum_{i}^{2}"
    m = H.parse("<math><mrow><mi>ℝ</mi><mo>∉</mo><mfenced><mi>x</mi><mo>−</mo><mn>1</mn></mfenced><mo>\u2062</mo><mroot><mi>y</mi><mn>3</mn></mroot><mtext>if so</mtext><msup><mi>z</mi></msup></mrow><annotation>no</annotation></math>").first("math")
    assert H.mathml_to_latex(m) == r"\mathbb{R}\notin\left(x-1\right)\sqrt[3]{y}\text{if so}z"
    assert H.table_to_markdown("<table></table>") == "<table></table>"


def test_strategies_are_found_by_domain():
    @H.register("book.test")
    def read(root, url):
        return H.book(root, url)

    assert H.strategy_for("www.book.test") is read and H.strategy_for("x.book.test") is read and H.strategy_for("other.test") is H.article
    text, meta = H.book(H.parse('<title>2.3. Layers — Book</title><main><div class="tab-pane active">yes</div><div class="tab-pane">no</div></main>'), "u")
    assert meta["section_number"] == "2.3" and meta["chapter"] == "2" and "no" not in text


def test_crawl_budget_and_failures(spark):
    site = spark.createDataFrame([("https://s.test/", '<a href="/a">a</a><a href="/b#x">b</a><a href="/f">f</a>'), ("https://s.test/a", '<a href="/">back</a>'), ("https://s.test/b", "x"), ("https://s.test/f", None)], "url string, html string")
    got = links.crawl(spark.createDataFrame([("https://s.test/#top",)], "url string"), lambda f: f.join(site, "url", "left"), max_pages=2)
    assert sorted((r["url"], r["level"]) for r in got.collect()) == [("https://s.test/", 0), ("https://s.test/a", 1)]


def test_captions(spark):
    d = spark.createDataFrame([("Figure 2: x\nTable 1\nFIGURE 3 y", "figure 3 y", "FIG 3 Y\nab\nabc\nab\n```\nno")], "t string, c string, raw string")
    r = d.select(layout.caption_lines(F.col("t")).alias("l"), layout.find_line(F.split("t", "\n"), F.col("c")).alias("at"), layout.clean_caption(F.col("raw")).alias("k"), layout.insert_figure(F.col("t"), F.col("c"), F.lit("BLOCK")).alias("i")).first()
    assert spark.range(1).select(layout.is_composite(F.array(F.lit("(a) x"), F.lit("(b) y"), F.lit("z"))), layout.is_composite(F.array(F.lit("(a) x")))).first()[:] == (True, False)
    assert r["l"] == ["Figure 2: x", "FIGURE 3 y"] and r["at"] == 3 and r["k"] == "FIG 3 Y\nab\nabc" and r["i"].endswith("BLOCK")


def _turns(n):
    return [(1, i, "student" if i % 2 == 0 else "tutor", f"turn {i}") for i in range(n)]


@pytest.mark.parametrize("n", [6, 11, 12, 13, 24])
def test_memory_compresses_at_twice_the_window(spark, n):
    r = V.compressed(spark.createDataFrame(_turns(n), "conv_id long, turn int, role string, text string")).first()
    m = V.Memory()
    for _, _, role, text in _turns(n):
        m.add(role, text)
        if role == "tutor":
            m.compress()
    assert (r["n_kept"], r["summary"], r["history"]) == (len(m.turns), m.summary, m.history())
    assert bool(m.summary) == (n >= 12)


def test_memory_falls_back_and_checks_roles():
    def fails(a, b):
        raise RuntimeError

    m = V.Memory(1, 3, fails)
    with pytest.raises(ValueError):
        m.add("system", "x")
    m.add("student", "a b c d e")
    m.add("tutor", "y")
    assert m.compress() and m.summary == "Student : a..."
    assert V.within_budget("", [("student", "w " * 50)] * 4, 10).count("Student") == 2


def test_streamed_memory_equals_the_batch(spark, tmp_path):
    rows = [(c, i, r, t) for c in (1, 2) for _, i, r, t in _turns(9)]
    schema = "conv_id long, turn int, role string, text string"
    batch = V.compressed(spark.createDataFrame(rows, schema), window=2)
    for k, lo in enumerate(range(0, 9, 3)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if k == 0:
            source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
            query = jobs.remember(source, window=2).writeStream.format("memory").queryName("memory_out").outputMode("update").start()
        query.processAllAvailable()
    query.stop()
    last = spark.sql("select conv_id, max_by(struct(n_turns, n_kept, summary, history), n_turns) s from memory_out group by conv_id").collect()
    assert {r["conv_id"]: tuple(r["s"]) for r in last} == {r["conv_id"]: (r["n_turns"], r["n_kept"], r["summary"], r["history"]) for r in batch.collect()}


def test_files_stream_into_the_index(spark, tmp_path):
    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "one.md").write_text("---\nsource_type: web\n---\n# H\n\nText.")
    run = lambda: jobs.ingest(spark, str(folder), str(tmp_path / "c"), str(tmp_path / "p"), str(tmp_path / "k")).awaitTermination(120)
    run()
    (folder / "two.md").write_text("# G\n\nMore.")
    run()
    run()
    assert sorted(r["source"] for r in corpus.read_index(spark, str(tmp_path / "p")).collect()) == ["one", "two"]
    with pytest.raises(corpus.NotIndexed):
        corpus.read_index(spark, str(tmp_path / "nothing"))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.md").write_text("x")
    (tmp_path / "p.html").write_bytes(b"<p>\xff ok</p>")
    assert corpus.markdown_files(spark, str(tmp_path)).first()["source"] == "a b"
    assert "ok" in corpus.html_files(spark, str(tmp_path)).first()["html"]
    (tmp_path / "g.json").write_text(json.dumps({"goldens": [{"input": "q", "expected_output": "r", "context": ["c"], "additional_metadata": {"category": "x"}}, {"question": "", "input": "z"}]}))
    got = goldens.read(spark, str(tmp_path / "g.json")).collect()
    assert [(r["question"], r["reference"], r["gold_context"], r["category"]) for r in got] == [("q", "r", ["c"], "x"), ("z", None, [], None)]
    for _ in range(2):
        corpus.append_run(spark.createDataFrame([("m", 1.0)], "metric string, value double"), str(tmp_path / "runs"), "d", {"mode": "dense"})
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


def test_providers(spark):
    class Flaky(providers.OfflineEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return super().embed(texts)

    d = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, ""), (4, "a b")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in providers.embed(d, "id", "t", Flaky(8)).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    tries = []
    with pytest.raises(ValueError):
        providers.with_retries(lambda: tries.append(1) or int("x"), 3, 0)
    assert len(tries) == 3


def test_pipeline_end_to_end(spark):
    p = spark.createDataFrame([("p1", "s", "web", "Layers", "https://h.test/a", "T", None, "A gated layer keeps the signal. It is small."), ("p2", "s", "pdf", "Loss", None, None, "x.pdf", "The loss falls. Bread is old.")], "parent_id string, source string, source_type string, section string, source_url string, title string, source_id string, text string")
    c = p.select(F.concat("parent_id", F.lit("__c000")).alias("child_id"), "parent_id", "text", "source_type")
    q = spark.createDataFrame([(1, "What does a gated layer keep?"), (2, "zzz qqq")], "qid long, question string")
    out = {r["qid"]: r for r in pipeline.answer(q, c, p, providers.OfflineChat(), threshold=0.3).collect()}
    assert not out[1]["refused"] and "gated layer" in out[1]["answer"] and out[2]["refused"] and out[2]["contexts"] == []
    gold = spark.createDataFrame([(1, ["A gated layer keeps the signal"], "single_passage"), (2, [], "unanswerable")], "qid long, gold_context array<string>, category string")
    answers = spark.createDataFrame([(q_, r["answer"]) for q_, r in out.items()], "qid long, answer string")
    hits = spark.createDataFrame([(1, 1, "A gated layer keeps the signal. It is small.")], "qid long, rank int, text string")
    total = pipeline.evaluate(answers, gold, hits).where("level = 1").first()
    assert total["hit"] == 1.0 and (total["tp"], total["fp"], total["fn"], total["tn"]) == (1, 0, 0, 1)


def test_config_is_frozen():
    with pytest.raises(AttributeError):
        EngineConfig().child_target = 1
