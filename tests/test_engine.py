"""Engines, providers, reports, recognised pages, crawling manners and stores."""

import itertools
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators import chunking, citations, conversation, goldens, layout, links, metrics, providers, reports
from marginalia.operators import html as H
from marginalia.operators import retrieval as R
from marginalia.plans import fixtures, pipeline, quality, search
from marginalia.sources import corpus, recognised


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.booleans()), max_size=40))
def test_chunk_numbers_equal_a_walk(units):
    rows = [(n, 750 if prose else 400) for n, prose in units]
    want, number, size, shut = [], 0, 0, False
    for n, limit in rows:
        if shut or size and size + n > 400:
            number, size = number + 1, 0
        size += n
        shut = size >= limit
        want.append(number)
    assert chunking.chunk_numbers(rows, 400) == want


def test_page_marks_before_a_heading_belong_to_the_section_before():
    got = chunking.sections("<!-- loc page=1 -->\n<!-- loc page=2 -->\na\n<!-- loc page=3 -->\n# One\nb\n")
    assert [(s.title, s.page_start, s.page_end, len(s.segments)) for s in got] == [("preambule", 1, 3, 3), ("One", 3, 3, 1)]  # the blank between two marks is text of the first page
    assert chunking.sections("<!-- loc page=1 -->") == [] and chunking.sections("") == []


@pytest.fixture(scope="module")
def small(spark):
    p = spark.createDataFrame([(f"p{i}", "s", "web", f"S{i}", "https://h.test/a", "T", None, f"A gated layer {i} keeps the signal.") for i in range(6)], "parent_id string, source string, source_type string, section string, source_url string, title string, source_id string, text string")
    c = p.select(F.concat("parent_id", F.lit("__c000")).alias("child_id"), "parent_id", "text", "source_type")
    return c, p, spark.createDataFrame([(1, "gated layer 3"), (2, "keeps")], "qid long, question string")


def test_an_engine_answers_like_the_functions(small):
    c, p, q = small
    e = R.Engine(c, p)
    rows = lambda df: sorted((r["qid"], r["rank"], r["parent_id"], r["score"]) for r in df.collect())
    for mode in ("dense", "hybrid", "hybrid_rerank"):
        assert rows(e.retrieve(q, mode)) == rows(R.retrieve(c, p, q, mode))
    assert e.stats is e.stats and e.stats.n == 6


class Odd:
    available = True

    def score(self, pairs):
        if any("4" in t for _, t in pairs):
            raise RuntimeError("broken")
        return [1.0 if "2" in t else 0.1 for _, t in pairs]


def test_reranking_with_a_scorer(small):
    c, p, q = small
    fused = R.rrf(R.cosine_topk(c, q), R.bm25_topk(c, q), c)
    best = lambda s: [r["parent_id"] for r in R.rerank(fused, q, scorer=s).where("qid = 2").orderBy("rank").collect()]
    before = [r["parent_id"] for r in fused.where("qid = 2").orderBy("rank").collect()]
    assert best(providers.Unavailable()) == before
    one = [r["parent_id"] for r in R.rerank(fused.where("not contains(text, '4')"), q, scorer=Odd()).where("qid = 2").orderBy("rank").collect()]
    assert one[0] == "p2"


def test_a_scorer_that_cannot_be_loaded_is_unavailable():
    purged: list[int] = []

    def broken():
        raise OSError

    assert not providers.load_scorer(broken, lambda: purged.append(1), wait=0).available and len(purged) == 3
    tries = iter([broken, broken, Odd])
    assert providers.load_scorer(lambda: next(tries)(), wait=0).available


class _Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/missing":
            self.send_error(404)
            return
        self.send_response(200)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write("<meta charset='latin-1'><p>caf\xe9</p>".encode("latin-1"))

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if asked["model"] == "none":
            self.send_error(404)
            return
        self.send_response(200)
        self.end_headers()
        said = asked["messages"][1]["content"].split()
        if asked["stream"]:
            for w in said:
                self.wfile.write(json.dumps({"message": {"content": w + " "}}).encode() + b"\n")
            self.wfile.write(b'{"done": true}\n')
        else:
            self.wfile.write(json.dumps({"message": {"content": " ".join(said)}}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_chat_over_http(server):
    chat = providers.HttpChat(server, "some")
    assert chat.complete("be brief", "one two") == "one two"
    seen: list[str] = []
    assert conversation.tell(pipeline.answer_stream("q", "c d", chat, "before"), seen.append) == "before q c d " and len(seen) == 4
    with pytest.raises(providers.ModelMissing):
        providers.HttpChat(server, "none").complete("", "x")


def test_fetching_and_local_pages(spark, server, tmp_path):
    assert "café" in links.fetch_page(server + "/a")
    got = {r["url"]: r["html"] for r in links.fetcher()(spark.createDataFrame([(server + "/a",), (server + "/missing",)], "url string")).collect()}
    assert "café" in got[server + "/a"] and got[server + "/missing"] is None
    assert links.fetch_page("x:", render=lambda u, t: f"{u} {t}") == "x: 20.0"
    (tmp_path / "p.html").write_bytes(b"<main><h1>T</h1><p>caf\xff</p></main>")
    r = corpus.page(spark, file=str(tmp_path / "p.html"), canonical="https://h.test/x/p.html").first()
    assert r["source_url"] == "https://h.test/x/p.html" and r["body"].startswith("# T")
    assert "café" in corpus.page(spark, url=server + "/a").first()["body"]
    with pytest.raises(ValueError):
        corpus.page(spark)


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.test/x",), ("https://a.test/private/y",), ("https://b.test/private/y",), ("not an address",)], "url string")
    files = spark.createDataFrame([("https://a.test/robots.txt", "User-agent: *\nDisallow: /private")], "url string, html string")
    rules = links.robots(urls, lambda f: f.join(files, "url", "left"))
    assert rules.count() == 2
    assert {r["url"] for r in links.allowed(urls, rules).collect()} == {"https://a.test/x", "https://b.test/private/y", "not an address"}
    site = spark.createDataFrame([("https://a.test/", '<a href="/x">x</a><a href="/private/y">y</a>'), ("https://a.test/x", "x"), ("https://a.test/private/y", "y"), ("https://a.test/robots.txt", "User-agent: *\nDisallow: /private")], "url string, html string")
    seed = spark.createDataFrame([("https://a.test/",)], "url string")
    got = lambda **k: {r["url"] for r in links.crawl(seed, lambda f: f.join(site, "url", "left"), **k).collect()}
    assert "https://a.test/private/y" in got() and got(agent="m") == {"https://a.test/", "https://a.test/x"}


BOOK = """<title>3.1. Nets — Book</title><div role="main"><h1>3.1. Nets<a class="headerlink">¶</a><div class="d2l-tabs">Colab</div></h1>
<p>See <a class="reference internal" href="b.html">Section 2</a>, <a href="https://colab.research.google.com/x">open</a>.</p>
<div class="mdl-tabs"><div class="mdl-tabs__tab-bar">A B</div><div class="mdl-tabs__panel is-active"><div class="highlight-python"><div class="highlight"><pre>x = 1
</pre></div></div></div><div class="mdl-tabs__panel">other</div></div>
<div class="output highlight-default"><div class="highlight"><pre>Out</pre></div></div>
<div class="math">\\[y = 1\\]</div><p><a href="https://discuss.d2l.ai/t/1">Discussions</a></p></div>"""


def test_book_pages(spark):
    text, meta = H.book(H.parse(BOOK), "https://d2l.ai/a.html")
    assert text == "# 3.1. Nets\n\nSee Section 2, .\n\n```python\nx = 1\n```\n\n$$\ny = 1\n$$"
    assert meta["section_number"] == "3.1" and meta["chapter"] == "3" and H.strategy_for("en.d2l.ai") is H.book
    pages = spark.createDataFrame([(1, "https://d2l.ai/a", BOOK), (2, "https://d2l.ai/b", "<p>no main</p>"), (3, "https://h.test/c", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["error"] for r in H.extract(pages).collect()} == {1: None, 2: "no main content", 3: "no page"}


def test_images():
    one = lambda x: H.to_markdown(H.parse(f"<p>{x}</p>"))
    assert one('<center><img data-src="b.png" src="a.png" alt="curve"></center>') == "![curve](b.png)"
    assert one('<img src="{{ site.url }}/a.png">') == "" and one('<img src="m.png" alt="site menu">') == "" and one("<img>") == ""


class Reader:
    def read(self, content):
        if content == b"bad":
            raise ValueError("unreadable")
        region = lambda i, box, text=None: {"id": i, "box": box, "text": text}
        return [
            {"page": 1, "text": "Intro\nFigure 1: two curves\nend", "figures": [region(1, [0.0, 0.0, 100.0, 100.0]), region(2, [120.0, 4.0, 220.0, 100.0])], "captions": [region(1, [0.0, 105.0, 100.0, 115.0], "(a) left"), region(2, [120.0, 105.0, 220.0, 115.0], "(b) right")]},
            {"page": 2, "text": "Plain", "figures": [], "captions": []},
        ]


class Describer:
    def describe(self, source_id, page, box, label, caption):
        if box[0] > 500:
            raise RuntimeError
        return f"{label or 'figure'} at {box[0]:.0f} of {caption}"


def test_recognised_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    pages = recognised.recognise(spark, str(tmp_path), Reader()).cache()
    assert {(r["source_id"], r["page"], r["error"]) for r in pages.collect()} == {("a.pdf", 1, None), ("a.pdf", 2, None), ("b.pdf", None, "unreadable")}
    assert {r["kind"]: (r["n"], r["n_pages"], r["without_text"]) for r in recognised.regions(pages).collect()} == {"figures": (2, 1, 2), "captions": (2, 1, 0)}
    got = recognised.to_documents(pages, Describer()).first()["markdown"]
    assert 'source_type: "pdf"' in got and 'page_count: "2"' in got and "<!-- loc page=1 -->" in got and got.index("page=1") < got.index("page=2")
    assert "--- [FIGURE] ---\nFigure 1: two curves\n(a) left: (a) left at 0 of Figure 1: two curves\n(b) right: (b) right at 120 of Figure 1: two curves\n--- [/FIGURE] ---\nend" in got


def test_figures_choose_captions_in_reading_order(spark):
    f = spark.createDataFrame([(1, 1, [0.0, 1.0, 50.0, 100.0], 1), (1, 2, [40.0, 0.0, 90.0, 100.0], 2), (1, 3, [0.0, 500.0, 50.0, 600.0], 3)], "page_id long, fig_id long, box array<double>, ordinal int")
    c = spark.createDataFrame([(1, 1, [45.0, 110.0, 48.0, 120.0]), (1, 2, [60.0, 110.0, 90.0, 120.0])], "page_id long, cap_id long, box array<double>")
    assert {(r["fig_id"], r["cap_id"]) for r in layout.pair_captions(f, c).collect()} == {(1, 1), (2, 2), (3, None)}


def test_figures_at_the_band_s_edge_stay_apart(spark):
    f = spark.createDataFrame([(1, 1, [0.0, 0.0, 9.0, 10.0]), (1, 2, [0.0, 50.0, 9.0, 60.0]), (1, 3, [0.0, 99.0, 9.0, 110.0])], "page_id long, fig_id long, box array<double>")
    assert {(r["fig_id"], r["cluster"]) for r in layout.cluster_figures(f).collect()} == {(1, 0), (2, 1), (3, 1)}


def _pages_of_boxes(i, seed):
    """Boxes of 40 pages and of none, one page with many, some boxes with a number or the whole missing."""
    r = random.Random(seed)
    pages = [None, *range(40), *[7] * 40]
    corner = lambda: r.choice([None] * (r.random() < 0.02) + [float(r.randrange(0, 800, 20))])
    rows = [(r.choice(pages), n, None if r.random() < 0.02 else [x := float(r.randrange(300)), corner(), x + r.randrange(200), corner()]) for n in range(600)]
    return rows, f"page_id long, {i} long, box array<double>"


def _by_page(rows):
    pages = {}
    for page, i, box in rows:
        if box is not None:
            pages.setdefault(page, []).append((i, [float("nan") if x is None else x for x in box]))
    return pages


def test_captions_are_paired_for_many_pages_at_once(spark):
    f, c = _pages_of_boxes("fig_id", 1), _pages_of_boxes("cap_id", 2)
    want, caps = set(), _by_page(c[0])
    for page, figs in _by_page(f[0]).items():
        left = caps.get(page, [])
        for i, b in figs:
            near = [(cb[1] - b[3], k) for k, (_, cb) in enumerate(left) if min(b[2], cb[2]) > max(b[0], cb[0]) and cb[1] - b[3] >= layout.ABOVE]
            want.add((page, i, left.pop(min(near)[1])[0] if near else None))
    pairs = layout.pair_captions(spark.createDataFrame(*f), spark.createDataFrame(*c))
    assert set(map(tuple, pairs.collect())) == want and len({x[2] for x in want}) > 100
    assert "FlatMapGroups" not in pairs._jdf.queryExecution().executedPlan().toString()  # a call of pandas a page took too long


def test_figures_of_many_pages_are_clustered_at_once(spark):
    f, want = _pages_of_boxes("fig_id", 3), set()
    for page, figs in _by_page(f[0]).items():
        bands = []
        for i, b in sorted(figs, key=lambda x: [(v != v, v) for v in (x[1][1], x[1][0])] + [x[0]]):
            k = next((k for k, (lo, hi) in enumerate(bands) if b[1] < hi + layout.BAND and b[3] > lo - layout.BAND), len(bands))
            bands[k:k + 1] = [[min(bands[k][0], b[1]), max(bands[k][1], b[3])] if k < len(bands) else [b[1], b[3]]]
            want.add((page, i, k))
    clusters = layout.cluster_figures(spark.createDataFrame(*f))
    assert set(map(tuple, clusters.collect())) == want and max(x[2] for x in want) > 3
    assert "FlatMapGroups" not in clusters._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_once_for_figures_and_captions(spark, sf):
    """Boxes aren't made before the shuffle by page, and what is gathered by page isn't shuffled again."""
    plan = fixtures.nearest_caption(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 4 and plan.count("Exchange hashpartitioning(page_id") == 1  # two for lines without a page


def test_a_sweep_of_weights_makes_its_lists_once(spark, sf):
    assert search.rrf_alpha_sweep(spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInPandas ") == 2  # six: two a weight
    lists = [spark.createDataFrame([(q, f"c{(q * 7 + r * s) % 9}", r) for q in range(4) for r in range(1, 7)], "qid long, child_id string, rank int") for s in (1, 2)]
    c = spark.createDataFrame([(f"c{i}", f"p{i % 4}", f"text {i // 8}") for i in range(9)], "child_id string, parent_id string, text string")
    want = {(a, r["qid"], r["parent_id"], r["child_id"], r["score"], r["rank"]) for a in (0.2, 0.8) for r in R.rrf(*lists, c, 3, a).collect()}
    got = R.rrf_sweep(*lists, c, [0.2, 0.8], 3).select("alpha", "qid", "parent_id", "child_id", "score", "rank").collect()
    assert set(map(tuple, got)) == want and len(got) == 24


def test_sets_of_words_are_not_sent_through_the_driver(spark, sf):
    """The files' sizes tell little of them: at 0.1 GB they were broadcast and filled the driver's memory."""
    assert "BroadcastHashJoin" not in quality.relevance(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in quality.bootstrap(spark, sf)._jdf.queryExecution().executedPlan().toString()  # scores are made once


def test_files_and_stores(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    (source / "a.md").write_text("---\ntitle: T\n---\n\nText  \n")
    (source / "b.md").write_text(" ")
    (source / "deep" / "c.md").write_text("not read")
    got = {r["source"]: r["error"] for r in corpus.normalize_folder(spark, str(source), str(target)).collect()}
    assert got == {"a": None, "b": "empty file"} and sorted(p.name for p in target.glob("*.md")) == ["a.md"] and "Text" in (target / "a.md").read_text()
    index = str(tmp_path / "index")
    with pytest.raises(corpus.NotIndexed):
        corpus.read_sections(spark, index)
    children = spark.createDataFrame([("c1", None, "x"), ("c2", 3, "y")], "child_id string, page int, text string")
    vectors = spark.createDataFrame([("c1", [0.5, 0.5])], "child_id string, embedding array<double>")
    corpus.write_index(children, index, vectors=vectors)
    corpus.write_index(children.limit(0), index, reset=False, vectors=vectors)
    corpus.write_sections(spark.createDataFrame([("p1", "t")], "parent_id string, text string"), index)
    assert {(r["child_id"], r["page"], r["embedding"] is None) for r in corpus.read_index(spark, index).collect()} == {("c1", -1, False), ("c2", 3, True)}
    assert corpus.read_sections(spark, index).first()["parent_id"] == "p1"
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception) as e:
        corpus.read_index(spark, str(tmp_path / "broken")).collect()
    assert not isinstance(e.value, corpus.NotIndexed)


def test_report_of_an_answer(spark):
    hit = "array<struct<parent_id:string,source:string,dist:double>>"
    rows = [
        (1, "What does a gated layer keep?", "gated layer", ["a"], [("p1", "lesson one", 0.5), ("p2", "x" * 40, 0.25)], ["A gated layer keeps the signal."], "It keeps it [DOC 1] [DOC 9].", False),
        (2, "Who?", None, None, [("p1", "s", 0.01)], [], "No.", True),
        (3, None, None, None, None, None, None, None),
    ]
    r = spark.createDataFrame(rows, f"qid long, query string, rewritten_query string, sub_queries array<string>, hits {hit}, contexts array<string>, answer string, refused boolean")
    s = spark.createDataFrame([("p1", "web", "One"), ("p2", "pdf", "")], "parent_id string, source_type string, section string")
    got = {x["qid"]: x.asDict(recursive=True) for x in reports.per_answer(r, s, spark.createDataFrame([(1, True)], "qid long, grounded boolean")).collect()}
    assert got[1]["pipeline"]["score_range"] == 0.25 and got[1]["judge"] == {"verdict": "grounded", "grounded": True}
    assert got[1]["retrieval"]["source_types"] == "pdf ×1, web ×1" and got[1]["retrieval"]["n_titles"] == 1
    assert got[1]["citations"]["cited"] == [1] and got[1]["citations"]["uncited"] == [2] and got[1]["citations"]["sources"] == ["lesson one"]
    assert got[2]["pipeline"]["refused_by_gate"] and got[2]["judge"]["verdict"] == "refused" and got[2]["retrieval"] is None
    assert got[3]["pipeline"]["n_contexts"] == 0 and got[3]["citations"] is None and got[3]["pipeline"]["score_top"] is None
    text = reports.as_text(got[1])
    assert "grounded" in text and "1 lesson one" in text and "Citations" not in reports.as_text(got[3])


def test_top_sources(spark):
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabcd", 1)], "qid long, rank int, label string")
    assert citations.top_sources(d).first()["sources"] == "- a\n- b\n- c"


class Echo:
    def complete(self, system, user):
        return user if "digit" not in system else "4" if "right" in user else "none"


def test_history_reaches_the_models(spark, small):
    c, p, q = small
    history = spark.createDataFrame([(1, "Student : before")], "qid long, history string")
    out = {r["qid"]: r["answer"] for r in pipeline.answer(q, c, p, Echo(), threshold=0.0, history=history).collect()}
    assert out[1].startswith("Student : before\n\ngated layer 3") and out[2].startswith("keeps")


def test_judges(spark):
    saved = spark.createDataFrame([(1, "ref", "right"), (2, "ref", None)], "qid long, reference string, answer string")
    graded = pipeline.correctness(saved, Echo())
    assert {r["qid"]: r["correctness"] for r in graded.collect()} == {1: 0.8, 2: None}
    human = spark.createDataFrame([(1, 0.6), (2, 0.2)], "qid long, correctness double")
    r = pipeline.agreement(graded, human).first()
    assert (r["n"], round(r["mean_distance"], 6), r["within"]) == (1, 0.2, 1.0)


def test_scores_for_calibration(spark, small):
    c, p, q = small
    items = q.withColumn("category", F.when(F.col("qid") == 1, "single_passage").otherwise("unanswerable")).unionByName(spark.createDataFrame([(3, "layer", None)], "qid long, question string, category string"))
    got = {r["qid"]: (r["score"], r["unanswerable"]) for r in pipeline.collect_scores(items, c, p).collect()}
    assert set(got) == {1, 2} and got[1][1] is False and got[2] == (1.0, True)
    assert metrics.calibrate(pipeline.collect_scores(items, c, p)).count() == 1


def test_generated_items(spark):
    chunks = spark.createDataFrame([(f"s{i}", f"s{i}__sec000", j, f"Fact {i} {j} holds. More.") for i in range(30) for j in range(5)], "source string, parent_id string, child_no int, text string")
    one, several = goldens.single_passage(chunks, 8).collect(), goldens.multi_passage(chunks, 8).collect()
    assert len(one) == len(several) == 8 and all(r["category"] == "single_passage" and len(r["contexts"]) == 1 for r in one)
    assert all(r["category"] == "multi_passage" and len(r["contexts"]) in (2, 3) for r in several)
    assert all(r["ground_truth"] in r["contexts"][0] and r["ground_truth"].endswith("holds.") for r in one)
    assert goldens.drift_candidates(chunks, 5).where("ground_truth is null").count() == 5
    assert goldens.single_passage(chunks.where("source = 's1'"), 2).count() == 2  # few documents give several groups
    with pytest.raises(ValueError):
        goldens.single_passage(chunks.limit(0), 2)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    s = spark.createDataFrame([(m, round(rng.random(), 2)) for m in "ab" for _ in range(200)], "metric string, score double")
    runs = [sorted(map(tuple, metrics.bootstrap(s.repartition(n)).collect())) for n in (1, 7)]
    for a, b in zip(*runs):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9) and a[2] == pytest.approx(b[2], abs=1e-9)
    values = [r["score"] for r in s.where("metric = 'a'").collect()]
    lower, upper, _ = metrics.bootstrap_sequential(values)
    assert abs(runs[0][0][1] - lower) < 0.02 and abs(runs[0][0][2] - upper) < 0.02


def test_calibration_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGES", 5)
    rng = random.Random(2)
    rows = [(g, round(rng.random(), 3), rng.random() < 0.4) for g in ("x", None) for _ in range(400)]
    got = {r["g"]: (r["accuracy"], -r["threshold"]) for r in metrics.calibrate(spark.createDataFrame(rows, "g string, score double, unanswerable boolean"), ["g"]).collect()}
    for g in ("x", None):
        own = [(s, u) for h, s, u in rows if h == g]
        assert got[g] == max((sum((s < t) == u for s, u in own) / len(own), -t) for t in {s for s, _ in own})


def test_blank_texts_have_no_vector(spark):
    d = spark.createDataFrame([(1, "a b"), (2, " "), (3, None), (4, "a b")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in providers.embed(d, "id", "t", providers.OfflineEmbedder(8)).collect()}
    assert got[1] == got[4] and got[2] is None and got[3] is None and len(got) == 4


def test_provider_options(tmp_path):
    (tmp_path / "o.yaml").write_text("layout:\n  model: a\n  size: [1, 2]\nretries: 3\n")
    assert providers.options(str(tmp_path / "o.yaml")) == {"layout.model": "a", "layout.size": [1, 2], "retries": 3}
    (tmp_path / "e.yaml").write_text("")
    assert providers.options(str(tmp_path / "e.yaml")) == {}


def test_a_model_summarises_for_the_memory():
    class Model:
        def complete(self, system, user):
            return "sum: " + user.replace("\n", " ")

    m = conversation.Memory(window=1, summarise=conversation.summariser(Model(), words=6))
    for role, text in itertools.islice(itertools.cycle([("student", "a"), ("tutor", "b")]), 4):
        m.add(role, text)
        m.compress()
    assert m.summary.startswith("sum: SUMMARY SO FAR") and len(m.summary.split()) <= 6


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from marginalia import session

    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context()})()

    with pytest.raises(ValueError):
        session.cut_lineage(Frame())


def test_regions_by_their_several_keys(spark):
    d = spark.createDataFrame([({"label": " Figure ", "text": "a", "img_path": "x.png"},), ({"native_label": "caption", "type": "text", "content": "b"},), ({},)], "r map<string,string>")
    got = d.select(layout.region_type(F.col("r")), layout.region_text(F.col("r")), layout.region_image(F.col("r"))).collect()
    assert [tuple(x) for x in got] == [("figure", "a", "x.png"), ("caption", "b", None), (None, None, None)]


def test_content_patterns(spark):
    d = spark.createDataFrame([("https://www.d2l.ai/chapter_x/a.html",), ("https://d2l.ai/index.html",), ("https://h.test/a",)], "url string")
    assert [r[0] for r in d.select(links.is_content(F.col("url"))).collect()] == [True, False, True]
    assert [r[0] for r in d.select(links.is_content(F.col("url"), "/a$")).collect()] == [False, False, True]


def test_commands(spark, tmp_path, capsys):
    from marginalia import __main__ as cli

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text("---\nsource_type: web\ntitle: T\nsource_url: https://h.test/a\n---\n\n# Layers\n\nA gated layer keeps the signal. It is small.\n")
    (source / "b.md").write_text("---\nsource_type: web\n---\n\n# Loss\n\nThe loss falls with every step.\n")
    index, clean = str(tmp_path / "index"), str(tmp_path / "clean")
    cli.main(["normalize", str(source), clean])
    cli.main(["ingest", clean, index])
    cli.main(["stats", index])
    cli.main(["search", index, "gated layer"])
    assert "web · h.test" in capsys.readouterr().out
    (tmp_path / "items.json").write_text(json.dumps([{"question": "What does a gated layer keep?", "ground_truth": "the signal", "contexts": ["A gated layer keeps the signal."], "category": "single_passage"}, {"question": "zzz", "category": "unanswerable"}]))
    cli.main(["evaluate", index, str(tmp_path / "items.json"), "--history", str(tmp_path / "runs")])
    assert "hit_lower" in capsys.readouterr().out and spark.read.json(str(tmp_path / "runs")).count() == 1
    cli.main(["calibrate", index, str(tmp_path / "items.json"), "--limit", "1"])
    args = cli.parser().parse_args(["chat", index, "--report"])
    asked, said = iter(["What does a gated layer keep?", ""]), []
    cli.chat(spark, args, lambda _: next(asked), said.append)
    assert "gated layer" in said[0] and any("Retrieval" in x for x in said)
