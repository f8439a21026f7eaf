"""Operators against brute force, round trips and small labelled cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import boilerplate, cutoff, markup, mixing, packing, replies, scans, sentences, splitting, tokens


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n|`$", max_size=400), st.integers(5, 60), st.integers(0, 30))
def test_pieces_join_to_the_text(text, limit, overlap):
    spans = splitting.split_text(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert all(b - a <= limit for a, b, _ in spans)
    joined = text[spans[0][0] : spans[0][1]]
    for (_, e, _), (a, b, _) in itertools.pairwise(spans):
        assert a == e - overlap
        joined += text[a:b][overlap:]
    assert joined == text


def test_unbreakable_units():
    assert splitting.has_unbreakable("x" * 20, 10)
    assert not splitting.has_unbreakable("x. " * 20, 10)
    assert splitting.has_unbreakable("```\n" + "a = 1\n" * 5 + "```", 20)
    assert not splitting.has_unbreakable("```\na\n```\n\nword word word", 20)
    assert splitting.has_unbreakable("| a | b |\n| c | d |", 12)


@pytest.mark.parametrize("seed", range(6))
def test_quickselect_equals_sorting(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(3)}", round(rng.random(), rng.choice([1, 2, 4]))) for _ in range(400)]
    by: dict[str, list[float]] = {}
    for g, s in rows:
        by.setdefault(g, []).append(s)
    ranks = [(g, rng.randint(1, len(x))) for g, x in by.items()]
    got = cutoff.quickselect_cutoffs(spark.createDataFrame(rows, "g string, score double").repartition(5), spark.createDataFrame(ranks, "g string, k long"))
    assert {r["g"]: r["cutoff"] for r in got.collect()} == {g: sorted(by[g], reverse=True)[k - 1] for g, k in ranks}


def test_quickselect_with_many_sources_takes_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(cutoff, "STATE_ROWS", 1)
    scores = spark.createDataFrame([("a", x / 10) for x in range(10)] + [("b", 0.5)] * 3, "g string, score double")
    got = cutoff.quickselect_cutoffs(scores, spark.createDataFrame([("a", 3), ("b", 3)], "g string, k long"))
    assert {r["g"]: r["cutoff"] for r in got.collect()} == {"a": 0.7, "b": 0.5}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_packing_is_valid_and_bounded(sizes):
    where, room = packing.best_fit_decreasing(np.array(sizes), 30)
    used = np.bincount(where, weights=sizes)
    assert (used <= 30).all() and (30 - used == room).all()
    assert packing.lower_bound(np.array(sizes), 30) <= len(room)


def test_lower_bound_is_below_the_optimum():
    rng = random.Random(1)
    for _ in range(40):
        sizes = [rng.randint(2, 10) for _ in range(7)]
        best = min(len(set(a)) for a in itertools.product(range(3), repeat=7) if all(sum(s for s, x in zip(sizes, a) if x == b) <= 20 for b in set(a))) if sum(sizes) <= 60 else 4
        assert packing.lower_bound(np.array(sizes), 20) <= best


def test_bounds_use_every_limit():
    rng = random.Random(3)
    for _ in range(30):
        sizes, c = np.array([rng.randint(1, 400) for _ in range(300)]), 400
        plain = max(-(-sum(c if s > c - e else 0 if s < e else s for s in sizes.tolist()) // c) for e in {s for s in sizes.tolist() if 2 * s <= c})
        assert packing.lower_bound(sizes, c) >= plain


def test_many_kinds_of_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "KINDS_AT_ONCE", 2)
    sizes = spark.createDataFrame([(i, 10 + i) for i in range(20)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([(f"k{i}", 60 + i) for i in range(5)], "container_kind string, capacity_tokens int")
    assert {(r["container_kind"], r["doc_id"]) for r in packing.pack(sizes, kinds).collect()} == {(f"k{i}", d) for i in range(5) for d in range(20)}


def test_every_document_is_packed_whole(spark):
    sizes = spark.createDataFrame([(i, (i * 37) % 900 + 1) for i in range(300)], "doc_id long, tokens long")
    placed = packing.pack(sizes, spark.createDataFrame([("c", 512)], "container_kind string, capacity_tokens int")).collect()
    total: dict[str, int] = {}
    pieces: dict[int, list] = {}
    for r in placed:
        total[r["container_id"]] = total.get(r["container_id"], 0) + r["size"]
        pieces.setdefault(r["doc_id"], []).append((r["start_token"], r["size"]))
    assert max(total.values()) <= 512
    for d, p in pieces.items():
        n = (d * 37) % 900 + 1
        assert sum(s for _, s in p) == n and len(p) == -(-n // 512)


def test_mixture_reaches_its_shares(spark):
    docs = spark.createDataFrame([(i, "big" if i % 4 else "small", 10 + i % 7, 1.0) for i in range(4000)], "doc_id long, source string, tokens long, weight double")
    got = mixing.mix(docs, spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")).collect()
    total = {s: sum(r["tokens"] * r["copies"] for r in got if r["source"] == s) for s in ("big", "small")}
    assert abs(total["big"] / sum(total.values()) - 0.5) < 0.001
    assert max(r["copies"] for r in got if r["source"] == "small") <= 3 and max(r["copies"] for r in got if r["source"] == "big") == 1
    assert len({r["copies"] for r in got if r["source"] == "small"}) <= 2  # whole epochs come first


def test_keys_of_low_weights_spread_over_the_buckets(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'low' when id % 3 = 1 then 'mid' else 'high' end as source").selectExpr("*", "case source when 'low' then 0.05D when 'mid' then 0.4D else 1D end as weight")
    from pyspark.sql import functions as F

    keyed = mixing.exponential_keys(docs, 7).withColumn("b", F.floor(F.log("key") * mixing.STEPS))
    most = keyed.groupBy("source", "b").count().groupBy("source").agg(F.max("count").alias("m")).collect()
    assert all(r["m"] < 0.005 * 20_000 for r in most)


def test_the_gap_is_filled_by_documents_that_fit(spark):
    docs = spark.createDataFrame([(i, "a" if i < 50 else "b", 100 if i < 50 else 7 + i % 90, 1.0) for i in range(400)], "doc_id long, source string, tokens long, weight double")
    got = mixing.mix(docs, spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")).collect()
    total = {s: sum(r["tokens"] * r["copies"] for r in got if r["source"] == s) for s in ("a", "b")}
    assert total["a"] == 5000 and abs(total["b"] - 5000 / 9) <= 0.01 * 5000 / 9


def test_token_counts_don_t_depend_on_cuts():
    text = ("the latent space of a model " * 20_000).strip()
    assert len(text) > 2 * tokens.LONGEST
    for x in (text, "x" * 540_000, "x" * 250_000 + " a" * 100_000, "学" * 300_000):
        assert tokens.count_tokens(x) == len(tokens.encoder().encode_ordinary(x))


SENTENCES = [
    ("Dr. Velmark showed it. At 9 a.m. the run stopped at a loss of .5. Really?!", ["Dr. Velmark showed it.", "At 9 a.m. the run stopped at a loss of .5.", "Really?!"]),
    ("“It converges. It never diverges,” wrote L. He left.", ["“It converges. It never diverges,” wrote L.", "He left."]),
    ("“It converges,” wrote L. Brundavik. M. Le Brun agreed with K. Hargwen.", ["“It converges,” wrote L. Brundavik.", "M. Le Brun agreed with K. Hargwen."]),
    ("« Cela va ? » demanda-t-il. (Cela vaut aussi.) Fin.", ["« Cela va ? » demanda-t-il.", "(Cela vaut aussi.)", "Fin."]),
    ("学生问：「为什么？」训练过程中，误差下降。「它会收敛。它不会发散。」报告里这样写道。", ["学生问：「为什么？」", "训练过程中，误差下降。", "「它会收敛。它不会发散。」报告里这样写道。"]),
    ("Am 4. März begann der Lauf. Der 91. Versuch, z. B. auf X, gelang.", ["Am 4. März begann der Lauf.", "Der 91. Versuch, z. B. auf X, gelang."]),
    ("# Head\n\n- one. two\n- three\n\n```\na. B\n\nc\n```\n$$\nx = 1. y\n$$", ["# Head", "- one. two", "- three", "```\na. B\n\nc\n```", "$$\nx = 1. y\n$$"]),
    ("หลังจากลู่เข้าแล้ว ตัวจำแนกจำกัดค่า ประมาณ 0.4 บนชุด Orvex ในบทนี้ตัวกรองลดค่า", ["หลังจากลู่เข้าแล้ว ตัวจำแนกจำกัดค่า ประมาณ 0.4 บนชุด Orvex", "ในบทนี้ตัวกรองลดค่า"]),
]


@pytest.mark.parametrize(("text", "want"), SENTENCES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["A b c. ", "d?” ", "“E ", "\n", "\n\n", "```\n", "$$ ", "(f.) ", "- g ", "一。", "「", "」", "x 1.2 "]), max_size=200), st.integers(30, 80))
def test_chunks_emit_what_the_whole_text_emits(parts, size):
    text = "".join(parts)
    width, start = sentences.wrap_width(text), sentences.first_state(text)
    state, got, now, functions = start, [], None, []
    for at in range(0, len(text), size):
        end = min(len(text), at + size)
        functions.append(sentences.transition(text, at, end, width))
        segments, state = sentences.emit(text, at, end, width, state)
        within, head, passed, tail = sentences.borders(segments)
        now = sentences._joined(now, head)
        if passed:
            got += [now] if now else []
            now = tail
        got += within
    got = sorted(got + ([now] if now else []))
    if functions:
        assert sentences.prefix_scan(np.array(functions))[-1][start] == state
    assert got == sentences.units(text)


def test_long_documents_go_through_chunks(spark):
    text = ("A short sentence. " * 3000).strip()
    assert len(text) > 3 * sentences.CHUNK
    mixed = "“It holds. It never ends,” he wrote. " * 900 + "\n\n```\n" + "a = 1\n" * 6000 + "```\n\n" + "学生问：「为什么？」" * 4000 + "no end at all " * 3000
    texts = {1: text, 2: mixed, 3: "x" * 50_000, 4: " " * 40_000}
    got = sentences.sentence_units(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for i, x in texts.items():
        assert sorted((r["start_char"], r["end_char"]) for r in got if r["doc_id"] == i) == sentences.units(x)
    assert sum(r["doc_id"] == 1 for r in got) == 3000


ENDS = "The layer limits the learning rate. The gated kernel smooths the loss surface. The layer limits the loss surface.\n\nThree points matter:\n- Gated kernel\n- Sparse layer\n- Gated layer"
DEFECTS = [
    ("What is it?", "**Answer:** [DOC 3]", False, "empty"),
    ("What does the kernel do?", "Q: what does kernel do…", False, "copied_question"),
    ("What does the kernel do?", "You ask: What does the kernel do? The gated kernel smooths the loss surface.", False, None),
    ("what does the kernel do", "what does the kernel do\n\nwhat does the kernel do", False, "copied_question"),
    ("What is it?", "Unfortunately, no reliable statement can be made here. Please ask your teacher.", False, "refusal"),
    ("What is it?", "Unfortunately, no reliable statement can be made here. " * 150, False, "refusal"),
    ("What is it?", "The layer limits $" + "x + " * 90 + "y$ and the gated", False, "truncated"),
    ("Que limite la couche ?", "La couche limite la perte.\n\n```\nif x and y: return the_log\n```", False, None),
    ("What is it?", "Unfortunately, no reliable statement can be made here.", True, None),
    ("What is it?", "The first passage does not cover this, but the second one does: The layer limits the loss surface.", False, None),
    ("What is it?", "La couche limite la surface de perte pour les données.", False, "other_language"),
    ("What is it?", "The layer limits the loss surface. The French notes call this “la couche de perte”.", False, None),
    ("What is it?", "The layer limits the loss surface. The gated", False, "truncated"),
    ("What is it?", "The layer limits the loss surface", False, None),
    ("What is it?", "The layer limits the loss surface.\n\n```\nx = 1", False, "truncated"),
    ("What is it?", "The layer limits the loss surface. Three points matter: [DOC 2]", False, "truncated"),
    ("What is it?", "The layer limits the loss surface.\n\n- Gated kernel\n- Gated layer", False, None),
]


def test_defects(spark):
    rows = [("t", 10_000 + i, "What is it?", ENDS, False) for i in range(30)] + [("t", i, q, a, w) for i, (q, a, w, _) in enumerate(DEFECTS)]
    got = replies.defects(spark.createDataFrame(rows, "record_table string, record_id long, question string, reply string, refusal_wanted boolean"))
    found = {r["record_id"]: r["defect"] for r in got.collect()}
    assert [found.get(i) for i in range(len(DEFECTS))] == [d for *_, d in DEFECTS]


def test_ending_counts_are_those_of_a_plain_count(spark):
    import re
    from collections import Counter

    texts = [ENDS, "A layer. It ends [DOC 3] here at v2.5 in rank 12!\n- x: y\n- z\n- w\n\n```\na b. c\n```\nA cut sentence that stops ...", None, ""]
    want: Counter = Counter()
    for kind, unit in [("s", "The layer limits the learning rate"), ("s", "The gated kernel smooths the loss surface"), ("s", "The layer limits the loss surface"), ("i", "Gated kernel"), ("i", "Sparse layer"), ("s", "A layer"), ("s", " It ends   here at v2.5 in rank 12"), ("i", "x: y"), ("i", "z")]:
        w = ["^", *[re.sub(r"\d+", "0", x) for x in re.findall(r"[^\W_]+|[,:;]", unit.lower())]]
        for k in range(1, len(w)):
            done = k == len(w) - 1 or kind == "i" and w[k + 1] == ":"
            want[kind, w[k - 1], w[k]] += 1
            want[kind, w[k - 1], w[k], "ends"] += done
    got = replies.ending_counts(spark.createDataFrame([(x,) for x in texts], "reply string")).collect()
    assert {(r["kind"], r["before"], r["last"]): (r["total"], r["ends"]) for r in got} == {k: (n, want[(*k, "ends")]) for k, n in want.items() if len(k) == 3}


def test_tiling_covers_each_word_once():
    a, b = "a b c x a b".split(), "a b c a b".split()
    found = replies.tiles(a, b)
    assert sorted(n for _, _, n in found) == [2, 3]


MARKUP = [
    ("a <b>c</b> &amp; d<br>", {"html"}), ("x < y and y > z, R&D, 5 > 8", set()), ("**a** and ~~b~~ and [c](d.md) and e[^1]", {"markdown"}), ("(a_5 * b_5) and snake_case_5 and 3 * 4 * 5, ([[1, 0], [0, 7]])", set()),
    ("[[page|label]] and ''it''", {"wiki"}), ("\\emph{a}~\\cite{b}, ``quoted'', see \\ref{c}", {"latex"}), ("`<b>` and $x_4<y_6$ and C:\\data\\run5", set()), ("# Head\n\n- item\n\n| a | b |\n| --- | --- |\n\n<!-- loc page=3 -->", set()),
    ("a <!-- todo 3 --> b", {"html"}), ("Title\n=====\n\ntext", {"markdown"}), ("== Head ==\n\n{| class=\"w\"\n|-\n| a\n|}", {"wiki"}),
]


@pytest.fixture(scope="module")
def texts(sf):
    import duckdb

    return [r[0] for t, c in (("parents", "text"), ("extracted_documents", "markdown")) for r in duckdb.sql(f"select {c} from '{sf}/{t}.parquet' where {c} <> '' order by 1").fetchall()]


@pytest.fixture(scope="module")
def trees(texts):
    inline = [t.replace("a", w) for t, _ in MARKUP for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")]
    return markup.BoostedTrees(least=2).fit(*markup.training_rows(texts + inline))


def test_trees_decide_what_no_rule_labels(texts, trees):
    changed = 0
    for text, (nodes, take) in zip(texts, markup.judge(texts, trees)):
        by_rule = [markup.surely(text, nodes, n) for n in nodes]
        changed += {n.kind for n, y in zip(nodes, take) if y} != {n.kind for n, y in zip(nodes, by_rule) if y}
    assert changed > len(texts) // 200


@pytest.mark.parametrize(
    "text", ['a <div class="{}">b</div> word', "**{}** word", "{{{{term|{}\nk}}}} word", "[{}](notes/b.md) word", "''{}'' word", "see [[{}]] word", "``{}\'\' word", "~~{}~~ word", "[^{}] word"]
)
def test_long_spans_are_markup_too(trees, text):
    for n in (20, 1500):
        [(nodes, take)] = markup.judge(["The layer learns the weights. " * 8 + text.format("word" * (n // 4))], trees)
        assert any(take), n


def test_markup_families(trees):
    for (text, want), (nodes, take) in zip(MARKUP, markup.judge([t for t, _ in MARKUP], trees)):
        assert {markup._FAMILY[n.kind] for n, y in zip(nodes, take) if y} == want, text


def test_markup_is_rendered(trees):
    text = "<h2>Head</h2>\n\n<ul>\n<li>one</li>\n</ul>\n\n\\section{More} *x* [y](z.md) &lt; `*k*`"
    [(nodes, take)] = markup.judge([text], trees)
    out = markup.clean(text, nodes, [n.kind in ("tag", "command", "strong", "link", "entity") for n in nodes])
    assert "## Head" in out and "- one" in out and "## More x y < `*k*`" in out
    assert all(y in (True, False) for y in take)


def test_nothing_is_markup_inside_a_comment(trees):
    [(nodes, take)] = markup.judge(["a<!-- **b** -->c"], trees)
    assert [n.kind for n, y in zip(nodes, take) if y] == ["comment"]


PAGE = "Home | Blog | Contact\n\n# Lesson\n\nThe layer {1} learns. A server sets cookies to remember a session.\n\nRelated lessons\n{0}\n\n- First point\n- Second point\n\nContact\n\nWe use cookies to keep you signed in.\nAccept all\n\n© 2020 Ember Campus 1. All rights reserved.\nImprint"


def _pages(spark, texts, host="ember-campus1.invalid"):
    return spark.createDataFrame([(i, host, x) for i, x in enumerate(texts)], "document_id long, host string, markdown string")


def _kept(spark, texts):
    off = {(r["document_id"], r["line_no"]) for r in boilerplate.furniture(_pages(spark, texts)).collect()}
    return [[x for k, x in enumerate(t.split("\n")) if x and (i, k) not in off] for i, t in enumerate(texts)]


def test_the_vote_of_a_host_decides(spark):
    lists = ["- Gated kernel\n- Sparse layer"] + ["- [Gated kernel](/a)\n- [Sparse layer](/b)"] * 9
    pages = [PAGE.format(x, w) for x, w in zip(lists, "abcdefghij")]
    # a title that leads to links on other pages makes its list furniture here as well; alone it doesn't
    kept = _kept(spark, pages)[0]
    assert [x for x in kept if x != "Contact"] == ["# Lesson", "The layer a learns. A server sets cookies to remember a session.", "- First point", "- Second point"]
    alone = [b for b in boilerplate.read_page(pages[0], "ember-campus1.invalid") if b.kind == "titled"]
    assert alone and alone[0].score < boilerplate.WINS


def test_a_listed_word_in_a_lesson_is_kept(spark):
    page = "# Lesson\n\nThe layer {0} learns.\n\n{1}\n\nThe layer {0} learns the norm of the gradient."
    kept = _kept(spark, [page.format("x", "Contact")] + [page.format(w, f"Kernel {w}") for w in "abcdefghi"])
    assert "Contact" in kept[0]


def test_long_lines_are_candidates_too(spark):
    long = "We use cookies to keep you signed in" + ", and to remember your settings" * 30 + "."
    page = "# Lesson\n\nThe layer {} learns.\n\n" + long + "\nAccept all\n\n© 2020 H. All rights reserved."
    assert _kept(spark, [page.format(w) for w in "abcde"])[0] == ["# Lesson", "The layer a learns."]


SCAN = "<!-- loc page=1 -->\n\nChapter 2\n\nGated kernel\n\nThe robust layer smooths the gradi-\nent norm. The rnodel learns low-\nrank maps.\n\n– 7 –\n\n<!-- loc page=2 -->\n\nGated kernel\n– 8 –\n\nThe layer grows.\n(12)\n53 %"


def test_scan_noise():
    words = {w: 500 for w in "the robust layer smooths gradient norm model learns low rank maps grows low-rank".split()}
    m = scans.Channel(words, {}, [])
    noise, fixes = scans.read_document(SCAN, m)
    assert noise == [(6, "hyphen_break"), (7, "misread"), (10, "page_number"), (14, "running_head"), (15, "page_number")]
    assert [(w, v) for _, _, w, v in fixes] == [("rnodel", "model")]
    assert "smooths the gradient norm. The model learns low-rank maps." in scans.repair(SCAN, m)


def test_confusion_rates_and_known_words_don_t_depend_on_size(spark):
    rates = {}
    for times in (1, 10):
        words = {w: 3000 * times for w in ("network", "letter", "sentence", "tensor")} | {w: times for w in ("nctwork", "lctter", "scntence", "tcnsor")} | {"tender": 40 * times}
        near = scans._near(spark.createDataFrame(list(words.items()), "word string, n long"), spark.createDataFrame([], "word string"))
        rates[times] = scans._estimate(near)
        m = scans.Channel(words, {}, rates[times])
        assert m.decode(["the", "nctwork", "tender"]) == ["the", "network", "tender"]
    assert rates[10]["e", "c"] == pytest.approx(rates[1]["e", "c"], rel=0.2)


def test_misread_words_are_found_at_any_size(spark):
    rates = {}
    for times in (1, 100, 1000):  # a frequent word too short to be judged, and a form whose rate is four times the others'
        words = {"the": 30_000 * times} | {w: 3000 * times for w in ("network", "letter", "sentence", "tensor", "deep", "layer")}
        words |= {"nctwork": times, "scntence": times, "tcnsor": times, "lctter": 4 * times, "tender": 40 * times, "deepxlayer": max(1, 6 * times // 1000)}
        near = scans._near(spark.createDataFrame(list(words.items()), "word string, n long"), spark.createDataFrame([], "word string"))
        rates[times] = scans._estimate(near)
        assert {r["v"] for r in near.where("word = 'deepxlayer'").first()["near"]} >= {"deep", "layer"}
        m = scans.Channel(words, {}, rates[times])
        assert m.decode(["the", "nctwork", "lctter", "tender"]) == ["the", "network", "letter", "tender"]
        assert m.decode(["deepxlayer"]) == ["deep layer"] and not m.known("deepxlayer") and m.known("tender")
    assert rates[1000]["e", "c"] == pytest.approx(rates[1]["e", "c"], rel=0.2)


def test_scan_counts_are_whole(spark, sf, monkeypatch):
    for name in ("WORDS_MOST", "PAIRS_MOST", "RARE_MOST"):
        monkeypatch.setattr(scans, name, 5, raising=False)
    monkeypatch.setattr(scans, "BUCKET_DOCS", 3)
    docs = scans._docs(spark, sf)
    words, pairs = scans._counts(docs)
    rate = scans._estimate(scans._near(words, words))
    m = scans.Channel({r["word"]: r["n"] for r in words.collect()}, {(r["a"], r["b"]): r["n"] for r in pairs.collect()}, rate)
    want = {(r["document_id"], i, kind) for r in docs.where("scanned").collect() for i, kind in scans.read_document(r["body"], m)[0]}
    assert {tuple(r) for r in scans.found(spark, sf).collect()} == want and any(kind == "misread" for _, _, kind in want)


def test_counts_are_those_of_a_plain_walk(spark, sf):
    from collections import Counter

    texts = [r["body"] for r in scans._docs(spark, sf).collect()] + ["!a b!c rnodel- \nling ‐x •y e.g. A.B ﬁne 12 -\n- z¬\nq r­", "", "\n\n", "!Ab !ab ab! --"]
    one: Counter = Counter()
    two: Counter = Counter()
    for text in texts:
        broken = False
        for line in text.split("\n"):
            ws = [w.lower() for _, w in scans.words_of(line)]
            if not ws:
                continue
            ends = line.rstrip()[-1:] in scans._HYPHENS
            ws = ws[1:] if broken else ws
            ws = ws[:-1] if ends else ws
            broken = ends
            one.update(ws)
            two.update(zip(ws, ws[1:]))
    words, pairs = scans._counts(spark.createDataFrame([(t,) for t in texts], "body string"))
    assert {r["word"]: r["n"] for r in words.collect()} == one
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == two


def test_neighbours_may_favour_any_candidate_of_a_misread_word():
    words = {w: 900 for w in "aorder border corder dorder eorder forder gorder".split()} | {"horder": 500, "tall": 500, "x": 10**6}
    m = scans.Channel(words, {("tall", "horder"): 400}, {})
    assert m.decode(["tall", "zorder"]) == ["tall", "horder"]


def test_a_long_line_doesn_t_turn_wrapping_off():
    wrapped = "The causal embedding table controls the error, so the\nshallow attention head reduces the distance between\ntwo passages. It holds."
    texts = [wrapped, "字" * 150 + "。\n\n" + wrapped, "A title of one line that is wider than the wrapped text below it, by far\n \n" + wrapped, "x" * 150 + "\nshort line\n", "", "\n\n"]
    assert [sentences.wrap_width(x) for x in texts] == [53, 53, 53, 0, 0, 0]
    for text in texts[1:3]:
        assert [text[a:b] for a, b in sentences.units(text)][1:] == [wrapped[:-10], "It holds."]


def test_a_line_that_a_host_s_pages_repeat_is_furniture(spark):
    page = "Etusivu / Oppitunnit\n\n# Layer {0}\n\nThe layer number {1} learns {1} weights.\n\nA remark on {1}.\n\nTämän sivun ylläpidosta vastaa toimitus, jonka tavoittaa kurssin sähköpostilla."
    words = "red blue green black white brown".split()
    pages = spark.createDataFrame([(i, "h.test", page.format(i, w)) for i, w in enumerate(words)] + [(9, "g.test", page.format(9, "grey"))], "document_id long, host string, markdown string")
    got = {(r["document_id"], r["line_no"]) for r in boilerplate.furniture(pages).collect()}
    assert got == {(i, k) for i in range(6) for k in (0, 8)} | {(9, 0)}  # a trail above the title needs no other page
