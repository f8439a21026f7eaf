"""Queries whose inputs the tables don't hold: pages with markup, boxes, model replies, dialogues. They
are made of stored rows, alike for both engines; only the site that is crawled is spelt out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..operators import conversation as V
from ..operators import html as H
from ..operators import layout as Y
from ..operators import links as L
from ..operators import replies as P
from ..session import table
from .sql import tokens

# ---- dialogues: lines of documents that a speaker opens ---------------------------------------


def turns(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id is not null")
    lines = docs.select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", "\n")).alias("turn", "line"))
    named = lines.where(F.col("line").rlike(r"^(?:Student|Tutor): "))
    return V.turns(named.select("conv_id", "turn", F.regexp_extract("line", r"^(\w+): ", 1).alias("role"), F.regexp_extract("line", r"^\w+: (.*)$", 1).alias("text")))


def dialogue_turns(spark, d):
    return turns(spark, d).select("conv_id", "turn", "role", T.token_estimate(F.col("text")).alias("n_tokens"))


def history_last_n(spark, d):
    return V.history(turns(spark, d), EngineConfig(history_window=3))


def conversation_pairs(spark, d):
    return V.answered(turns(spark, d))


def compress_state(spark, d):
    return V.compressed(turns(spark, d), window=2)


def history_budget(spark, d):
    return V.compressed(turns(spark, d), window=6, budget=60).select("conv_id", "n_turns", "history")


# ---- pages: the links of extracted documents as anchors; and a small site ------------------------

_SITE = [
    ("https://a.test/", '<html><head><title>Start — Site</title></head><body><nav><a href="/x.html">x</a></nav><main><h1>Start</h1><p>See <a href="/b.html#top">b</a>, <a href="https://a.test/c.html">c</a>.</p></main></body></html>'),
    ("https://a.test/b.html", '<main><h1>B</h1><table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td></tr></table><p><b>Bold</b> and <a href="/">home</a><p>Next</main><script>"</p>"</script>'),
    ("https://a.test/c.html", '<article><h2>C</h2><pre class="highlight-python"><code>x = 1</code></pre><a href="/d.pdf">d</a> <a href="mailto:x@y">m</a> <a href="/b.html">b</a></article>'),
    ("https://a.test/x.html", "<main><p>Off the path</p><a href='https://other.test/z.html'>z</a></main>"),
    ("https://other.test/z.html", "<p>Elsewhere</p>"),
]
_MARKDOWN_LINK = r"\[([^\]]+)\]\(([^) \n]*)\)"


def _site(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(_SITE)], "page_id long, url string, html string")


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extracted_documents").where("document_id is not null").dropDuplicates(["document_id"])
    return docs.select("document_id", F.col("metadata")["source_url"].alias("url"), F.regexp_replace("markdown", _MARKDOWN_LINK, '<a href="$2">$1</a>').alias("html")).where("url is not null")


def page_links(spark, d):
    return L.discover(_anchored(spark, d))


def link_graph_bfs(spark, d):
    site = _site(spark).select("url", "html")
    return L.crawl(spark.createDataFrame([("https://a.test/",)], "url string"), lambda f: f.join(site, "url", "left")).select("url", "level")


def robots_allowed(spark, d):
    """Pages that their site may be asked for; a third of the sites forbid one topic, others have no rules."""
    urls = _anchored(spark, d).select("document_id", "url")
    files = lambda f: f.withColumn("html", F.when(F.length(L.host(F.col("url"))) % 3 == 0, F.lit("User-agent: *\nDisallow: /mask-tricks\nAllow: /")))
    return L.allowed(urls, L.robots(urls, files)).select("document_id")


def html_to_text(spark, d):
    return H.extract(_site(spark)).select("page_id", "markdown", F.col("metadata")["title"].alias("title"))


def page_titles(spark, d):
    """Titles as the extraction reads them."""
    docs = table(spark, d, "extracted_documents").where("document_id is not null").dropDuplicates(["document_id"])
    title = F.regexp_replace(F.coalesce(F.col("metadata")["title"], F.lit("")), "[<>&]", "")
    pages = docs.select(F.col("document_id").alias("page_id"), F.lit("https://a.test/").alias("url"), F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><main><p>x</p></main></body></html>")).alias("html"))
    return H.extract(pages).select("page_id", F.coalesce(F.col("metadata")["title"], F.lit("")).alias("title"))


# ---- boxes: lines of orders as figures and captions of pages ---------------------------------------

_LINES = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice)"
_FIGURE = ["l_partkey % 500", "(l_suppkey * 37 + l_linenumber * 71) % 800", "l_partkey % 500 + 40 + l_suppkey % 60", "(l_suppkey * 37 + l_linenumber * 71) % 800 + 30 + l_partkey % 50"]
_CAPTION = ["l_suppkey % 400", "l_partkey * 13 % 900", "l_suppkey % 400 + 80", "l_partkey * 13 % 900 + 12"]


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # lines are numbered by themselves first: what else is selected beside a window is made, and shuffled, before it
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", f"cast({_LINES} AS bigint) AS n")
    of = lambda parts, i: lines.selectExpr("l_orderkey AS page_id", f"n AS {i}", f"array({', '.join(f'cast({p} AS double)' for p in parts)}) AS box")
    return of(_FIGURE, "fig_id"), of(_CAPTION, "cap_id")


def figure_cluster(spark, d):
    return Y.cluster_figures(_boxes(spark, d)[0])


def nearest_caption(spark, d):
    return Y.pair_captions(*_boxes(spark, d)).select("page_id", "fig_id", F.coalesce("cap_id", F.lit(-1)).alias("cap_id"))


def captions_in_band(spark, d):
    f, c = _boxes(spark, d)
    clusters = f.select("page_id", F.col("fig_id").alias("cluster"), F.get("box", 1).alias("top"), F.get("box", 3).alias("bottom"))
    return Y.captions_in_band(clusters, c)


def caption_context(spark, d):
    f, c = _boxes(spark, d)
    b = Y.nearest_figure_above(c, f)
    return b.select("page_id", "cap_id", *[F.get("box", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def envelopes(spark, d):
    """Boxes of polygons with three corners, some with numbers missing, in points of their page."""
    f = _boxes(spark, d)[0]
    x0, y0, x1, y1 = (F.get("box", i) for i in range(4))
    polygon = F.when(F.col("fig_id") % 7 == 0, F.array(x0, y0, x1)).otherwise(F.array(x1, y0, x0, y1, x1, y1 - 1))
    e = Y.envelope(F.col("polygon"))
    pts = Y.to_points(e, F.lit(595.0), F.lit(842.0))
    return f.select("page_id", "fig_id", polygon.alias("polygon")).select("page_id", "fig_id", *[F.round(F.get(pts, i), 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def page_assembly(spark, d):
    p = table(spark, d, "lineitem").selectExpr("cast(l_orderkey AS string) AS source_id", f"{_LINES} AS page", "concat('  ', nullif(l_returnflag, 'N'), ' ', l_linestatus, ' ') AS text")
    return Y.assemble(p)


# ---- replies: a model's replies made of stored answers ----------------------------------------------


def _replies(spark: SparkSession, d: str, raw: F.Column) -> DataFrame:
    r = table(spark, d, "rag_results").where("result_id is not null").dropDuplicates(["result_id"])
    return r.select(F.col("result_id").alias("id"), raw.alias("raw"))


def rewrite_parse(spark, d):
    i, said = F.col("result_id") % 6, F.to_json(F.struct(F.col("query").alias("rewritten"), "sub_queries"))
    raw = (
        F.when(i == 0, F.concat(F.lit("Sure: "), said, F.lit(" done"))).when(i == 1, F.lit('```json\n{"rewritten": 5, "sub_queries": []}\n```')).when(i == 2, F.col("answer")).when(i == 4, F.lit('{"rewritten": "", "sub_queries": "x"}')).when(i == 5, said)
    )
    r = P.rewritten(F.col("raw"), F.lit("original"))
    return _replies(spark, d, raw).select("id", r["rewritten"].alias("rewritten"), F.array_join(r["sub_queries"], "|").alias("sub_queries"))


def verdict_parse(spark, d):
    i, answer = F.col("result_id") % 4, F.coalesce("answer", F.lit(""))
    raw = F.when(i == 0, F.concat(answer, F.lit("\nVERDICT: HORS-CONTEXTE"))).when(i == 1, F.concat(F.lit("VERDICT : ancré\nVERDICT: HORS\n"), answer)).when(i == 2, F.concat(answer, F.lit("\n  hors-contexte"))).otherwise(answer)
    return _replies(spark, d, raw).select("id", P.grounded(F.col("raw")).alias("grounded"))


def correctness_parse(spark, d):
    return _replies(spark, d, F.col("answer")).select("id", P.grade(F.col("raw")).alias("grade"))


QUERIES = {
    "dialogue_turns": dialogue_turns,
    "history_last_n": history_last_n,
    "conversation_pairs": conversation_pairs,
    "compress_state": compress_state,
    "history_budget": history_budget,
    "page_links": page_links,
    "link_graph_bfs": link_graph_bfs,
    "robots_allowed": robots_allowed,
    "html_to_text": html_to_text,
    "page_titles": page_titles,
    "figure_cluster": figure_cluster,
    "nearest_caption": nearest_caption,
    "captions_in_band": captions_in_band,
    "caption_context": caption_context,
    "envelopes": envelopes,
    "page_assembly": page_assembly,
    "rewrite_parse": rewrite_parse,
    "verdict_parse": verdict_parse,
    "correctness_parse": correctness_parse,
}


_TURNS = r"""WITH x AS (SELECT doc_id AS conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS turn FROM documents),
t AS (SELECT conv_id, turn, lower(regexp_extract(line, '^(\w+): ', 1)) AS role, regexp_extract(line, '^\w+: (.*)$', 1) AS text FROM x WHERE regexp_matches(line, '^(?:Student|Tutor): '))"""
_PAGES = "(VALUES " + ", ".join("({}, '{}', '{}')".format(i, u, h.replace("'", "''")) for i, (u, h) in enumerate(_SITE)) + ") AS t(page_id, url, html)"
_HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']"""
_D = "d AS (SELECT DISTINCT ON (document_id) document_id, markdown, metadata FROM extracted_documents WHERE document_id IS NOT NULL)"


def _links(pages: str) -> str:
    """(url, position, link) of pages (url, html)."""
    return f"""m AS (SELECT url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{_HREF}', 1), 1) - 1 AS position FROM {pages}),
k AS (SELECT url, position, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^https?://[^/]+', 0) || href ELSE regexp_extract(url, '^.*/', 0) || href END AS link
 FROM m WHERE NOT regexp_matches(lower(trim(href)), '^(?:mailto:|javascript:|tel:|#|$)'))"""


def _lines(parts: list[str], i: str) -> str:
    box = ", ".join(f"({p})::DOUBLE" for p in parts)
    return f"(SELECT l_orderkey AS page_id, {_LINES} AS {i}, [{box}] AS box FROM lineitem)"


_F, _C = _lines(_FIGURE, "fig_id"), _lines(_CAPTION, "cap_id")
_R = "r AS (SELECT DISTINCT ON (result_id) result_id AS id, query, sub_queries, answer FROM rag_results WHERE result_id IS NOT NULL)"
ORACLES = {
    "dialogue_turns": _TURNS + f" SELECT conv_id, turn, role, floor(len({tokens('text')}) * 1.3::DOUBLE)::INT AS n_tokens FROM t",
    "history_last_n": _TURNS + f", l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) SELECT conv_id, '{V.RECENT}' || chr(10) || string_agg(CASE role WHEN 'student' THEN 'Student' ELSE 'Tutor' END || ' : ' || text, chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id",
    "conversation_pairs": _TURNS + ", b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t) SELECT conv_id, count(*) AS n_answers FROM b WHERE role = 'tutor' AND before = 'student' GROUP BY conv_id",
    "page_links": f"WITH {_D}, h AS (SELECT metadata['source_url'] AS url, regexp_replace(markdown, '{_MARKDOWN_LINK}', '<a href=\"\\2\">\\1</a>', 'g') AS html FROM d WHERE metadata['source_url'] IS NOT NULL), {_links('h')} SELECT url, position, link FROM k",
    "link_graph_bfs": f"""WITH RECURSIVE p AS (SELECT * FROM {_PAGES}), {_links('p')}, e AS (SELECT DISTINCT url, regexp_replace(link, '#.*', '') AS link FROM k WHERE link LIKE 'https://a.test/%' AND link NOT LIKE '%.pdf'),
b AS (SELECT 'https://a.test/' AS url, 0 AS level UNION SELECT e.link, b.level + 1 FROM b JOIN e ON e.url = b.url WHERE b.level < 6) SELECT b.url, min(level) AS level FROM b JOIN p ON p.url = b.url GROUP BY b.url""",
    "robots_allowed": f"""WITH {_D}, u AS (SELECT document_id, metadata['source_url'] AS url FROM d WHERE metadata['source_url'] IS NOT NULL),
h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host FROM u)
SELECT document_id FROM h WHERE NOT (length(host) % 3 = 0 AND regexp_matches(url, '^[^:]+://[^/]+/mask-tricks'))""",
    "page_titles": f"WITH {_D} SELECT document_id AS page_id, trim(regexp_replace(regexp_replace(coalesce(metadata['title'], ''), '[<>&]', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS title FROM d",
    "figure_cluster": f"""WITH RECURSIVE o AS (SELECT page_id, fig_id, box[2] AS y0, box[4] AS y1, row_number() OVER (PARTITION BY page_id ORDER BY box[2], box[1], fig_id) AS rn FROM {_F}),
s AS (SELECT page_id, rn, fig_id, [{{'a': y0, 'b': y1}}] AS bands, 0::BIGINT AS cluster FROM o WHERE rn = 1 UNION ALL
 SELECT page_id, rn, fig_id, CASE WHEN k IS NULL THEN list_append(bands, {{'a': y0, 'b': y1}}) ELSE list_transform(bands, lambda x, i: CASE WHEN i = k THEN {{'a': least(x.a, y0), 'b': greatest(x.b, y1)}} ELSE x END) END,
  CASE WHEN k IS NULL THEN len(bands) ELSE k - 1 END FROM (SELECT o.*, s.bands, nullif(list_position(list_transform(s.bands, lambda x: o.y0 < x.b + 40 AND o.y1 > x.a - 40), true), 0) AS k FROM s JOIN o ON o.page_id = s.page_id AND o.rn = s.rn + 1))
SELECT page_id, fig_id, cluster FROM s""",
    "nearest_caption": f"""WITH RECURSIVE f AS (SELECT * FROM {_F}), c AS (SELECT page_id, list({{'id': cap_id, 'x0': box[1], 'y0': box[2], 'x1': box[3]}} ORDER BY cap_id) AS caps FROM {_C} GROUP BY page_id),
s AS (SELECT page_id, 0::BIGINT AS fig_id, NULL::BIGINT AS cap_id, []::BIGINT[] AS used FROM c UNION ALL
 SELECT page_id, fig_id, near.id, CASE WHEN near IS NULL THEN used ELSE list_append(used, near.id) END FROM (SELECT f.page_id, f.fig_id, s.used,
  list_min(list_transform(list_filter(c.caps, lambda x: NOT list_contains(s.used, x.id) AND least(f.box[3], x.x1) - greatest(f.box[1], x.x0) > 0 AND x.y0 - f.box[4] >= -10), lambda x: {{'g': x.y0 - f.box[4], 'id': x.id}})) AS near
  FROM s JOIN f ON f.page_id = s.page_id AND f.fig_id = s.fig_id + 1 JOIN c ON c.page_id = f.page_id))
SELECT page_id, fig_id, coalesce(cap_id, -1) AS cap_id FROM s WHERE fig_id > 0""",
    "captions_in_band": f"SELECT f.page_id, fig_id AS cluster, cap_id FROM {_F} f JOIN {_C} c ON f.page_id = c.page_id AND c.box[2] BETWEEN f.box[2] - 10 AND f.box[4] + 80",
    "caption_context": f"""WITH f AS (SELECT * FROM {_F}), c AS (SELECT * FROM {_C}), b AS (SELECT c.page_id, cap_id, c.box AS cb, f.box AS fb FROM c LEFT JOIN f ON f.page_id = c.page_id AND c.box[2] - f.box[4] >= -10
 QUALIFY row_number() OVER (PARTITION BY c.page_id, cap_id ORDER BY c.box[2] - f.box[4], f.box) = 1)
SELECT page_id, cap_id, CASE WHEN fb IS NULL THEN cb[1] ELSE least(fb[1], cb[1]) END AS x0, CASE WHEN fb IS NULL THEN greatest(0, cb[2] - 30) ELSE least(fb[2], cb[2]) END AS y0, CASE WHEN fb IS NULL THEN cb[3] ELSE greatest(fb[3], cb[3]) END AS x1, CASE WHEN fb IS NULL THEN cb[4] + 15 ELSE greatest(fb[4], cb[4]) END AS y1 FROM b""",
    "envelopes": f"""WITH f AS (SELECT page_id, fig_id, CASE WHEN fig_id % 7 <> 0 THEN box END AS b FROM {_F})
SELECT page_id, fig_id, round(least(b[1], b[3]) * 595 / 1000, 6) AS x0, round(least(b[2], b[4] - 1) * 842 / 1000, 6) AS y0, round(greatest(b[1], b[3]) * 595 / 1000, 6) AS x1, round(greatest(b[2], b[4]) * 842 / 1000, 6) AS y1 FROM f""",
    "page_assembly": f"""WITH p AS (SELECT l_orderkey::VARCHAR AS source_id, {_LINES} AS page, '  ' || nullif(l_returnflag, 'N') || ' ' || l_linestatus || ' ' AS text FROM lineitem)
SELECT source_id, string_agg('<!-- loc page=' || page || ' -->' || chr(10) || chr(10) || trim(coalesce(text, '')), chr(10) || chr(10) ORDER BY page) AS markdown FROM p GROUP BY source_id""",
    "rewrite_parse": "WITH " + _R
    + r""", w AS (SELECT id, CASE id % 6 WHEN 0 THEN 'Sure: ' || json_object('rewritten', query, 'sub_queries', sub_queries) || ' done' WHEN 1 THEN '```json' || chr(10) || '{"rewritten": 5, "sub_queries": []}' || chr(10) || '```' WHEN 2 THEN answer
 WHEN 4 THEN '{"rewritten": "", "sub_queries": "x"}' WHEN 5 THEN json_object('rewritten', query, 'sub_queries', sub_queries)::VARCHAR END AS raw FROM r), j AS (SELECT id, TRY_CAST(nullif(regexp_extract(coalesce(raw, ''), '(?s)\{.*\}'), '') AS JSON) AS v FROM w)
SELECT id, coalesce(CASE WHEN json_type(v, '$.rewritten') = 'VARCHAR' THEN nullif(trim(v->>'$.rewritten'), '') END, 'original') AS rewritten,
 CASE WHEN json_type(v, '$.sub_queries') = 'ARRAY' THEN array_to_string(list_filter((v->'$.sub_queries')::VARCHAR[], lambda x: trim(x) <> ''), '|') ELSE '' END AS sub_queries FROM j""",
    "verdict_parse": "WITH " + _R
    + r""", w AS (SELECT id, CASE id % 4 WHEN 0 THEN coalesce(answer, '') || chr(10) || 'VERDICT: HORS-CONTEXTE' WHEN 1 THEN 'VERDICT : ancré' || chr(10) || 'VERDICT: HORS' || chr(10) || coalesce(answer, '') WHEN 2 THEN coalesce(answer, '') || chr(10) || '  hors-contexte' ELSE coalesce(answer, '') END AS raw FROM r),
s AS (SELECT id, upper(regexp_extract(raw, '(?i)VERDICT\s*:\s*(ANCR|HORS)', 1)) AS st, list_filter(list_transform(string_split(raw, chr(10)), lambda x: upper(trim(x))), lambda x: x LIKE 'ANCR%' OR x LIKE 'HORS%')[-1] AS last FROM w)
SELECT id, CASE WHEN st = 'ANCR' THEN true WHEN st = 'HORS' THEN false ELSE coalesce(last LIKE 'ANCR%', true) END AS grounded FROM s""",
    "correctness_parse": "WITH " + _R + " SELECT id, CASE WHEN regexp_extract(coalesce(answer, ''), '[1-5]') <> '' THEN regexp_extract(answer, '[1-5]')::INT / 5 END AS grade FROM r",
}
