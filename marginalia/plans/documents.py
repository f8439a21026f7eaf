"""Queries over normalisation, chunking and links, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import links as L
from ..operators import normalize as N
from ..session import table
from ..sources import corpus
from .sql import SPACE, tokens, words


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_documents").where("document_id is not null").select("document_id", "markdown", "metadata").dropDuplicates(["document_id"])


def _step(make, before=lambda c: c):
    """A query that applies one normalisation step to all extracted documents."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _extracted(spark, d).select("document_id", make(before(F.col("markdown"))).alias("body"))

    return run


def _old_pages(c):
    return F.replace(c, F.lit("<!-- loc page="), F.lit("<!-- page "))


def _old_figures(c):
    return F.concat(c, F.lit("\n--- [INTERPRETATION DE LA FIGURE] ---\n  a curve \n--- [FIN INTERPRETATION] ---\n"))


def _pipes(c):
    return F.replace(c, F.lit("\n\n"), F.lit("\n |\n"))


def front_matter(spark, d):
    docs = _extracted(spark, d)
    file = F.concat(N.render_front_matter(F.col("metadata"), F.lit("web"), F.col("document_id").cast("string")), F.lit("\n"), F.coalesce("markdown", F.lit("")))
    f = docs.select("document_id", file.alias("raw")).withColumn("meta", N.front_matter(F.col("raw")))
    return f.select("document_id", F.size("meta").alias("n_keys"), F.col("meta")["title"].alias("title"), F.col("meta")["source_type"].alias("source_type"), F.col("meta")["source"].alias("source"), F.length(N.body(F.col("raw"))).alias("n_chars"))


def source_types(spark, d):
    return _extracted(spark, d).select("document_id", N.source_type(F.col("metadata"), F.coalesce("markdown", F.lit(""))).alias("source_type"))


def _documents(spark, d):
    e = _extracted(spark, d)
    meta = lambda k: F.col("metadata")[k]
    return e.select(
        F.col("document_id").cast("string").alias("doc_key"), F.concat(F.lit("doc"), F.lpad(F.col("document_id").cast("string"), 8, "0")).alias("source"), N.source_type(F.col("metadata"), F.coalesce("markdown", F.lit(""))).alias("source_type"),
        meta("source_url").alias("source_url"), meta("title").alias("title"), meta("source_id").alias("source_id"), F.col("markdown").alias("body"),
    )


def normalized(spark, d):
    return _extracted(spark, d).select("document_id", N.normalize_body(F.col("markdown")).alias("body"))


def cleaned_web(spark, d):
    return _extracted(spark, d).where(F.col("metadata")["source_url"].isNotNull()).select("document_id", N.clean_web(F.col("markdown")).alias("body"))


def sections(spark, d):
    of = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return C.chunk(_documents(spark, d))[0].select("parent_id", "sec_no", "section", of("page_start"), of("page_end"), F.length("text").alias("n_chars"))


def chunks(spark, d):
    return C.chunk(_documents(spark, d))[1].select("child_id", "parent_id", "child_no", F.coalesce("page", F.lit(-1)).alias("page"), "child_type", "text", "embed_text")


def _children(spark, d):
    return table(spark, d, "children").select("child_id", "parent_id", "child_no", "source", "source_type", "section", "page", "child_type", "text").dropDuplicates(["child_id"])


def embed_text(spark, d):
    return C.with_embed_text(_children(spark, d)).select("child_id", "embed_text")


def chunk_stats(spark, d):
    return C.statistics(_children(spark, d))


def child_types(spark, d):
    return _children(spark, d).groupBy("child_type").agg(F.count("*").alias("n"))


def word_figures(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.word_count(t).alias("n_words"), F.size(T.word_set(t)).alias("n_distinct"), T.token_estimate(t).alias("n_tokens"))


def _urls(spark, d):
    return table(spark, d, "extracted_documents").select(F.col("metadata")["source_url"].alias("url"), F.col("metadata")["title"].alias("title"), "document_id").where("url is not null").dropDuplicates(["document_id"])


def url_parts(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("document_id", L.host(u).alias("host"), L.normal(F.concat(u, F.lit("#top"))).alias("url"), L.default_prefix(u).alias("prefix"), L.slug(u, F.col("title")).alias("slug"))


def url_scope(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("document_id", L.in_scope(u, F.lit("ember-campus1.invalid"), F.lit("/warmup-notes")).alias("in_scope"), L.is_content(u, r"/(?:mask|loss)-[a-z]+/").alias("is_content"))


def markdown_links(spark, d):
    return L.markdown_links(_extracted(spark, d), "document_id", "markdown")


def rendered_files(spark, d):
    return corpus.rendered(_documents(spark, d)).select("source", F.length("file").alias("n_chars"), F.substring("file", 1, 3).alias("opening"))


def extracted_parents(spark, d):
    """Sections whose key is missing from the stored ones, and the reverse (anti joins)."""
    p, c = table(spark, d, "parents").select("parent_id").distinct(), table(spark, d, "children").select("parent_id").distinct()
    return p.join(c, "parent_id", "left_anti").withColumn("side", F.lit("parents")).unionByName(c.join(p, "parent_id", "left_anti").withColumn("side", F.lit("children")))


QUERIES = {
    "unify_pages": _step(N.unify_pages, _old_pages),
    "unify_figures": _step(N.unify_figures, _old_figures),
    "unify_headers": _step(N.unify_headers),
    "orphan_pipes": _step(N.strip_orphan_pipes, _pipes),
    "tidy": _step(N.tidy),
    "clean_images": _step(N.drop_images),
    "clean_links": _step(N.links_to_text),
    "clean_emojis": _step(N.drop_emojis),
    "clean_math": _step(N.unify_math),
    "drop_exercises": _step(N.drop_exercises),
    "squeeze_blanks": _step(N.squeeze_blanks),
    "html_tables": _step(N.unify_tables),
    "normalize_body": normalized,
    "clean_web": cleaned_web,
    "front_matter": front_matter,
    "source_types": source_types,
    "sections": sections,
    "chunks": chunks,
    "embed_text": embed_text,
    "chunk_stats": chunk_stats,
    "child_types": child_types,
    "word_figures": word_figures,
    "url_parts": url_parts,
    "url_scope": url_scope,
    "markdown_links": markdown_links,
    "rendered_files": rendered_files,
    "unmatched_sections": extracted_parents,
}

_E = "WITH e AS (SELECT DISTINCT ON (document_id) document_id, markdown, metadata FROM extracted_documents WHERE document_id IS NOT NULL) "
_ENDS = "regexp_replace({}, '\\A" + SPACE + "+|" + SPACE + "+\\z', '', 'g') || chr(10)"
_TIDY = _ENDS.replace("{}", r"regexp_replace(regexp_replace(nfc_normalize(markdown), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_SQUEEZE = _ENDS.replace("{}", r"regexp_replace(regexp_replace(nfc_normalize(markdown), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_MATH = r"regexp_replace(regexp_replace(markdown, '(?s)\\\[(.*?)\\\]', '$$\1$$', 'g'), '(?s)\\\((.*?)\\\)', '$\1$', 'g')"
for _macro, _meaning in N.MACROS.items():
    _MATH = f"replace({_MATH}, '{_macro}', '{_meaning}')"
_LINES = "l AS (SELECT document_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM e)"
_HEAD = r"'^(\d+(?:\.\d+)*)-(?:\.(\d+))?[ \t\f\r]+(\S.*)$'"
_U = "WITH u AS (SELECT DISTINCT ON (document_id) document_id, metadata['source_url'] AS url, metadata['title'] AS title FROM extracted_documents WHERE metadata['source_url'] IS NOT NULL), "
_P = r"""p AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM u), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
t AS (SELECT *, regexp_replace(coalesce(parts[-1], ''), '\.[A-Za-z0-9]+$', '') AS stem, coalesce(parts[-2], '') AS parent, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS named FROM s) """
_KIDS = "WITH c AS (SELECT DISTINCT ON (child_id) * FROM children) "


def _body(expression: str) -> str:
    return _E + f"SELECT document_id, {expression} AS body FROM e"


# blocks that are never cut, in one pattern: of those that overlap, the first to start wins
_PAGE = r"(?:(?im)^<!--\s*loc\s+page=\d+\s*-->\s*$)"
_BLOCK = _PAGE + r"|(?:(?s)\$\$.*?\$\$)|(?:(?is)---\s*\[FIGURE\]\s*---.*?---\s*\[/FIGURE\]\s*---)|(?:(?s)```.*?```)|(?:(?m)(?:^\|[^\n]*\|[ \t]*\n){2,})"
_SECTIONS = _E + rf""", b AS (SELECT document_id, regexp_extract_all(markdown, '{_BLOCK}') AS blocks, regexp_extract_all(regexp_replace(markdown, '{_BLOCK}', chr(1), 'g'), chr(1) || '|[^\n' || chr(1) || ']*\n|[^\n' || chr(1) || ']+') AS parts FROM e WHERE markdown IS NOT NULL),
p AS (SELECT document_id, blocks, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM b),
q AS (SELECT *, CASE WHEN part = chr(1) THEN blocks[count(*) FILTER (part = chr(1)) OVER (PARTITION BY document_id ORDER BY n)] ELSE part END AS text, part <> chr(1) AND regexp_matches(part, '^#{{1,6}}\s+\S') AS opens FROM p),
r AS (SELECT *, CASE WHEN part = chr(1) AND regexp_matches(text, '^{_PAGE}$') THEN regexp_extract(text, '(\d+)', 1)::INT END AS mark FROM q),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY n) AS page, sum(opens::INT) OVER (PARTITION BY document_id ORDER BY n) AS sec FROM r),
t AS (SELECT *, min(CASE WHEN mark IS NULL THEN n END) OVER (PARTITION BY document_id, sec) AS begins FROM s),
g AS (SELECT document_id, sec, coalesce(any_value(CASE WHEN opens THEN trim(ltrim(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '#'), ' ' || chr(9)) END), 'preambule') AS section, arg_min(page, n) FILTER (page IS NOT NULL) AS page_start, arg_max(page, n) FILTER (page IS NOT NULL) AS page_end,
 string_agg(CASE WHEN mark IS NULL THEN text END, '' ORDER BY n) AS body FROM t WHERE n >= begins GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sec) - 1 AS sec_no, regexp_replace(body, '\A{SPACE}+|{SPACE}+\z', '', 'g') AS whole FROM g)
"""
_SECTION_ROWS = _SECTIONS + """ SELECT printf('doc%08d__sec%03d', document_id, sec_no) AS parent_id, sec_no, section, coalesce(page_start, -1) AS page_start, coalesce(page_end, -1) AS page_end, len(whole) AS n_chars FROM o WHERE whole <> ''"""
def _strip(t: str) -> str:
    return rf"regexp_replace({t}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


# units of a section: blocks, and paragraphs of prose, the long ones as runs of sentences; then a walk over them
_CHUNK_ROWS = _SECTIONS.replace("WITH e", "WITH RECURSIVE e", 1) + (
    rf""", k1 AS (SELECT document_id, sec, n, text, page, CASE WHEN mark IS NOT NULL THEN 'page' WHEN part <> chr(1) THEN 'prose' WHEN text LIKE '$$%' THEN 'formula' WHEN text LIKE '```%' THEN 'code_block' WHEN text LIKE '|%' THEN 'table' ELSE 'figure' END AS kind FROM t WHERE n >= begins),
k2 AS (SELECT *, lag(kind) OVER (PARTITION BY document_id, sec ORDER BY n) AS before FROM k1),
k3 AS (SELECT *, sum(CASE WHEN kind = 'prose' AND before = 'prose' THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, sec ORDER BY n) AS run FROM k2),
k4 AS (SELECT document_id, sec, run, kind, first(page ORDER BY n) AS page, string_agg(text, '' ORDER BY n) AS body FROM k3 WHERE kind <> 'page' GROUP BY document_id, sec, run, kind),
u1 AS (SELECT document_id, sec, run, kind, page, CASE WHEN kind = 'prose' THEN string_split_regex(body, '
{SPACE}*
') ELSE [body] END AS pp FROM k4),
u2 AS (SELECT document_id, sec, run, kind, page, unnest(pp) AS para, generate_subscripts(pp, 1) AS pi FROM u1),
u3 AS (SELECT *, CASE WHEN kind <> 'prose' THEN [para] WHEN len(para) <= 750 THEN [{_strip('para')} || chr(10) || chr(10)]
 ELSE list_filter(list_reduce(list_transform(string_split(regexp_replace(para, '([.!?]){SPACE}+', '\1' || chr(2), 'g'), chr(2)), lambda x: [x]), lambda acc, x: CASE WHEN len(acc[-1]) + len(x[1]) <= 750 THEN list_append(acc[:-2], {_strip("acc[-1] || ' ' || x[1]")}) ELSE list_append(acc, x[1]) END, ['']), lambda x: x <> '') END AS us FROM u2 WHERE kind <> 'prose' OR {_strip('para')} <> ''),
u4 AS (SELECT document_id, sec, run, kind, page, pi, unnest(us) AS unit, generate_subscripts(us, 1) AS ui, len(us) AS nu, len(para) AS np FROM u3),
u5 AS (SELECT document_id, sec, kind, page, CASE WHEN kind <> 'prose' OR np <= 750 THEN unit WHEN ui < nu THEN unit || ' ' ELSE unit || chr(10) || chr(10) END AS unit, row_number() OVER (PARTITION BY document_id, sec ORDER BY run, pi, ui) AS rn FROM u4),
w AS (SELECT document_id, sec, rn, kind, page, unit, 0 AS child_no, len(unit) AS size, len(unit) >= (CASE kind WHEN 'prose' THEN 750 ELSE 400 END) AS shut FROM u5 WHERE rn = 1 UNION ALL
 SELECT u.document_id, u.sec, u.rn, u.kind, u.page, u.unit, w.child_no + f.fresh::INT, CASE WHEN f.fresh THEN len(u.unit) ELSE w.size + len(u.unit) END, (CASE WHEN f.fresh THEN len(u.unit) ELSE w.size + len(u.unit) END) >= (CASE u.kind WHEN 'prose' THEN 750 ELSE 400 END)
 FROM w JOIN u5 u ON u.document_id = w.document_id AND u.sec = w.sec AND u.rn = w.rn + 1, LATERAL (SELECT w.shut OR w.size + len(u.unit) > 400 AS fresh) f),
y AS (SELECT document_id, sec, child_no, first(page ORDER BY rn) FILTER (page IS NOT NULL) AS page, string_agg(DISTINCT kind, '+' ORDER BY kind) AS child_type, {_strip("string_agg(unit, '' ORDER BY rn)")} AS text FROM w GROUP BY ALL),
x AS (SELECT y.*, o.section, printf('doc%08d', document_id) AS source, printf('doc%08d__sec%03d', document_id, o.sec_no) AS parent_id, lag(text) OVER (PARTITION BY document_id, sec ORDER BY child_no) AS prev FROM y JOIN o USING (document_id, sec) WHERE o.whole <> '')
SELECT parent_id || printf('__c%03d', child_no) AS child_id, parent_id, child_no, coalesce(page, -1) AS page, child_type, text,
 '[' || source || ' | ' || section || ' | page ' || coalesce(page::VARCHAR, '?') || ']' || chr(10) || CASE WHEN prev IS NULL THEN '' ELSE right(prev, 80) || chr(10) END || text AS embed_text FROM x"""
)


def _tables(t: str) -> str:
    """HTML tables of a text as pipe tables: what lies between them, and each of them rewritten."""
    table = r"(?is)<table\b.*?</table>"
    clean = r"trim(regexp_replace(regexp_replace(c, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"
    rows = rf"list_filter(list_transform(regexp_extract_all(t, '(?is)<tr\b.*?(?:</tr>|</table>)'), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1), lambda c: replace({clean}, '|', '\|'))), lambda r: len(r) > 0)"
    width = f"list_max(list_transform({rows}, lambda r: len(r)))"
    line = f"'| ' || array_to_string(list_concat(r, list_transform(range({width} - len(r)), lambda x: '')), ' | ') || ' |'"
    lines = f"list_transform({rows}, lambda r: {line})"
    pipe = f"CASE WHEN len({rows}) = 0 THEN t ELSE ({lines})[1] || chr(10) || '| ' || array_to_string(list_transform(range({width}), lambda x: '---'), ' | ') || ' |' || array_to_string(list_transform(({lines})[2:], lambda x: chr(10) || x), '') END"
    made = f"list_transform(regexp_extract_all({t}, '{table}'), lambda t: {pipe})"
    return f"array_to_string(list_transform(list_zip(string_split_regex({t}, '{table}'), {made}), lambda z: z[1] || coalesce(z[2], '')), '')"


_PAGES_OF = r"regexp_replace(x, '(?im)^<!--\s*page\s+(\d+)\s*-->\s*$', '<!-- loc page=\1 -->', 'g')"
_FIGURES_OF = r"regexp_replace(x, '(?is)---\s*\[INTERPRETATION DE LA FIGURE\]\s*---\s*\n\s*(.*?)\s*---\s*\[FIN INTERPRETATION\]\s*---', '--- [FIGURE] ---' || chr(10) || '\1' || chr(10) || '--- [/FIGURE] ---', 'g')"
_PIPES_OF = r"regexp_replace(x, '(?m)^[ \t]*\|[ \t]*$\n?', '', 'g')"
_NORMALIZED = (
    _E
    + f""", a AS (SELECT document_id, {_PAGES_OF.replace('x,', 'markdown,', 1)} AS x FROM e), b AS (SELECT document_id, {_FIGURES_OF} AS x FROM a), c AS (SELECT document_id, {_tables('x')} AS markdown FROM b), """
    + _LINES.replace("FROM e", "FROM c")
    + f""", h AS (SELECT *, regexp_matches(line, {_HEAD}) AND NOT regexp_matches(line, '[0-9]\\s*$') AND NOT regexp_matches(line, '^#{{1,6}}\\s+\\S') AS old, regexp_extract(line, {_HEAD}, 1) AS num, regexp_extract(line, {_HEAD}, 2) AS sub FROM l),
g AS (SELECT document_id, string_agg(CASE WHEN old THEN repeat('#', least(6, len(num) - len(replace(num, '.', '')) + 2 + (sub <> '')::INT)) || ' ' || trim(line) ELSE line END, chr(10) ORDER BY n) AS x FROM h GROUP BY document_id),
k AS (SELECT document_id, {_PIPES_OF} AS markdown FROM g) SELECT e.document_id, {_TIDY.replace('markdown', 'k.markdown')} AS body FROM e LEFT JOIN k USING (document_id)"""
)
_IMAGES = r"regexp_replace(markdown, '!\[([^\]]*)\]\(([^)]*)\)', '', 'g')"
_EMOJIS = r"replace(regexp_replace(markdown, '[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}]+', '', 'g'), '  ', ' ')"
_DROPPED = r"""m AS (SELECT *, n = max(n) OVER (PARTITION BY document_id) AS last_line, regexp_matches(line, '^#+\s') AS head, regexp_matches(line, '(?i)^#+\s*[\d.]*\s*(?:Exercises?|Problems?)\s*$') AS ex FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY document_id ORDER BY n) AS sec FROM m),
x AS (SELECT *, max((ex AND NOT last_line)::INT) OVER (PARTITION BY document_id, sec) AS dropped FROM s),
y AS (SELECT document_id, coalesce(string_agg(CASE WHEN dropped = 1 THEN NULL WHEN last_line THEN line ELSE line || chr(10) END, '' ORDER BY n), '') AS markdown FROM x GROUP BY document_id)"""
_CLEANED = (
    _E
    + f""", a AS (SELECT document_id, {_IMAGES} AS markdown FROM e WHERE metadata['source_url'] IS NOT NULL), b AS (SELECT document_id, {_MATH} AS markdown FROM a),
c AS (SELECT document_id, regexp_replace(markdown, '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g') AS markdown FROM b), d AS (SELECT document_id, {_EMOJIS} AS markdown FROM c), """
    + _LINES.replace("FROM e", "FROM d")
    + f""", {_DROPPED} SELECT e.document_id, {_SQUEEZE.replace('markdown', 'y.markdown')} AS body FROM e LEFT JOIN y USING (document_id) WHERE metadata['source_url'] IS NOT NULL"""
)
ORACLES = {
    "sections": _SECTION_ROWS,
    "chunks": _CHUNK_ROWS,
    "clean_web": _CLEANED,
    "normalize_body": _NORMALIZED,
    "html_tables": _body(_tables("markdown")),
    "unify_pages": _body(r"regexp_replace(replace(markdown, '<!-- loc page=', '<!-- page '), '(?im)^<!--\s*page\s+(\d+)\s*-->\s*$', '<!-- loc page=\1 -->', 'g')"),
    "unify_figures": _body(
        r"regexp_replace(markdown || chr(10) || '--- [INTERPRETATION DE LA FIGURE] ---' || chr(10) || '  a curve ' || chr(10) || '--- [FIN INTERPRETATION] ---' || chr(10), '(?is)---\s*\[INTERPRETATION DE LA FIGURE\]\s*---\s*\n\s*(.*?)\s*---\s*\[FIN INTERPRETATION\]\s*---', '--- [FIGURE] ---' || chr(10) || '\1' || chr(10) || '--- [/FIGURE] ---', 'g')"
    ),
    "unify_headers": _E
    + f""", {_LINES}, h AS (SELECT *, regexp_matches(line, {_HEAD}) AND NOT regexp_matches(line, '[0-9]\\s*$') AND NOT regexp_matches(line, '^#{{1,6}}\\s+\\S') AS old,
  regexp_extract(line, {_HEAD}, 1) AS num, regexp_extract(line, {_HEAD}, 2) AS sub FROM l)
SELECT document_id, string_agg(CASE WHEN old THEN repeat('#', least(6, len(num) - len(replace(num, '.', '')) + 2 + (sub <> '')::INT)) || ' ' || trim(line) ELSE line END, chr(10) ORDER BY n) AS body FROM h GROUP BY document_id""",
    "orphan_pipes": _body(r"regexp_replace(replace(markdown, chr(10) || chr(10), chr(10) || ' |' || chr(10)), '(?m)^[ \t]*\|[ \t]*$\n?', '', 'g')"),
    "tidy": _body(_TIDY),
    "clean_images": _body(r"regexp_replace(markdown, '!\[([^\]]*)\]\(([^)]*)\)', '', 'g')"),
    "clean_links": _body(r"replace(regexp_replace(replace(markdown, '![', chr(1)), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), chr(1), '![')"),
    "clean_emojis": _body(r"replace(regexp_replace(markdown, '[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}]+', '', 'g'), '  ', ' ')"),
    "clean_math": _body(_MATH),
    "drop_exercises": _E
    + ", "
    + _LINES
    + r""", m AS (SELECT *, n = max(n) OVER (PARTITION BY document_id) AS last_line, regexp_matches(line, '^#+\s') AS head, regexp_matches(line, '(?i)^#+\s*[\d.]*\s*(?:Exercises?|Problems?)\s*$') AS ex FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY document_id ORDER BY n) AS sec FROM m),
x AS (SELECT *, max((ex AND NOT last_line)::INT) OVER (PARTITION BY document_id, sec) AS dropped FROM s)
SELECT document_id, coalesce(string_agg(CASE WHEN dropped = 1 THEN NULL WHEN last_line THEN line ELSE line || chr(10) END, '' ORDER BY n), '') AS body FROM x GROUP BY document_id""",
    "squeeze_blanks": _body(_SQUEEZE),
    "front_matter": _E
    + """SELECT document_id, (cardinality(metadata)::INT + (NOT map_contains(metadata, 'source_type'))::INT + (NOT map_contains(metadata, 'source'))::INT)::INT AS n_keys, metadata['title'] AS title, 'web' AS source_type,
  coalesce(metadata['source'], CAST(document_id AS VARCHAR)) AS source, len(regexp_replace(coalesce(markdown, ''), '\\A\\s+', '')) AS n_chars FROM e""",
    "source_types": _E
    + r"SELECT document_id, CASE WHEN metadata['source_type'] IN ('pdf', 'web') THEN metadata['source_type'] WHEN regexp_matches(coalesce(markdown, ''), '(?m)^<!--\s*source:\s*\S+\s*\|.*-->') OR regexp_matches(coalesce(markdown, ''), '(?im)^<!--\s*(?:loc\s+)?page[=\s]') THEN 'pdf' ELSE 'web' END AS source_type FROM e",
    "embed_text": _KIDS
    + """, l AS (SELECT *, lag(text) OVER (PARTITION BY parent_id ORDER BY child_no) AS prev FROM c)
SELECT child_id, '[' || source || ' | ' || coalesce(section, '') || ' | page ' || coalesce(page::VARCHAR, '?') || ']' || chr(10) || CASE WHEN prev IS NULL THEN '' ELSE right(prev, 80) || chr(10) END || text AS embed_text FROM l""",
    "chunk_stats": _KIDS
    + """, a AS (SELECT source_type, count(*) AS n_children, min(length(text)) AS min_chars, trunc(quantile_cont(length(text), 0.5))::INT AS median_chars, trunc(avg(length(text)))::INT AS mean_chars, max(length(text)) AS max_chars FROM c GROUP BY ALL),
k AS (SELECT source_type, parent_id, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT source_type, count(*) AS n_parents, max(n) AS most_children, trunc(quantile_cont(n, 0.5))::INT AS median_children FROM k GROUP BY ALL)
SELECT a.*, b.* EXCLUDE (source_type) FROM a JOIN b ON a.source_type IS NOT DISTINCT FROM b.source_type""",
    "child_types": _KIDS + "SELECT child_type, count(*) AS n FROM c GROUP BY ALL",
    "word_figures": f"SELECT doc_id, len({tokens('text')}) AS n_words, len({words('text')}) AS n_distinct, floor(len({tokens('text')}) * 1.3::DOUBLE)::INT AS n_tokens FROM documents",
    "url_parts": _U
    + _P
    + r"""SELECT document_id, host, regexp_replace(url || '#top', '#.*$', '') AS url, CASE WHEN host LIKE '%.github.io' AND len(parts) > 0 THEN '/' || parts[1] ELSE '/' END AS prefix,
 CASE WHEN stem = '' OR stem = 'index' THEN CASE WHEN named <> '' THEN named ELSE 'page' END WHEN parent <> '' THEN parent || '_' || stem ELSE stem END AS slug FROM t""",
    "url_scope": _U
    + _P
    + r"SELECT document_id, host = 'ember-campus1.invalid' AND path LIKE '/warmup-notes%' AND NOT list_contains(['"
    + "','".join(L.BINARY)
    + r"'], lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))) AS in_scope, regexp_matches(path, '/(?:mask|loss)-[a-z]+/') AS is_content FROM t",
    "markdown_links": _E
    + r""", m AS (SELECT document_id, regexp_extract_all(replace(coalesce(markdown, ''), '![', chr(1)), '\[[^\]]+\]\([^)]*\)') AS f FROM e),
x AS (SELECT document_id, generate_subscripts(f, 1) - 1 AS position, unnest(f) AS m FROM m)
SELECT document_id, position, replace(regexp_extract(m, '^\[([^\]]+)\]', 1), chr(1), '![') AS label, regexp_extract(m, '\]\(([^)]*)\)$', 1) AS target FROM x""",
    "unmatched_sections": """WITH p AS (SELECT DISTINCT parent_id FROM parents), c AS (SELECT DISTINCT parent_id FROM children)
SELECT parent_id, 'parents' AS side FROM p WHERE parent_id NOT IN (SELECT parent_id FROM c) UNION ALL SELECT parent_id, 'children' FROM c WHERE parent_id NOT IN (SELECT parent_id FROM p)""",
}
