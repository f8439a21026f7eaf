"""Pieces of DuckDB SQL shared by the oracles."""

from __future__ import annotations

# the blanks that Unicode knows, spelt out
SPACE = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{SPACE}+'), lambda x: x <> '')"


def words(text: str, least: int = 4) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{{least},}}'))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) ELSE 0 END"


#: each question whose id is divisible by 20, each chunk once, with postings and weights
SEARCH = f"""WITH q AS MATERIALIZED (SELECT DISTINCT result_id AS qid, query AS question FROM rag_results WHERE result_id % 20 = 0),
c AS MATERIALIZED (SELECT DISTINCT child_id, parent_id, text, source_type FROM children),
tok AS MATERIALIZED (SELECT child_id, {tokens('text')} AS t FROM c),
post AS MATERIALIZED (SELECT child_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT child_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY child_id, term),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM c) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
stats AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS MATERIALIZED (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({tokens('question')}) AS term FROM q) GROUP BY ALL),
bm AS MATERIALIZED (SELECT qid, child_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(t)) FROM tok)))), 6) AS score
  FROM asked JOIN post USING (term) JOIN stats USING (term) GROUP BY ALL),
bmk AS MATERIALIZED (SELECT qid, child_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM bm QUALIFY rank <= 20),
dn AS (SELECT child_id, sqrt(sum(tf::DOUBLE * tf)) AS n FROM post GROUP BY ALL), qn AS (SELECT qid, sqrt(sum(times::DOUBLE * times)) AS n FROM asked GROUP BY ALL),
dot AS (SELECT qid, child_id, sum(times * tf)::DOUBLE AS dot FROM asked JOIN post USING (term) GROUP BY ALL),
cosk AS MATERIALIZED (SELECT qid, child_id, round(dot / (dn.n * qn.n), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(dot / (dn.n * qn.n), 6) DESC, child_id) AS rank
  FROM dot JOIN dn USING (child_id) JOIN qn USING (qid) QUALIFY rank <= 20)
"""


def fused(alpha: float, top: int, name: str = "fused") -> str:
    return f""", {name}_x AS (SELECT qid, child_id, {alpha}::DOUBLE / (60 + rank) AS x FROM cosk UNION ALL SELECT qid, child_id, {round(1 - alpha, 10)}::DOUBLE / (60 + rank) FROM bmk),
{name} AS (SELECT qid, parent_id, text, min(child_id) AS child_id, round(sum(x), 9) AS score,
  row_number() OVER (PARTITION BY qid ORDER BY round(sum(x), 9) DESC, min(child_id)) AS rank FROM {name}_x JOIN c USING (child_id) GROUP BY qid, parent_id, text QUALIFY rank <= {top})
"""


LEXICAL = f"CASE WHEN len({words('question', 3)}) > 0 THEN len(list_intersect({words('question', 3)}, {words('text', 3)}))::DOUBLE / len({words('question', 3)}) ELSE 0 END"
RERANKED = f""", scored AS (SELECT qid, parent_id, child_id, rank AS before, round({LEXICAL}, 6) AS score FROM fused JOIN q USING (qid)),
reranked AS (SELECT qid, parent_id, child_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM scored QUALIFY rank <= 18)
"""


def lifted(source: str, k: int = 4) -> str:
    return f""", one AS (SELECT qid, parent_id, score, rank AS child_rank FROM {source} QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank) = 1),
p AS (SELECT DISTINCT parent_id, source, source_type, section, source_url, title, source_id FROM parents),
lifted AS (SELECT one.*, p.* EXCLUDE (parent_id), row_number() OVER (PARTITION BY qid ORDER BY child_rank, parent_id) AS rank FROM one JOIN p USING (parent_id) QUALIFY rank <= {k})
"""


LABEL = r"""CASE WHEN coalesce(nullif(source_type, ''), 'web') = 'pdf' THEN 'pdf · ' || coalesce(nullif(source_id, ''), coalesce(source, 'document') || '.pdf')
 ELSE coalesce(nullif(source_type, ''), 'web') || ' · ' || coalesce(nullif(regexp_extract(coalesce(source_url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ''), '?') ||
 CASE WHEN coalesce(trim(title), '') <> '' AND regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_]+', '', 'g') <> regexp_replace(lower(coalesce(trim(section), '')), '[^\p{L}\p{N}_]+', '', 'g') THEN ' · « ' || trim(title) || ' »' ELSE '' END END
 || CASE WHEN coalesce(trim(section), '') <> '' THEN ' · §' || trim(section) ELSE '' END"""
