"""Problem 3: residue of HTML, Markdown, wiki and LaTeX markup, turned into clean text.

A tolerant parser reads a text as a tree of candidate nodes: every tag, mark, command or bracket
pair that may be markup, nested by extent. Gradient-boosted trees judge each node by features of
the tree: kind, share of the text in its subtree, attribute tokens, depth, siblings and characters
around. Hierarchical decoding then picks the best consistent set of decisions: nothing inside an
accepted literal node (code, preformatted text, comment) is markup, and nothing inside a bracket
pair judged literal is. Accepted nodes are rendered into headings, lists, fences, tables, formulas
and plain text.

The trees are fitted on a bounded sample of rows (`SAMPLE_ROWS` per table, those with the smallest
hashes). Only nodes that need no judgement are labelled there: whole constructs that hold words, and
marks that can't be markup. All others stay open, and what the trees say of any node is final; no
grammar looks over it again.

Fences, single-backtick code, formulas, page markers and figure lines are never candidates. Null
and empty texts have no markup; a repeated key counts once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .boosting import BoostedTrees

SAMPLE_ROWS = 1_000
FAMILIES = ("html", "markdown", "wiki", "latex")

_MASKED = re.compile(
    r"^[ \t]{0,3}(?P<f>`{3,}|~{3,})[^\n]*(?:\n.*?)??(?:^[ \t]{0,3}(?P=f)[`~]*[ \t]*$|\Z)"
    r"|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|(?<!`)`[^`\n]+`(?!`)|(?<![\\$\w])\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)"
    r"|<!-- loc page=\d+ -->|^--- \[/?FIGURE\] ---[ \t]*$",
    re.S | re.M,
)
_TAGS = frozenset(
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav ol option p path pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
_CANDIDATE = re.compile(
    r"(?=[<&{\[\\~*_!|='`-])(?:(?P<comment><!--(?:(?!<!--).)*?-->)"
    r"|(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)"
    r"|(?P<autolink><(?:https?://|mailto:)[^\s<>]+>)"
    r"|(?P<angle><[^<>\s\d.][^<>\n]*>)"
    r"|(?P<entity>&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});?)"
    r"|(?P<template>\{\{[^{}]+\}\})"
    r"|(?P<wtable>^\{\|[^\n]*|^\|\}[ \t]*$|^\|-[^\n]*$)"
    r"|(?P<wlink>\[\[[^\[\]\n]+(?:\[[^\[\]\n]*\][^\[\]\n]*)?\]\])"
    r"|(?P<image>!\[[^\]\n]*\]\([^()\s]*(?:\([^()\s]*\))?(?:\s+\"[^\"\n]*\")?\))"
    r"|(?P<elink>\[(?:https?|ftp)://[^\s\]]+[ \t][^\[\]\n]+\])"
    r"|(?P<footdef>^\[\^[^\]\s]+\]:)|(?P<foot>\[\^[^\]\s]+\])"
    r"|(?P<refdef>^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S+[^\n]*$)"
    r"|(?P<link>\[(?:[^\[\]\n]|\n(?!\n)|\[[^\[\]\n]*\])+\]\([^()\s]*(?:\([^()\s]*\))?(?:\s+\"[^\"]*\")?\))"
    r"|(?P<reflink>\[[^\[\]\n]+\]\[[^\[\]\n]*\])"
    r"|(?P<wbold>'{2,5}(?=\S)(?:(?!''|\n\s*\n).)+?'{2,5})"
    r"|(?P<lquote>``(?=\S)(?:(?!``|''|\n\s*\n).)+?'')"
    r"|(?P<env>\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*)"
    r"|(?P<group>\{\\(?:it|bf|em|tt|sc|rm|sf|sl|small|large|Large|tiny|footnotesize)\b[^{}]*\})"
    r"|(?P<command>~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}]|\{[^{}]*\})*\})?)"
    r"|(?P<escape>\\[\\`*_{}\[\]()#+\-.!|~<>$%&])"
    r"|(?P<strike>~~(?=\S)(?:(?!~~|\n\n).)+?(?<=\S)~~)"
    r"|(?P<strong>(?P<s>\*{1,3}|_{1,3})(?=\S)(?:(?!\n\s*\n)(?!(?P=s)).)+?(?<=\S)(?P=s))"
    r"|(?P<whead>^(?P<e>={1,6})[ \t]*[^=\n]+?[ \t]*(?P=e)[ \t]*$)"
    r"|(?P<under>(?<=\n)(?:={3,}|-{3,})[ \t]*$))",
    re.S | re.M,
)
_INNER = {"link": 1, "strong": 0, "strike": 2, "wbold": 0, "lquote": 2, "group": 0, "command": 0, "wlink": 2, "template": 2, "image": 2, "reflink": 1, "comment": 4}
_FAMILY = {
    "comment": "html", "tag": "html", "angle": "html", "entity": "html", "template": "wiki", "wtable": "wiki", "wlink": "wiki", "wbold": "wiki", "whead": "wiki", "elink": "wiki", "autolink": "markdown", "image": "markdown", "footdef": "markdown", "foot": "markdown", "refdef": "markdown",
    "link": "markdown", "reflink": "markdown", "escape": "markdown", "strike": "markdown", "strong": "markdown", "under": "markdown", "lquote": "latex", "env": "latex", "group": "latex", "command": "latex",
}
_KINDS = list(_FAMILY)
_LITERAL = {"code", "pre", "kbd", "samp", "tt", "script", "style", "textarea", "verbatim", "lstlisting", "nowiki"}
# fixed values: LaTeX commands of running text
_COMMANDS = frozenset(
    "textbf textit texttt emph textsc textrm textsf textsl underline section subsection subsubsection paragraph subparagraph chapter part title author date label ref eqref pageref autoref cref cite citep citet nocite footnote footnotemark footnotetext item caption centering includegraphics url href input include usepackage documentclass maketitle tableofcontents newpage clearpage noindent par linebreak newline hline toprule midrule bottomrule vspace hspace bigskip medskip smallskip it bf em tt sc rm sf textcolor color mbox ldots dots quad qquad LaTeX TeX textquote enquote bibitem appendix index gls ac verb".split()
)


@dataclass
class Node:
    kind: str
    start: int
    end: int
    raw: str
    name: str = ""
    parent: int = -1
    depth: int = 0
    kids: list[int] = field(default_factory=list)
    mate: int = -1  # the other tag of a pair, or end of an environment


def mask(text: str) -> str:
    """The text with what can't hold markup blanked out, offsets kept."""
    return _MASKED.sub(lambda m: re.sub(r"[^\n]", "\0", m.group()), text)


_QUICK = re.compile(r"[<&{\[\\~*_=`'-]")


def parse(text: str, masked: str | None = None) -> list[Node]:
    """Candidate nodes in order of their start, each with its innermost enclosing node."""
    t = mask(text) if masked is None else masked
    nodes: list[Node] = []

    def walk(a: int, b: int, parent: int, depth: int) -> None:
        at = a
        while at < b and (m := _CANDIDATE.search(t, at, b)):  # each alternative ends at a mark, a line or a paragraph
            kind, raw = m.lastgroup, m.group()
            if kind in ("s", "e"):
                kind = "strong" if kind == "s" else "whead"
            if kind is None or kind not in _FAMILY:
                kind = next(k for k in _FAMILY if m.groupdict().get(k))
            name = ""
            if kind == "tag":
                name = re.match(r"</?([A-Za-z0-9]+)", raw)[1].lower()
            elif kind in ("command", "env"):
                name = re.search(r"\{(\w+)", raw)[1] if kind == "env" else re.search(r"\\([A-Za-z]+)", raw)[1]
            elif kind == "under" and not _underlines(t, m.start(), m.end()):
                at = m.end()
                continue
            i = len(nodes)
            nodes.append(Node(kind, m.start(), m.end(), raw, name, parent, depth))
            if parent >= 0:
                nodes[parent].kids.append(i)
            inner = _INNER.get(kind)
            if inner is not None and m.end() - m.start() > 4:
                lead = inner or len(raw) - len(raw.lstrip("*_'")) or 1
                walk(m.start() + lead, m.end() - 1, i, depth + 1)
            at = max(m.end(), m.start() + 1)

    walk(0, len(t), -1, 0)
    # pair tags and environments, and put what lies between under the opening one
    stack: list[int] = []
    for i, n in enumerate(nodes):
        if n.kind == "tag":
            if n.raw.startswith("</"):
                for k in range(len(stack) - 1, -1, -1):
                    if nodes[stack[k]].kind == "tag" and nodes[stack[k]].name == n.name:
                        nodes[stack[k]].mate, n.mate = i, stack[k]
                        del stack[k:]
                        break
            elif not n.raw.endswith("/>") and n.name not in ("br", "hr", "img", "input", "meta", "link", "wbr", "col"):
                stack.append(i)
        elif n.kind == "env":
            if n.raw.startswith("\\end"):
                for k in range(len(stack) - 1, -1, -1):
                    if nodes[stack[k]].kind == "env" and nodes[stack[k]].name == n.name:
                        nodes[stack[k]].mate, n.mate = i, stack[k]
                        del stack[k:]
                        break
            else:
                stack.append(i)
        elif n.kind == "wtable":
            if n.raw.startswith("|}"):
                for k in range(len(stack) - 1, -1, -1):
                    if nodes[stack[k]].kind == "wtable":
                        nodes[stack[k]].mate, n.mate = i, stack[k]
                        del stack[k:]
                        break
            elif n.raw.startswith("{|"):
                stack.append(i)
        stack_open = [k for k in stack if k != i and nodes[k].end <= n.start]
        if n.parent < 0 and stack_open and n.mate not in stack_open:
            n.parent = stack_open[-1]
            n.depth = nodes[n.parent].depth + 1
            nodes[n.parent].kids.append(i)
    return nodes


def _underlines(t: str, a: int, b: int) -> bool:
    """A rule right under a line of text that is a title: not a table row, an item or a break."""
    above = t[t.rfind("\n", 0, a - 1) + 1 : a - 1] if a > 1 else ""
    below = t[b + 1 : t.find("\n", b + 1) if t.find("\n", b + 1) >= 0 else len(t)]
    over = t[t.rfind("\n", 0, max(0, a - 2 - len(above))) + 1 : max(0, a - 2 - len(above))].strip()
    return bool(above.strip() and "\0" not in above and not above.lstrip().startswith(("|", "#", "-", "*", ">", "=", "<")) and not below.strip() and not over)


def extent(nodes: list[Node], n: Node) -> tuple[int, int]:
    return (n.start, nodes[n.mate].end) if n.mate >= 0 and nodes[n.mate].start > n.start else (n.start, n.end)


_CLASS = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "_*" else 5


N_FEATURES = 29


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """One row a node: kind and name, subtree density, attribute tokens, depth, siblings, surroundings."""
    n_text = max(1, len(text))
    by_kind: dict[str, int] = {}
    for n in nodes:
        by_kind[n.kind] = by_kind.get(n.kind, 0) + 1
    rows = []
    for n in nodes:
        a, b = extent(nodes, n)
        inner = n.raw.strip("*_~'`[]{}<>/!\\= \n")
        attrs = n.raw.split()[1:] if n.kind == "tag" else n.raw.split("|")[1:] if n.kind in ("template", "wlink", "wtable") else []
        sibs = len(nodes[n.parent].kids) if n.parent >= 0 else len(nodes)
        before, after = text[n.start - 1 : n.start], text[n.end : n.end + 1]
        known = n.name in _TAGS if n.kind == "tag" else n.name in _COMMANDS if n.kind == "command" else n.kind != "angle"
        rows.append(
            (
                _KINDS.index(n.kind), known, n.mate >= 0, len(n.name), min(len(n.raw), 12), (b - a) / n_text, len(n.kids), sum(len(nodes[k].raw) for k in n.kids) / max(1, b - a),
                len(attrs), sum("=" in x for x in attrs), n.depth, sibs, by_kind[n.kind], _CLASS(before), _CLASS(after), before == "\n" or not before, after == "\n" or not after,
                sum(c.isdigit() for c in inner) / max(1, len(inner)), sum(c.isalpha() for c in inner) / max(1, len(inner)), " " in inner, "," in inner,
                inner[:1].isspace() or inner[-1:].isspace(), "{" in n.raw, ";" in n.raw[-1:], n.raw.startswith("</"), before == ":" or text[n.start - 2 : n.start] == ":\\", text[n.start - 1 : n.start] == "(" and after == ")", _CLASS(n.raw[1:2]), min(inner.count(" "), 12),
            )
        )
    return np.array(rows, dtype=np.float32).reshape(len(nodes), N_FEATURES)


def surely(text: str, nodes: list[Node], n: Node) -> bool | None:
    """What can be said of a node without judgement: markup that holds words and is whole (both tags, both
    ends, an address), or marks that can't be markup (no letters, a path, a comparison). Everything
    between, such as lone tags, marks inside words or names without an address, stays open."""
    before, after = text[n.start - 1 : n.start], text[n.end : n.end + 1]
    inner = n.raw.strip("*_~'`[]{}<>/!\\= \n")
    words = bool(re.search(r"[^\W\d_]{2}", inner))
    bare = not re.search(r"[^\W\d_]", inner)
    free = not (before.isalnum() or after.isalnum() or before in "*_\\" and before)
    match n.kind:
        case "comment" | "elink" | "autolink" | "image" | "footdef" | "foot" | "group":
            return True
        case "tag":
            return True if n.name in _TAGS and (n.mate >= 0 or "=" in n.raw) else False if n.name not in _TAGS and n.mate < 0 and "=" not in n.raw else None
        case "angle":
            return False if bare else None
        case "entity":
            return True if n.raw.endswith(";") and html.unescape(n.raw) != n.raw else False if before.isalnum() or after.isalnum() else None
        case "template":
            return True if "|" in n.raw and words else False if bare else None
        case "wlink":
            return True if "|" in n.raw and words else False if bare else None
        case "wtable":
            return True if n.mate >= 0 else False if n.depth == 0 and n.raw.startswith("|-") else None
        case "wbold" | "lquote" | "strike":
            return True if words and free else False if bare else None
        case "whead":
            return True if words and n.raw.startswith("==") else False if bare else None
        case "under":
            return True if "=" in n.raw else None
        case "refdef" | "link":
            return True if words and re.search(r"\](?:\(|:\s*)<?(?:https?:|/|\w+[./])", n.raw) else False if bare else None
        case "reflink":
            return True if words and free and re.search(r"\]\[[^\W\d_]{2}", n.raw) else False if bare else None
        case "env":
            return True if n.mate >= 0 else None
        case "command":
            if before and before in ":\\" or re.search(r"[A-Za-z]:\S*$", text[max(0, text.rfind(" ", 0, n.start)) : n.start]):
                return False  # a path
            return True if n.name in _COMMANDS and "{" in n.raw else None
        case "escape":
            return False if re.search(r"[A-Za-z]:\S*$", text[max(0, text.rfind(" ", 0, n.start)) : n.start]) else True if not before.isalnum() or not after.isalnum() else None
        case "strong":
            return False if bare or before.isalnum() and (after.isalnum() or " " in inner) else True if words and free else None
    return None


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The best consistent decisions: the sum of margins of accepted nodes is largest, with nothing
    accepted inside an accepted literal node, nor inside a bracket pair that was judged literal."""
    take = [False] * len(nodes)
    memo: dict[int, float] = {}

    def opaque(n: Node) -> bool:
        return n.kind == "comment" or n.kind in ("tag", "env") and n.name in _LITERAL

    def sealed(n: Node) -> bool:
        return n.kind in ("wlink", "template", "reflink", "comment")

    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        kids = sum(memo[k] for k in nodes[i].kids)
        yes = margin[i] + (0.0 if opaque(nodes[i]) else kids)
        no = 0.0 if sealed(nodes[i]) else kids
        memo[i] = max(yes, no)
    shut = [False] * len(nodes)
    for i, n in enumerate(nodes):
        kids = sum(memo[k] for k in n.kids)
        if not shut[i]:
            take[i] = margin[i] + (0.0 if opaque(n) else kids) > (0.0 if sealed(n) else kids)
        close = shut[i] or (opaque(n) if take[i] else sealed(n))
        for k in n.kids:
            shut[k] = shut[k] or close
    for i, n in enumerate(nodes):  # the two tags of a pair agree
        if n.mate >= 0 and not n.raw.startswith(("</", "\\end")):
            take[n.mate] = take[i]
    return take


def judge(texts: list[str], model: BoostedTrees) -> list[tuple[list[Node], list[bool]]]:
    """Nodes and decisions of several texts, with one pass of the trees."""
    trees = [parse(t) if _QUICK.search(t) else [] for t in texts]
    rows = [features(t, n) for t, n in zip(texts, trees) if n]
    margin = model.margin(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for text, nodes in zip(texts, trees):
        m = margin[at : at + len(nodes)]
        at += len(nodes)
        take = decode(nodes, m) if nodes else []
        out.append((nodes, take))
    return out


# ---- rendering -------------------------------------------------------------------------------

_HEADS = {"chapter": 1, "part": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


def render(text: str, nodes: list[Node], take: list[bool]) -> str:
    """The text with every accepted node turned into the project's own conventions or dropped."""

    def span(a: int, b: int, kids: list[int]) -> str:
        out, at = [], a
        for k in sorted(kids, key=lambda k: nodes[k].start):
            n = nodes[k]
            if n.start < at or n.end > b:
                continue
            out.append(text[at : n.start])
            at = n.end
            out.append(one(k))
        out.append(text[at:b])
        return "".join(out)

    def one(k: int) -> str:
        n, raw = nodes[k], nodes[k].raw
        raw = text[n.start : n.end]
        if not take[k]:
            return span(n.start, n.end, n.kids) if n.kids and n.mate < 0 else raw
        inside = lambda a, b: span(n.start + a, n.end - b, n.kids)
        match n.kind:
            case "prefix":
                return n.raw
            case "elink":
                return raw[1:-1].split(None, 1)[1]
            case "autolink":
                return raw[1:-1]
            case "comment" | "wtable" | "foot" | "refdef" | "footdef" | "under":
                return ""
            case "entity":
                return html.unescape(raw)
            case "tag":
                end = raw.startswith("</")
                if n.name in ("br", "p", "div", "tr", "table", "blockquote", "ul", "ol", "center", "figure"):
                    return "\n" if n.name in ("br", "tr") else ("\n" if end else "")
                if re.fullmatch("h[1-6]", n.name):
                    return "\n" if end else "\n" + "#" * int(n.name[1]) + " "
                if n.name == "li":
                    return "" if end else "- "
                if n.name in ("td", "th"):
                    return " |" if end else " "
                if n.name == "pre":
                    return "```"
                if n.name in ("code", "kbd", "samp", "tt"):
                    return "`"
                return ""
            case "template":
                parts = raw.strip("{}").split("|")
                plain = [p for p in parts[1:] if "=" not in p]
                return plain[0] if plain and parts[0].strip().lower() not in ("ref", "cite", "citation") and not parts[0].strip().lower().startswith("infobox") else ""
            case "wlink":
                parts = raw.strip("[]").split("|")
                if re.match(r"\s*:?(?:category|catégorie|kategorie|categoría)\s*:", parts[0], re.I):
                    return ""
                return parts[-1].lstrip(":") if len(parts) > 1 or not re.match(r"(?:file|image|fichier|datei|archivo):", parts[0], re.I) else ""
            case "wbold":
                lead = len(raw) - len(raw.lstrip("'"))
                return inside(lead, len(raw) - len(raw.rstrip("'")))
            case "whead":
                level = len(raw) - len(raw.lstrip("="))
                return "#" * level + " " + raw.strip("= \t")
            case "image":
                return re.match(r"!\[([^\]]*)\]", raw)[1]
            case "link" | "reflink":
                close = raw.rfind("](" if n.kind == "link" else "][")
                return span(n.start + 1, n.start + close, n.kids)
            case "strike":
                return inside(2, 2)
            case "lquote":
                return "“" + inside(2, 2) + "”"
            case "strong":
                lead = len(re.match(r"[*_]+", raw)[0])
                lead = min(lead, 3)
                return inside(lead, lead)
            case "escape":
                return raw[1:]
            case "group":
                return re.sub(r"^\{\\\w+\s*|\}$", "", raw)
            case "env":
                if n.name.rstrip("*") in ("equation", "align", "gather", "displaymath", "eqnarray"):
                    return "$$"
                return "```" if n.name in ("verbatim", "lstlisting") else ""
            case "command":
                brace = re.search(r"\{(.*)\}$", raw, re.S)
                arg = span(n.start + brace.start(1), n.start + brace.end(1), n.kids) if brace else ""
                if n.name in _HEADS:
                    return "#" * _HEADS[n.name] + " " + arg
                if n.name == "item":
                    return "-"
                if n.name == "footnote":
                    return f" ({arg})" if arg else ""
                if n.name in ("label", "ref", "eqref", "pageref", "autoref", "cref", "cite", "citep", "citet", "nocite", "vspace", "hspace", "includegraphics", "bibitem", "index", "usepackage", "documentclass", "noindent", "centering"):
                    return ""
                if n.name in ("ldots", "dots"):
                    return "…"
                return arg
        return raw

    return re.sub(r"[ \t]+\n", "\n", span(0, len(text), [i for i, n in enumerate(nodes) if n.parent < 0 or n.start >= nodes[n.parent].end]))


def clean(text: str, nodes: list[Node], take: list[bool]) -> str:
    """Rendered text; an underlined title gets its heading mark first."""
    extra = []
    for n, yes in zip(nodes, take):
        if yes and n.kind == "under":
            at = text.rfind("\n", 0, n.start - 1) + 1
            extra.append(Node("prefix", at, at, "# " if "=" in n.raw else "## "))
    return render(text, nodes + extra, take + [True] * len(extra)).strip("\n") if nodes else text


# ---- over tables -----------------------------------------------------------------------------


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "parents").select(F.lit("parents").alias("record_table"), F.col("parent_id").alias("record_key"), F.col("text").alias("body"))
    d = table(spark, sf_dir, "extracted_documents").select(F.lit("extracted_documents").alias("record_table"), F.col("document_id").cast("string").alias("record_key"), F.col("markdown").alias("body"))
    return p.unionByName(d).where("record_key is not null and body is not null and body <> ''")


def training_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for t in texts:
        nodes = parse(t)
        if not nodes:
            continue
        labels = [surely(t, nodes, n) for n in nodes]
        keep = [i for i, y in enumerate(labels) if y is not None]
        if keep:
            xs.append(features(t, nodes)[keep])
            ys += [bool(labels[i]) for i in keep]
    return (np.concatenate(xs) if xs else np.zeros((0, N_FEATURES), np.float32)), np.array(ys, dtype=float)


def fit(texts: DataFrame, rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Trees fitted on the `rows` texts of each table with the smallest hashes of their keys."""
    sample: list[str] = []
    for name in ("parents", "extracted_documents"):
        part = texts.where(F.col("record_table") == name)
        share = min(1.0, 1.5 * rows / max(1, part.count()))  # so that no task sends the driver more than its share
        part = part.select((F.xxhash64("record_key") / 2.0**64 + 0.5).alias("h"), "body").where(F.col("h") <= share)
        sample += [r.body for r in part.orderBy("h").limit(rows).select("body").collect()]
    return BoostedTrees().fit(*training_rows(sample))


def found_in(texts: DataFrame, model: BoostedTrees) -> DataFrame:
    """(record_table, record_key, markup) for each family present."""
    sent = texts.sparkSession.sparkContext.broadcast(model)  # a few kB, by its parameters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                for name, key, (nodes, take) in zip(part["record_table"], part["record_key"], judge(list(part["body"]), sent.value)):
                    rows += [(name, key, f) for f in sorted({_FAMILY[n.kind] for n, y in zip(nodes, take) if y})]
            yield pd.DataFrame(rows, columns=["record_table", "record_key", "markup"])

    return spread(texts).mapInPandas(run, "record_table string, record_key string, markup string").distinct()


def cleaned(texts: DataFrame, model: BoostedTrees) -> DataFrame:
    """(record_table, record_key, body) with all markup rendered, each key once."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = [clean(t, nodes, take) for t, (nodes, take) in zip(pdf["body"], judge(list(pdf["body"]), sent.value))]
            yield pdf.assign(body=bodies)

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = texts.repartition(n, "record_table", "record_key").dropDuplicates(["record_table", "record_key"])
    return once.mapInPandas(run, "record_table string, record_key string, body string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of markup present in each text."""
    texts = texts_of(spark, sf_dir)
    return found_in(texts, fit(texts))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without markup residue."""
    texts = texts_of(spark, sf_dir)
    return cleaned(texts, fit(texts))


QUERIES = {"p3_found": found, "p3_clean_text": clean_text}
ORACLES: dict[str, str] = {}
