"""HTML into markdown on the standard library's parser: a tolerant tree, main content, tables, math.

Extraction strategies are looked up by host; `register` adds one. A null page gives a null
document; broken markup never fails, it is read as far as it makes sense.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe nav footer aside form button select header".split())
CHROME = re.compile(r"\b(?:nav|navbar|menu|sidebar|footer|breadcrumb|cookie|banner|advert|ads?|promo|share|social|related|comments?|headerlink|toc)\b", re.I)
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids if isinstance(k, str) or k.tag not in ("script", "style"))

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for back in range(len(self.open) - 1, 0, -1):
            if self.open[back].tag in CLOSES.get(tag, ()):
                del self.open[back:]
                break
            if self.open[back].tag in ("table", "ul", "ol", "div", "section", "article", "main", "body"):
                break
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for back in range(len(self.open) - 1, 0, -1):
            if self.open[back].tag == tag:
                del self.open[back:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _cells(row: Node) -> list[str]:
    return [re.sub(r"\s+", " ", c.text()).strip().replace("|", r"\|") for c in row.kids if isinstance(c, Node) and c.tag in ("td", "th")]


def table_to_markdown(html: str) -> str:
    """A pipe table with the first row as head, short rows filled up; markup without rows stays."""
    rows = [c for n in parse(html).walk() if n.tag == "tr" and (c := _cells(n))]
    return _pipe_table(rows) if rows else html


def _pipe_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


# fixed values: operators and letters of MathML and their LaTeX
MATH_OPERATORS = {"\u2212": "-", "×": r"\times", "⋅": r"\cdot", "∈": r"\in", "∉": r"\notin", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "\u2061": "", "\u2062": "", "→": r"\to", "↦": r"\mapsto", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "∞": r"\infty"}
MATH_LETTERS = {"ℝ": r"\mathbb{R}", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "ℚ": r"\mathbb{Q}", "ℂ": r"\mathbb{C}"}
#: parts that a construct needs, and how they stand in it; with fewer parts it is read as a row
MATH_FORMS: dict[str, tuple[int, Callable[..., str]]] = {
    "msup": (2, lambda x, up: f"{x}^{{{up}}}"),
    "msub": (2, lambda x, low: f"{x}_{{{low}}}"),
    "msubsup": (3, lambda x, low, up: f"{x}_{{{low}}}^{{{up}}}"),
    "mfrac": (2, lambda x, y: rf"\frac{{{x}}}{{{y}}}"),
    "mroot": (2, lambda x, n: rf"\sqrt[{n}]{{{x}}}"),
}


def mathml_to_latex(n: Node | str) -> str:
    """LaTeX of a MathML tree; kinds it doesn't know are read as rows of their parts, without blanks."""
    if isinstance(n, str):
        return n if n.strip() else ""
    parts = [k for k in n.kids if isinstance(k, Node)]
    row = lambda: "".join(map(mathml_to_latex, n.kids))
    if n.tag in MATH_FORMS and len(parts) >= MATH_FORMS[n.tag][0]:
        count, form = MATH_FORMS[n.tag]
        return form(*map(mathml_to_latex, parts[:count]))
    match n.tag:
        case "annotation" | "annotation-xml":
            return ""
        case "mi":
            return MATH_LETTERS.get(n.text(), n.text())
        case "mo":
            return MATH_OPERATORS.get(n.text().strip(), n.text().strip())
        case "mn":
            return n.text()
        case "mtext":
            return rf"\text{{{n.text()}}}"
        case "msqrt":
            return rf"\sqrt{{{row()}}}"
        case "mfenced":
            return rf"\left({row()}\right)"
    return row()


def latex_of(n: Node) -> str:
    """A math element's LaTeX: its own delimiters removed, or its MathML converted."""
    if m := n.first("math"):
        return mathml_to_latex(m)
    return re.sub(r"^\s*\\[\[(]|\\[\])]\s*$", "", n.text()).strip()


def code_language(n: Node) -> str:
    m = re.search(r"(?:language|highlight|lang)-(\w+)", " ".join([n.attrs.get("class", ""), *(k.attrs.get("class", "") for k in n.walk())]))
    return "" if not m or m[1] in ("default", "none", "text") else m[1]


def image(n: Node) -> str:
    """An image as markdown: the address it loads late if it does; nothing for images of the page's chrome,
    without an address, or with a template's variable that was never filled in."""
    src, alt = n.attrs.get("data-src") or n.attrs.get("src", ""), n.attrs.get("alt", "").strip()
    return "" if not src or CHROME.search(alt) or "{{" in src or "{%" in src else f"![{alt}]({src})"


def to_markdown(n: Node, base: str = "") -> str:
    """A subtree as markdown: ATX headings, dashes for items, fenced code, pipe tables."""

    def inline(x: Node | str) -> str:
        if isinstance(x, str):
            return re.sub(r"\s+", " ", x)
        cls = x.attrs.get("class", "")
        if x.tag in DROPPED or "headerlink" in cls:
            return ""
        if x.tag == "math" or "math" in cls.split():
            return f"${latex_of(x)}$"
        inner = "".join(map(inline, x.kids))
        match x.tag:
            case "strong" | "b":
                return f"**{inner.strip()}**" if inner.strip() else ""
            case "em" | "i":
                return f"*{inner.strip()}*" if inner.strip() else ""
            case "code":
                return f"`{x.text().strip()}`"
            case "br":
                return "\n"
            case "a":
                return f"[{inner.strip()}]({x.attrs['href']})" if x.attrs.get("href") and inner.strip() else inner
            case "img":
                return image(x)
        return inner

    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = re.sub(r" *\n *", "\n", "".join(run)).strip()
        if t:
            blocks.append(t)
        run.clear()

    def block(x: Node) -> None:
        for k in x.kids:
            if isinstance(k, str):
                run.append(inline(k))
                continue
            cls = k.attrs.get("class", "")
            if k.tag in DROPPED or CHROME.search(cls) or "output" in cls.split():
                continue
            if re.fullmatch("h[1-6]", k.tag):
                flush()
                if t := "".join(map(inline, k.kids)).replace("¶", "").strip():
                    blocks.append("#" * int(k.tag[1]) + " " + t)
            elif k.tag in ("ul", "ol"):
                flush()
                items = [i for i in k.kids if isinstance(i, Node) and i.tag == "li"]
                blocks.append("\n".join((f"{j + 1}. " if k.tag == "ol" else "- ") + re.sub(r"\s*\n\s*", " ", to_markdown(i)) for j, i in enumerate(items)))
            elif k.tag == "pre":
                flush()
                blocks.append(f"```{code_language(k) or code_language(x)}\n" + k.text().strip("\n") + "\n```")
            elif k.tag == "table":
                flush()
                rows = [c for r in k.walk() if r.tag == "tr" and (c := _cells(r))]
                blocks.append(_pipe_table(rows) if rows else "")
            elif k.tag == "div" and "math" in cls.split():
                flush()
                blocks.append(f"$$\n{latex_of(k)}\n$$")
            elif k.tag == "blockquote":
                flush()
                blocks.append("\n".join("> " + y for y in to_markdown(k).split("\n")))
            elif k.tag in ("p", "div", "section", "article", "main", "body", "html", "center", "figure", "figcaption", "dl", "dt", "dd", "details", "summary", "root"):
                flush()
                block(k)
                flush()
            elif k.tag not in ("head", "title"):
                run.append(inline(k))
        return

    block(n)
    flush()
    return "\n\n".join(b for b in blocks if b.strip())


Strategy = Callable[[Node, str], tuple[str, dict[str, str]]]
STRATEGIES: dict[str, Strategy] = {}


def register(domain: str) -> Callable[[Strategy], Strategy]:
    """Adds a strategy for a domain and its sub-domains."""

    def add(fn: Strategy) -> Strategy:
        STRATEGIES[domain] = fn
        return fn

    return add


def strategy_for(host: str) -> Strategy:
    host = re.sub(r"^www\.", "", host.lower())
    return next((s for d, s in STRATEGIES.items() if host == d or host.endswith("." + d)), article)


def _main(root: Node) -> Node:
    for n in root.walk():
        if n.tag in ("main", "article") or n.attrs.get("role") == "main":
            return n
    return root.first("body") or root


def article(root: Node, url: str) -> tuple[str, dict[str, str]]:
    """Any page: its main element, without furniture."""
    title = root.first("title") or root.first("h1")
    date = next((n.attrs.get("content", "") for n in root.walk() if n.tag == "meta" and "date" in (n.attrs.get("name", "") + n.attrs.get("property", "")).lower()), "")
    meta = {"source_url": url, "title": re.sub(r"\s+", " ", title.text()).strip() if title else "", "date": date, "extractor": "generic", "source_type": "web"}
    return to_markdown(_main(root)), {k: v for k, v in meta.items() if v}


class NoMainContent(ValueError):
    """The page lacks the element that holds its text."""


# fixed values: hosts of generated books, and addresses of notebook launchers and forums on their pages
BOOKS = ("d2l.ai",)
LAUNCHERS = re.compile(r"colab\.research\.google|studiolab\.sagemaker|sagemaker\.aws")
FORUMS = re.compile(r"discuss\.d2l\.ai")


def _classes(n: Node) -> list[str]:
    return n.attrs.get("class", "").split()


def _edited(n: Node, edit: Callable[[Node], list[Node | str]]) -> Node:
    """A copy of a tree in which each node, from the leaves up, is replaced by what `edit` gives for it."""
    out = Node(n.tag, n.attrs)
    for k in n.kids:
        out.kids += [k] if isinstance(k, str) else edit(_edited(k, edit))
    return out


def _book_part(n: Node) -> list[Node | str]:
    """What stays of a node of a book's page: the active panel of tabs, inputs of code as fences with their
    language but no outputs, links within the book as their text, and no launchers or forum links."""
    of = _classes(n)
    if "mdl-tabs__tab-bar" in of or "mdl-tabs__panel" in of and "is-active" not in of or "tab-pane" in of and "active" not in of:
        return []
    if {"headerlink", "d2l-tabs", "mdl-tooltip", "copybtn", "output"} & set(of):
        return []
    if n.tag == "a":
        href = n.attrs.get("href", "")
        if LAUNCHERS.search(href) or FORUMS.search(href):
            return []
        if {"reference", "internal"} <= set(of):
            return [n.text()]
    if n.tag == "p" and n.attrs.get("emptied"):
        return []
    language = next((c.removeprefix("highlight-") for c in of if c.startswith("highlight-")), None)
    if language is not None and (code := n.first("pre")):
        fence = Node("pre", {"class": "" if language == "default" else f"highlight-{language}"})
        fence.kids = ["\n".join(code.text().split("\n")).strip("\n")]
        return [fence]
    return [n]


def book(root: Node, url: str) -> tuple[str, dict[str, str]]:
    """Pages of a generated book; an error without main content."""
    main = next((n for n in root.walk() if n.attrs.get("role") == "main"), None) or root.first("main") or next((n for n in root.walk() if n.tag == "div" and "document" in _classes(n)), None)
    if main is None:
        raise NoMainContent(url)
    for p in main.walk():  # a paragraph that only leads to the forum
        if p.tag == "p" and any(a.tag == "a" and FORUMS.search(a.attrs.get("href", "")) for a in p.walk()):
            p.attrs = {**p.attrs, "emptied": "1"}
    head = root.first("title")
    title = head.text().split("—")[0].strip() if head else ""
    if not title and (h1 := root.first("h1")):
        title = h1.text().replace("¶", "").strip()
    meta = {"source_url": url, "title": title, "extractor": "book", "source_type": "web"}
    if m := re.match(r"(\d+(?:\.\d+)*)", title):
        meta |= {"section_number": m[1], "chapter": m[1].split(".")[0]}
    return to_markdown(_edited(main, _book_part)).replace("¶", ""), {k: v for k, v in meta.items() if v}


for _domain in BOOKS:
    register(_domain)(book)

DOCUMENT = "page_id long, url string, markdown string, metadata map<string,string>, error string"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, markdown, metadata, error) of pages (page_id, url, html); a page that its strategy can't
    read has an error and no markdown, and doesn't fail the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                if html is None:
                    rows.append((i, url, None, None, "no page"))
                    continue
                host = re.sub(r"^\w+://(?:[^@/]*@)?([^/:?#]*).*", r"\1", url or "")
                try:
                    text, meta = strategy_for(host)(parse(html), url or "")
                except NoMainContent:
                    rows.append((i, url, None, None, "no main content"))
                    continue
                rows.append((i, url, re.sub(r"\n{3,}", "\n\n", text).strip(), meta, None))
            yield pd.DataFrame(rows, columns=["page_id", "url", "markdown", "metadata", "error"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, DOCUMENT)
