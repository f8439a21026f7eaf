"""Problem 2: page furniture mixed with main content, by consensus host paths.

Each page is read as containers: titled lists, bars of links, single links, labels, notices with
their buttons, teasers, remarks. A container has two generalised paths. The shape path holds no
text: its place on the page (before the lesson, within, after), kind, depth, links and length. The
named path adds a class, as a tag's class would: the title of a titled list, the first step of a
trail, the closing label of a teaser, else the line with figures and the site's name masked.

A page scores its containers weakly, by what it alone shows: place, links, form, neighbours, and as
one more sign the fixed words of sites in four languages. No sign alone decides. In Spark the hosts
vote: the scores of a named path over all pages of its host, backed by the host's average of its
shape path and by the path's average over all hosts, with a bonus for what a host's pages repeat.
Every page is then read by the winning paths of its host, so a title that leads to links on some
pages makes its list furniture on the others, and a word of the lists that one lesson uses stays.
A line near a page's start or end also wins where half of the host's pages repeat it there.

Only candidate lines (numbers, no texts) and votes are shuffled; code, tables, formulas, headings
without a list and paragraphs elsewhere are never candidates.

Rows: documents without `source_url`, or with a null text, have no lines; a repeated document
counts once; line numbers count from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import host as host_of
from ..session import cut_lineage, spread, table

PRIOR = 2.0  # pages' worth of each of the two averages that back a host's vote
KNOWN = 8.0  # pages' worth, at most, of a path's average over all hosts
WINS = 0.5
ELSEWHERE = 0.15  # what a path on four hosts or more adds
BONUS = 0.35  # what repetition over a host's pages adds at most
OFTEN = 0.06  # share of a host's pages at which it is reached; at least 3 pages more than one
REPEATED = 0.45  # what repetition adds at most; less than wins, so some other sign must be there
EDGE = 12  # non-blank lines from a page's start or end that count as its edge
REPEATS_LEAST = 4  # pages that must repeat a line at their edge for repetition alone to count

# fixed values: names of a site's own pages, and labels of its buttons and footers
_LABELS = frozenset(
    """home|blog|contact|contact us|about us|about|teachers|search|forum|faq|library|sign up|downloads|my account|log in|login|lessons|calendar|courses|help|pricing|imprint|terms of use|terms|accessibility statement|accessibility|privacy policy|privacy|follow us|back to top|sitemap|site map|contact the webmaster|built with a static site tool|skip to content|menu|read more|continue reading|edit this page|next|previous|accept all|reject|reject all|got it|ok|only necessary|manage preferences|settings|you are not logged in|subscribe|newsletter
accueil|à propos|contact|enseignants|rechercher|bibliothèque|inscription|téléchargements|mon compte|connexion|leçons|agenda|cours|aide|tarifs|mentions légales|accessibilité|accessibilité : non conforme|politique de confidentialité|suivez-nous|haut de page|plan du site|écrire au webmestre|site réalisé avec un outil statique|aller au contenu|lire la suite|modifier cette page|suivant|précédent|tout accepter|refuser|tout refuser|j’ai compris|continuer sans accepter|gérer mes choix|vous n’êtes pas connecté|conditions d’utilisation
startseite|über uns|lehrende|nutzungsbedingungen|nach oben|datenschutz|registrieren|bibliothek|hilfe|kurse|preise|anmelden|lektionen|kontakt|kalender|suche|suchen|mein konto|folgen sie uns|impressum|barrierefreiheit|seitenübersicht|zum inhalt springen|weiterlesen|diese seite bearbeiten|weiter|zurück|alle annehmen|ablehnen|einstellungen|nur notwendige|sie sind nicht angemeldet|verstanden
inicio|quiénes somos|docentes|ayuda|cursos|buscar|lecciones|entrar|precios|registrarse|biblioteca|contacto|descargas|mi cuenta|calendario|aviso legal|política de privacidad|volver arriba|mapa del sitio|síganos|foro|saltar al contenido|leer más|seguir leyendo|editar esta página|siguiente|anterior|aceptar todo|solo necesarias|rechazar|configurar|entendido|no ha iniciado sesión|términos de uso|accesibilidad""".replace("\n", "|").split("|")
)
# fixed values: titles of lists that lead elsewhere
_LEADS = frozenset(
    """on this page|related lessons|related articles|popular this week|most read|most popular|recent comments|latest comments|tags|see also|you may also like|share this page|keywords|comments|table of contents|latest posts|archives|categories
sur cette page|articles similaires|les plus lus|derniers commentaires|mots-clés|à lire aussi|partager cette page|commentaires|étiquettes|leçons similaires|sommaire
auf dieser seite|ähnliche lektionen|meistgelesen|neueste kommentare|schlagwörter|auch lesenswert|seite teilen|kommentare|ähnliche artikel|das könnte sie auch interessieren|siehe auch
en esta página|lecciones relacionadas|artículos relacionados|lo más leído|últimos comentarios|comentarios recientes|etiquetas|también le puede interesar|le puede interesar|compartir esta página|comentarios|véase también|lea también""".replace("\n", "|").split("|")
)
_CUE = re.compile(
    r"all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados"
    r"|\b(?:we|our) (?:and our partners )?use cookies|and its partners measure|et ses partenaires|und (?:seine|ihre) partner|y sus socios|this site (?:stores|uses)|by browsing on|small files on your device|your privacy matters"
    r"|nous utilisons des cookies|ce site (?:dépose|utilise)|votre vie privée|en poursuivant (?:votre|la) navigation|wir verwenden cookies|diese (?:seite|website) (?:speichert|verwendet|legt)|ihre privatsphäre|usamos cookies|utilizamos cookies|este sitio (?:guarda|usa|almacena)|su privacidad"
    r"|\b(?:subscribe|sign up) to our|our (?:newsletter|app)\b|enrol (?:today|now)|join \d[\d ,.]* (?:learners|students)|first module free|abonnez-vous|notre (?:lettre|application|infolettre)|inscrivez-vous|rejoignez \d|abonnieren sie|unsere[nr]? (?:rundbrief|newsletter|app)|jetzt einschreiben|schon \d[\d .]* lernende|laden sie unsere|suscríbase|nuestr[oa] (?:boletín|aplicación|app)|inscríbase|únase a|descargue nuestra"
    r"|was this (?:page|lesson) helpful|cette page vous a-t-elle|war diese seite hilfreich|(?:le ha sido|fue) útil esta página|¿le ha resultado útil|share this page|partager cette page|seite teilen|compartir esta página"
    r"|^(?:last built|site généré en|built with|stand|last updated|page built|sitio generado en|generado en|erstellt mit|seite erstellt)\b.{0,30}$|^\d+ (?:comments?|commentaires?|kommentare?|comentarios?)$"
    r"|^(?:search the lessons|rechercher une leçon|lektion(?:en)? suchen|suche in|buscar una lección|buscar lecciones)|not logged in|pas connecté|nicht angemeldet|no ha iniciado",
    re.I,
)

_LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
_ITEM = re.compile(r"^\s*(?:[-*•+–—]|\d+[.)])\s+")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s+|<h[1-6][^>]*>|=+\s+\S.*=+\s*$|\\(?:sub)*section\*?\{)")
_FENCE = re.compile(r"^\s*(?:`{3,}|~{3,})")
_BAR = re.compile(r"\s\|\s|\s·\s|\s•\s| {2,}")
_TRAIL = re.compile(r"\s(?:>|›|»|→|/|::)\s")
_SENTENCE_END = re.compile(r"[.!?…:;,]\s?[»”“\"’)]*$")
_SENTENCE = re.compile(r"[.!?][»”“\"’)]*\s")
_CODE = re.compile(r"[{}\[\]=\\]")
_SPEAKS = re.compile(r"^(?:[A-ZÀ-Þ]\.\s)?[A-ZÀ-Þ][\w-]+\s?:\s+[^\s«“„]")
_TAGS = re.compile(r"#\w+(?:[\s,]+#\w+)+")
_ARROWS = "←→«»‹›"
_MARK = re.compile(r"©|\(c\) \d{4}|&copy;")
_LANGS = re.compile(r"^(?:[A-Z]{2}\s*[|/·]\s*)+[A-Z]{2}$")
_DEFINES = re.compile(r"\[[^\]]+\]:\s")
_RULE = re.compile(r"[=-]{3,}\s*$")
_HIDDEN = " \t\r\ufeff\u200b\u00a0"

_READ_MORE = re.compile(r"^\W*(?:read more|continue reading|lire la suite|weiterlesen|mehr lesen|leer más|seguir leyendo)\W*$", re.I)
_BY_LENGTH = sorted(_LABELS, key=len, reverse=True)
#: a sentence, and after it a few words that end in no mark
_TEASES = re.compile(r"[.!?…][»”\"’)]*\s+([→»›>\s]*[^\W\d_]+(?:[ ’'-][^\W\d_]+){0,3}[→»›>\s]*)$")


@dataclass
class Box:
    """A container: its lines, kind and class, the evidence of its form, and what the page makes of it."""

    lines: list[int]
    kind: str
    name: str = ""
    signs: float = 0.0
    listed: bool = False
    links: float = 0.0
    solid: bool = False  # surely the lesson's: ends what lies before or after it
    alone: bool = False
    place: str = "within"
    score: float = 0.0
    at_edge: bool = False
    named: str = field(default="", repr=False)
    shape: str = field(default="", repr=False)


@dataclass
class _Text:
    """One line, read once."""

    no: int
    raw: str
    text: str  # without item and heading marks, links and emphasis
    item: bool
    heading: bool
    links: float  # share of the text inside links
    first: bool  # of its block
    last: bool


def _plain(line: str) -> str:
    """A line's text without item marks, heading marks, links and emphasis."""
    t = _LINK.sub(r"\1", _ITEM.sub("", line.strip(_HIDDEN)))
    return re.sub(r"^#{1,6}\s+|<[^>]+>|^=+\s+|\s+=+$|\*\*|__", "", t).strip()


@lru_cache(maxsize=4096)
def _site(host: str) -> re.Pattern | None:
    """The site's name as pages spell it: the parts of its host's first label, with or without marks between."""
    parts = re.findall(r"[^\W\d_]+|\d+", host.split(".")[0])
    return re.compile(r"\b" + r"\W?".join(map(re.escape, parts)) + r"\b", re.I) if any(len(p) > 3 for p in parts) else None


def _klass(text: str, site: re.Pattern | None) -> str:
    t = site.sub("§", text.lower()) if site else text.lower()
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", t))


def _is_label(text: str) -> bool:
    """Short, and no sentence."""
    return bool(text) and text[0] != "(" and len(text.split()) <= 8 and not (_SENTENCE_END.search(text) or _SENTENCE.search(text) or _CODE.search(text)) and text.count("(") == text.count(")")


def _named_by_sites(text: str) -> bool:
    return text.lower().strip(" :.·|…«»←→☰") in _LABELS


def _texts(lines: list[str]) -> Iterator[_Text | tuple[int, int]]:
    """Lines of text; code, formulas, tables and figure marks as spans (first, last line)."""
    i, n = 0, len(lines)
    blank = lambda k: not 0 <= k < n or not lines[k].strip(_HIDDEN)
    while i < n:
        raw = lines[i]
        s = raw.strip(_HIDDEN)
        if not s:
            i += 1
            continue
        j = i
        if _FENCE.match(raw):
            j += 1
            while j < n and not (_FENCE.match(lines[j]) and not lines[j].strip("`~" + _HIDDEN)):
                j += 1
        elif s.startswith("$$"):
            if s == "$$" or not s.endswith("$$"):
                j += 1
                while j < n and "$$" not in lines[j]:
                    j += 1
        elif not s.startswith(("|", "{|", "--- [", "\\", "<table", "<ul", "<ol", "<li", "<tr")) and not _DEFINES.match(s):
            linked = sum(len(m[1]) for m in _LINK.finditer(s)) if "](" in s else 0
            text = _plain(s)
            yield _Text(i, s, text, bool(_ITEM.match(s)), bool(_HEADING.match(s)) or i + 1 < n and bool(_RULE.match(lines[i + 1])), min(1.0, linked / len(text)) if text else 0.0, blank(i - 1), blank(i + 1))
            i += 1
            continue
        yield i, min(j, n - 1)
        i = j + 1


def _list_below(parts: list[_Text | tuple[int, int]], at: int) -> int:
    """How many of the parts after `at` are its list: items, remarks with a speaker, or under a heading
    labels, right below; after a blank line only links and remarks."""
    title = parts[at]
    k = at + 1
    if k >= len(parts) or isinstance(parts[k], tuple):
        return 0
    head: _Text = parts[k]
    said = bool(_SPEAKS.match(head.text)) and not head.item
    if title.last and not (head.item and head.links == 1.0 or said):
        return 0
    if title.heading and re.match(r"#\s", title.raw) or head.heading or not (head.item or said or _is_label(head.text) and not (_buttons(head.text) or _bar(head.text))):
        return 0
    of = (lambda x: x.item) if head.item else (lambda x: bool(_SPEAKS.match(x.text)) and not x.item) if said else (lambda x: _is_label(x.text) and not x.item)
    while k < len(parts) and not isinstance(parts[k], tuple) and of(parts[k]) and not parts[k].heading and (k == at + 1 or not parts[k].first):
        k += 1
    n = k - at - 1
    if not (head.item or said) and (n < 2 or k < len(parts) and not isinstance(parts[k], tuple) and not parts[k].first):
        return 0  # labels without marks: a title and all the rest of its block
    return n


def _closed_below(parts: list[_Text | tuple[int, int]], at: int) -> int:
    """How many of the parts after `at` make a teaser of it: sentences, and right below them a closing
    label. The block's first line is its title, or its only sentence."""
    x = parts[at]
    titled = x.heading or _is_label(x.text)
    k = at + 1
    while k < len(parts) and not isinstance(parts[k], tuple) and not (parts[k].first or parts[k].item or parts[k].heading):
        y, before = parts[k], parts[k - 1]
        more = bool(_READ_MORE.match(y.text))
        if more or re.match(r"[^\W\d_]", y.text) and _is_label(y.text) and len(y.text.split()) <= 4 and _SENTENCE_END.search(before.text) and (k > at + 1 or not titled):
            below = parts[k + 1] if k + 1 < len(parts) and not y.last and not isinstance(parts[k + 1], tuple) else None
            other = not more and (_buttons(y.text) or bool(_CUE.search(y.text)) or _bar(y.text) or _MARK.search(before.text) or below is not None and not (below.heading or _MARK.search(below.text) or _bar(below.text) or _buttons(below.text)))
            return 0 if other else k - at
        if not titled:
            return 0
        k += 1
    return 0


def _bar(text: str) -> tuple[str, float] | None:
    """(class, evidence) of names of pages in a row, of a trail, or of links to the pages before and after."""
    trail = [p for p in _TRAIL.split(text) if p.strip()]
    parts = [p for p in _BAR.split(text) if p.strip()]
    if _SENTENCE.search(text) or _CODE.search(text) or text.count("(") != text.count(")"):
        return None
    arrows = (text[0] in _ARROWS or text[-1] in _ARROWS) and not _SENTENCE_END.search(text)
    if len(trail) > 1 and not arrows and all(len(p.split()) <= 12 for p in trail):
        return f"{trail[0].strip().lower()} > *", 0.3
    if arrows or len(parts) > 1 and all(_is_label(p.split(":")[0].strip()) for p in parts):
        name = " | ".join(re.sub(r":.*", ": *", p.strip(_ARROWS + " ")) for p in parts)
        return name, 0.3 + 0.05 * arrows
    return None


def _boxes(lines: list[str], site: re.Pattern | None) -> list[Box]:
    """The containers of a page in order, solid ones included."""
    parts = list(_texts(lines))
    own = lambda t: _klass(t, site)
    out: list[Box] = []
    titled = False
    k = 0
    while k < len(parts):
        x = parts[k]
        k += 1
        if isinstance(x, tuple):
            out.append(Box(list(range(x[0], x[1] + 1)), "block", solid=True))
            continue
        text, alone = x.text, x.first and x.last
        if _TAGS.fullmatch(text):
            out.append(Box([x.no], "tags", "#", 0.45, links=x.links, alone=alone))
            continue
        label = _is_label(text)
        if not x.item and not x.last and (x.heading or label or x.first) and (n := _closed_below(parts, k - 1)):
            rest = parts[k : k + n]
            k += n
            closing = rest[-1].text
            out.append(Box([x.no, *(r.no for r in rest)], "teaser", "… " + own(closing), 0.3, bool(_READ_MORE.match(closing)) or bool(_CUE.search(text)), x.links))
            continue
        if not x.item and text and (x.heading or label) and (n := _list_below(parts, k - 1)):
            rest = parts[k : k + n]
            k += n
            links = sum(r.links == 1.0 for r in rest) / n
            listed = text.lower().strip(" :") in _LEADS or bool(re.match(r"^\d+ (?:comments?|commentaires?|kommentare?|comentarios?)$", text, re.I))
            remarks = not rest[0].item and bool(_SPEAKS.match(rest[0].text))
            out.append(Box([x.no, *(r.no for r in rest)], "titled", own(text.strip(" :")), 0.25 + 0.4 * links + 0.1 * remarks, listed, links))
            titled |= x.heading
            continue
        if x.heading:
            out.append(Box([x.no], "heading", solid=True))
            titled = True
            continue
        if not re.search(r"[^\W\d_]", text):
            continue
        if x.item:
            if x.links == 1.0 and not x.raw.startswith("!"):
                out.append(Box([x.no], "link item", own(text), 0.3, _named_by_sites(text), 1.0))
            else:
                out.append(Box([x.no], "item", own(text), 0.15, _named_by_sites(text), x.links, solid=titled))
            continue
        bar = _bar(text)
        if bar:
            names = [p.strip(" «»←→☰") for p in re.split(f"{_BAR.pattern}|{_TRAIL.pattern}", text) if p.strip(" «»←→☰")]
            listed = 2 * sum(_named_by_sites(re.sub(r"\s?:.*", "", p)) or bool(_CUE.search(p)) for p in names) >= len(names)
            out.append(Box([x.no], "bar", own(bar[0]), bar[1], listed or bool(_LANGS.match(text)), x.links, alone=alone))
        elif x.links == 1.0 and not x.raw.startswith("!"):
            out.append(Box([x.no], "link", own(text), 0.35, _named_by_sites(text), 1.0, alone=alone))
        elif label or _MARK.search(text) or text[-1] in ":…" and len(text.split()) <= 8 and _CUE.search(text):
            if x.raw.startswith(("**", "__")) and x.raw.endswith(("**", "__")):
                out.append(Box([x.no], "heading", solid=True))
                continue
            signs = 0.15 + 0.25 * bool(_MARK.search(text)) + 0.25 * (text[0] in "☰≡")
            listed = _named_by_sites(text) or bool(_CUE.search(text)) or _buttons(text)
            out.append(Box([x.no], "label", own(text), signs, listed, x.links, alone=alone))
        elif (m := _TEASES.search(text)) and (x.last or _READ_MORE.match(m[1])):
            out.append(Box([x.no], "teaser", "… " + own(m[1]), 0.3, bool(_READ_MORE.match(m[1])), x.links, alone=alone))
        else:
            listed = bool(_CUE.search(text))
            below = k < len(parts) and not x.last and not isinstance(parts[k], tuple) and not parts[k].item and _is_label(parts[k].text)
            ours = bool(site and site.search(text))
            if listed or below or ours or alone and len(text.split()) <= 12:
                out.append(Box([x.no], "said", own(text), 0.25 * listed + 0.15 * ours + 0.1 * below, listed, x.links, solid=not (listed or ours), alone=alone and listed))
            else:
                out.append(Box([x.no], "prose", solid=True))
    return out


def _buttons(text: str) -> bool:
    """Names of a site's pages and buttons in a row, with single blanks between."""
    rest = text.lower()
    for label in _BY_LENGTH:
        if label in rest:
            rest = rest.replace(label, " ")
    return not rest.strip(" |·")


def read_page(markdown: str, host: str) -> list[Box]:
    """Candidate containers of a page with their paths and the page's own score in [0, 1]."""
    lines = markdown.split("\n")
    site = _site(host)
    boxes = _boxes(lines, site)
    firm = [i for i, b in enumerate(boxes) if b.solid]
    first, last = (firm[0], firm[-1]) if firm else (len(boxes), len(boxes))
    for i, b in enumerate(boxes):
        b.place = "before" if i < first else "after" if i > last else "within"
        b.score = b.signs + 0.35 * (b.place != "within") + 0.2 * b.listed + 0.1 * (b.alone and b.place == "within")
    near = [bool(not b.solid and b.score >= WINS) for b in boxes]
    edge = _edge(lines)
    out: list[Box] = []
    for i, b in enumerate(boxes):
        if b.solid and b.kind not in ("said", "prose"):
            continue
        b.at_edge = b.lines[0] in edge
        if b.kind == "prose" and not b.at_edge:
            continue
        if b.kind == "prose":
            b.name = _klass(_plain(lines[b.lines[0]]), site)
        beside = [j for j in (i - 1, i + 1) if 0 <= j < len(boxes) and near[j] and min(abs(boxes[j].lines[-1] - b.lines[0]), abs(boxes[j].lines[0] - b.lines[-1])) <= 2]
        b.score = max(0.0, min(1.0, b.score + 0.1 * bool(beside)))
        depth = 2 if b.kind in ("titled", "item", "link item") else 1
        b.named = f"{'within' if b.place == 'within' else 'edge'}/{b.kind}/{b.name}"
        b.shape = f"{b.place}/{b.kind}/{depth}/{round(2 * b.links)}/{min(3, len(b.name.split()) // 3)}"
        out.append(b)
    return out


def _edge(lines: list[str]) -> set[int]:
    """Lines at the edges of a page, without headings, tables, code and formulas."""
    shown = [i for i, x in enumerate(lines) if x.strip(" \t\r\ufeff\u200b\u00a0")]
    outer = {*shown[:EDGE], *shown[-EDGE:]}
    out: set[int] = set()
    fence = math = False
    for i in shown:
        s = lines[i].strip()
        if fence:
            fence = not (_FENCE.match(lines[i]) and not s.strip("`~"))
        elif math:
            math = "$$" not in s
        elif _FENCE.match(lines[i]):
            fence = True
        elif s.startswith("$$"):
            math = s == "$$" or not s.endswith("$$")
        elif i in outer and not (_HEADING.match(s) or s.startswith("|") and s.endswith("|") or s.startswith("--- [")) and re.search(r"[^\W\d_]", _plain(s)):
            out.add(i)
    return out


CANDIDATE = "document_id long, host string, line_no long, path long, shape long, score double, votes boolean, repeats boolean"


def _host(url: str) -> F.Column:
    return F.coalesce(F.nullif(host_of(F.col(url)), F.lit("")), F.lit("?"))  # an address that can't be read has a host of its own


def candidates(pages: DataFrame) -> DataFrame:
    """Candidate lines of pages (document_id, host, markdown), each page once, and one row of each
    page with line -1. `votes` marks the first line of the first container of a path on its page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        key = lambda t: xxhash.xxh64_intdigest(t) - 2**63
        for pdf in batches:
            rows = []
            for doc, host, text in zip(pdf["document_id"], pdf["host"], pdf["markdown"]):
                rows.append((doc, host, -1, 0, 0, 0.0, False, False))
                seen: set[str] = set()
                for b in read_page(text, host):
                    path, shape = key(b.named), key(b.shape)
                    for i, line in enumerate(b.lines):
                        votes = not i and b.named not in seen
                        rows.append((doc, host, line, path, shape, b.score, votes, votes and b.at_edge))
                    seen.add(b.named)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    # a repeated page gives the same lines again; they are told apart from texts' repeats by their numbers alone
    lines = spread(pages).mapInPandas(run, CANDIDATE)
    return lines.groupBy("document_id", "line_no").agg(*[F.first(c).alias(c) for c in ("host", "path", "shape", "score", "votes", "repeats")])


def vote(found: DataFrame) -> DataFrame:
    """(host, path, share): the host's vote on each of its named paths."""
    voters = found.where("votes")
    named = voters.groupBy("host", "path").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.sum(F.col("repeats").cast("int")).alias("r"), F.mode("shape", True).alias("shape"))
    n_pages = found.where("line_no < 0").groupBy("host").agg(F.count("*").alias("pages"))
    by_shape = voters.groupBy("host", "shape").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    shape_all = by_shape.groupBy("shape").agg((F.sum("s") / F.sum("n")).alias("m"))
    shape_host = by_shape.join(shape_all, "shape").select("host", "shape", ((F.col("s") + PRIOR * F.col("m")) / (F.col("n") + PRIOR)).alias("shape_mean"))
    overall = named.groupBy("path").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n_all"), F.count("*").alias("hosts"))
    j = named.join(shape_host, ["host", "shape"]).join(overall, "path").join(n_pages, "host")
    known = F.least(F.lit(KNOWN), F.col("n_all") - F.col("n") + 1)
    backed = (F.col("s") + PRIOR * F.col("shape_mean") + known * F.col("mean")) / (F.col("n") + PRIOR + known)
    bonus = BONUS * F.least(F.lit(1.0), (F.col("n") - 1) / F.greatest(F.lit(3.0), OFTEN * F.col("pages")))
    repeated = F.when(F.col("r") >= REPEATS_LEAST, F.col("r") / F.col("pages")).otherwise(0.0)
    shared = ELSEWHERE * F.least(F.lit(1.0), (F.col("hosts") - 1) / 3)
    return j.select("host", "path", F.greatest(backed + F.least(F.lit(REPEATED), bonus + shared), repeated).alias("share"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, host, markdown) of web pages, repeated rows included."""
    docs = table(spark, sf_dir, "extracted_documents")
    web = docs.select("document_id", "markdown", F.col("metadata").getItem("source_url").alias("url")).where("url is not null and markdown is not null and document_id is not null")
    return web.select("document_id", _host("url").alias("host"), "markdown")


def furniture(pages: DataFrame) -> DataFrame:
    """(document_id, line_no) of lines whose path won its host's vote."""
    lines = cut_lineage(candidates(pages))  # pages are read once; votes and result both come from these small rows
    return lines.where("line_no >= 0").join(vote(lines), ["host", "path"]).where(F.col("share") >= WINS).select("document_id", "line_no")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web pages that aren't main body."""
    return furniture(pages_of(spark, sf_dir))


def main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main body alone, by the same winning paths."""
    pages = pages_of(spark, sf_dir)
    drop = furniture(pages).groupBy("document_id").agg(F.collect_set("line_no").alias("drop"))  # one page's lines
    lines = F.filter(F.transform(F.split("markdown", "\n"), lambda x, i: F.when(~F.array_contains(F.coalesce("drop", F.array().cast("array<bigint>")), i.cast("long")), x)), lambda x: x.isNotNull())
    body = F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"))
    return pages.dropDuplicates(["document_id"]).join(drop, "document_id", "left").select("document_id", body.alias("body"))


def by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture by host."""
    pages = pages_of(spark, sf_dir)
    hosts = pages.groupBy("document_id").agg(F.first("host").alias("host"))
    return furniture(pages).join(hosts, "document_id").groupBy("host").agg(F.count("*").alias("n_lines"), F.countDistinct("document_id").alias("n_pages"))


QUERIES = {"p2_found": found, "p2_main_body": main_body, "p2_by_host": by_host}
ORACLES: dict[str, str] = {}
