"""Problem 9: sentence units of every document, in any language and script.

Boundary rules are compiled into a finite transducer. A scanner turns the text into symbols
(terminators, quotation and bracket marks, line breaks, fences, formulas, blanks of scripts
without marks); classification looks only at a bounded context. The table `STEP` maps state and
symbol to the next state and says whether a unit ends there.

A document longer than `CHUNK` characters is read in chunks. Each chunk is first read from all
states at once, which gives its state-transition function; the functions of a document are
composed by a parallel prefix scan (doubling), which gives the state each chunk starts in; then
every chunk emits the units that lie within it, and one row of what stays open at its two borders,
from which the units that cross borders are joined. Short documents are one chunk that starts in the
first state.

Null texts, and texts without visible characters, have no units. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, spread, table

CHUNK = 16_384
SLACK = 8  # characters by which later edits may have changed a wrapped line
MARGIN = 512  # context beyond a chunk's borders; no rule looks further

# ---- states and symbols ----------------------------------------------------------------------
# text states: line kind (0 prose, 1 heading or item) x quotation (0 none, 1 open, 2 open after a
# colon) x bracket (0 none, 1 of its own, 2 within a sentence); then open fences and formula
_TEXT = [(k, q, b) for k in (0, 1) for q in (0, 1, 2) for b in (0, 1, 2)]
TICKS, TILDES, MATH = len(_TEXT), len(_TEXT) + 1, len(_TEXT) + 2
N_STATES = len(_TEXT) + 3
SYMBOLS = "para line item stop quote quote_intro unquote unquote_end unquote_lower unquote_on bracket_own bracket unbracket unbracket_end ticks ticks_bare tildes tildes_bare math".split()
_S = {name: i for i, name in enumerate(SYMBOLS)}


def _rule(state: int, symbol: str) -> tuple[int, bool]:
    """Next state, and whether a unit ends at the symbol."""
    if state == TICKS:
        return (0, True) if symbol == "ticks_bare" else (state, False)
    if state == TILDES:
        return (0, True) if symbol == "tildes_bare" else (state, False)
    if state == MATH:
        return (0, True) if symbol == "math" else (state, False)
    k, q, b = _TEXT[state]
    to = lambda k, q, b: _TEXT.index((k, q, b))
    plain = k == 0 and q == 0 and b == 0
    match symbol:
        case "para" | "line":
            return to(0, 0, 0), True
        case "item":
            return to(1, 0, 0), True
        case "ticks" | "ticks_bare":
            return TICKS, False
        case "tildes" | "tildes_bare":
            return TILDES, False
        case "math":
            return MATH, False
        case "stop":
            return state, plain
        case "quote":
            return (to(k, 1, b), False) if q == 0 else (state, False)
        case "quote_intro":
            return (to(k, 2, b), False) if q == 0 else (state, False)
        case "unquote" | "unquote_on":
            return to(k, 0, b), False
        case "unquote_end":
            return to(k, 0, b), k == 0 and b == 0
        case "unquote_lower":
            return to(k, 0, b), k == 0 and b == 0 and q == 2
        case "bracket_own":
            return (to(k, q, 1), False) if b == 0 else (state, False)
        case "bracket":
            return (to(k, q, 2), False) if b == 0 else (state, False)
        case "unbracket":
            return to(k, q, 0), False
        case "unbracket_end":
            return to(k, q, 0), b == 1 and k == 0 and q == 0
    raise ValueError(symbol)


_TABLE = [[_rule(s, x) for x in SYMBOLS] for s in range(N_STATES)]
NEXT = np.array([[to for to, _ in row] for row in _TABLE], dtype=np.int16)
STEP = [[to * 2 + cut for to, cut in row] for row in _TABLE]

# ---- scanner ---------------------------------------------------------------------------------

_HIDDEN = "﻿​‌‍⁠"
_STOPS = ".!?…。！？｡．।؟"
_OPENERS = "«“„「『‹"
_CLOSERS = "»”」』›"
_THAI = "฀-๿"
_BLANKS = r"[^\S\n]"
_SCAN = re.compile(
    rf"(?P<para>\n[\s{_HIDDEN}]*\n[\s{_HIDDEN}]*)"
    r"|(?P<line>\n)"
    r"|(?P<fence>^[ \t]{0,3}(?:`{3,}|~{3,})[^\n]*)"
    r"|(?P<math>\$\$)"
    rf"|(?P<stop>[{_STOPS}]+)"
    rf"|(?P<quote>[{_OPENERS}{_CLOSERS}\"])"
    r"|(?P<bracket>[()（）])"
    rf"|(?P<blank>(?<=[{_THAI}0-9A-Za-z)%])[^\S\n]+(?=[\"“(]?[{_THAI}]))",
    re.M,
)
_MARKER = re.compile(rf"{_BLANKS}*(?:(?P<head>#{{1,6}}{_BLANKS})|(?P<bullet>[-*•+–]{_BLANKS})|(?P<number>\d+(?:\.\d+)*(?:\.|\)|-\.?|\.-){_BLANKS}(?=\S))|(?P<dash>[—―]{_BLANKS}?)|(?P<label>\w{{1,20}}(?: \d+)?{_BLANKS}?[:：]{_BLANKS}))")
# fixed values: abbreviations before whose full stop a sentence goes on
_ABBREVIATIONS = frozenset(
    "e.g i.e cf fig figs eq eqs sec secs ed eds vol al vs dr mr mrs ms prof pp ph.d u.s u.k a.m p.m approx resp ca st jr"
    " c.-à-d éd éq env chap art mme mlle mm ex réf trad"
    " sr sra srta dra dr ej ec aprox cap pág págs núm ee.uu ud uds"
    " abb bd bzw gl hrsg kap nr vgl ggf evtl sog inkl bspw z.b d.h u.a s.o str"
    " рис гл см стр проф напр т.е ср акад ул د डॉ श्री".split()
)
_NUMBERED = frozenset("no nos n° nº art chap".split())  # only before a figure
_ORDINAL = re.compile(r"(?:^|\s)(?:der|die|das|dem|den|des|am|im|vom|zum|zur|beim|bis|seit|ab|und)\s+\d{1,3}$", re.I)
# fixed values: words that open a sentence after an initial, and are no surnames
_STARTERS = frozenset(
    "The This That These Those He She It They We You There Here His Her Its But And When While If Il Elle Ils Elles On Nous Ce Cette Ces Cela Ceci Les Mais Et Dans Quand Er Sie Es Wir Ihr Der Die Das Dies Diese Dieser Dieses Aber Und Wenn Él Ella Ellos Ellas El Los Las Este Esta Esto Estos Estas Pero Cuando".split()
)
# fixed values: words of scripts without marks after which, or before which, a blank ends nothing
_OPENING_WORDS = frozenset("ดังนั้น อย่างไรก็ตาม ในบทนี้ โดยทั่วไป ในทางปฏิบัติ ระหว่างการฝึก หลังจากลู่เข้าแล้ว และ หรือ แต่ เพราะ นอกจากนี้ กล่าวคือ ตัวอย่างเช่น ประมาณ เมื่อ หาก ถ้า สำหรับ ในกรณีนี้ ต่อมา จากนั้น ทั้งนี้ ในที่สุด สุดท้าย อันที่จริง เช่น".split())
_CONTINUES = re.compile(r"[\"“(]?(?:ประมาณ|และ|หรือ|บนชุด|บน|ซึ่ง|ที่|เพราะ|เนื่องจาก|แต่|จาก|ถึง|ต่อ|ครั้ง|เท่า|เปอร์เซ็นต์|ของ|ด้วย|เช่น|ฯลฯ|ๆ)")
_CASELESS = re.compile(r"[぀-ヿ一-鿿가-힯]")
_WORD_BEFORE = re.compile(r"[^\s(\[«“„\"'’–—/]+$")


def _ends_sentence(text: str, m: re.Match, nxt: str, spaced: bool) -> bool:
    """Whether this run of terminators ends a sentence, by its neighbours alone."""
    run, at = m.group(), m.start()
    if not nxt:
        return True
    if run.strip("."):  # holds a mark other than full stops
        if any(c in "。！？｡।؟" for c in run):
            return True
        if run == "．":
            return not (nxt.isdigit() and at and text[at - 1].isdigit())
        if "!" in run or "?" in run:
            return spaced or bool(_CASELESS.match(nxt)) or nxt.isupper()
        return spaced and not nxt.islower()  # an ellipsis
    if len(run) > 1:
        return spaced and not nxt.islower()
    before = text[max(0, at - 40) : at]
    if not spaced:
        if nxt.isupper():
            tail = text[m.end() + 1 : m.end() + 2]
            return bool(re.search(r"[^\W\d_A-Z]{3}$", before)) and (tail.islower() or tail.isspace() or tail in "’'")
        return bool(_CASELESS.match(nxt)) and not before[-1:].isdigit()
    w = _WORD_BEFORE.search(before)
    word = w.group() if w else ""
    low = word.lower()
    if low in _ABBREVIATIONS:
        return False
    if low in _NUMBERED and nxt.isdigit():
        return False
    if len(word) == 1 and word.isalpha() and not _CASELESS.match(word):
        if word.isupper() and word.lower() != word:  # an initial, unless a word follows that opens sentences and no name
            follows = re.match(r"\s+([^\W\d_]+)", text[m.end() : m.end() + 40])
            return word != "M" and follows is not None and follows[1] in _STARTERS
        if nxt.islower() or nxt.isdigit():
            return low == "д"
        if re.match(r"\s*[^\W\d_]\.", text[m.end() : m.end() + 8]):
            return low == "д"  # one more letter of an abbreviation follows
        return low == "д" or not re.search(r"(?:^|\W)\w\.\s*\w$", before)
    if word.isdigit() and len(word) <= 3 and _ORDINAL.search(before):
        return False
    if nxt.islower() and len(word) <= 2 and word.isalpha():
        return low == "д"
    return True


# lines that aren't wrapped with the prose: items, headings, table rows, code, formulas
_UNWRAPPED = r"^ *([-*•+–—#|`~$]|[0-9]+[.)-]|[0-9.]+[.-] |L = |    |def |from |import |return )"
_UNWRAPPED_RE = re.compile(_UNWRAPPED)


_BLANK_LINES = r"\n(?:[ \t\r]*\n)+"


def wrap_width(text: str) -> int:
    """Width at which this text's prose was wrapped, or 0 if it wasn't: the longest line of its
    paragraphs of several lines, without the paragraphs that hold a line too long for a wrap."""
    width = 0
    for paragraph in re.split(_BLANK_LINES, text):
        lines = [len(x.rstrip(" ")) for x in paragraph.split("\n") if x.strip(" ") and not _UNWRAPPED_RE.match(x)]
        if len(lines) > 1 and 30 <= max(lines) <= 110:
            width = max(width, max(lines))
    return width


def scan(text: str, first: int, last: int, width: int) -> Iterator[tuple[int, int]]:
    """(symbol, end) of every symbol that starts in [first, last)."""
    n = len(text)
    for m in _SCAN.finditer(text):
        at, end = m.span()
        if at < first:
            continue
        if at >= last:
            return
        kind = m.lastgroup
        if kind == "stop":
            j = end
            while j < n and text[j].isspace() and text[j] != "\n":
                j += 1
            nxt = text[j] if j < n else ""
            if nxt and (nxt in _CLOSERS or (nxt in "\")）" and j == end)):
                continue  # the mark that closes decides
            if nxt == "“" and j == end:
                continue
            spaced = j > end
            if nxt == "\n":
                spaced = True
                k = j
                while k < n and text[k].isspace():
                    k += 1
                nxt = text[k] if k < n else ""
            if _ends_sentence(text, m, nxt, spaced):
                yield _S["stop"], end
        elif kind == "quote":
            c = text[at]
            prev = text[at - 1] if at else "\n"
            if c == '"':
                opening = prev.isspace() or prev in "(:："
            elif c == "“":  # opens in English, closes in German
                opening = not (prev in _STOPS or (prev.isalnum() and "„" in text[max(0, at - 200) : at]))
            else:
                opening = c in _OPENERS
            if opening:
                i = at - 1
                while i >= 0 and text[i].isspace():
                    i -= 1
                yield _S["quote_intro" if i >= 0 and text[i] in ":：" else "quote"], end
                continue
            i = at - 1
            while i >= 0 and text[i] in "   \t":
                i -= 1
            if i < 0 or text[i] not in _STOPS + ")":
                yield _S["unquote"], end
                continue
            if text[i] == ")" and (i == 0 or text[i - 1] not in _STOPS):
                yield _S["unquote"], end
                continue
            j = end
            while j < n and text[j].isspace():
                j += 1
            nxt = text[j] if j < n else ""
            if nxt and nxt in ",;:—–-،，、" + _STOPS:
                yield _S["unquote_on"], end
            elif nxt and (nxt.islower() or _CASELESS.match(nxt)):
                yield _S["unquote_lower"], end
            else:
                yield _S["unquote_end"], end
        elif kind == "bracket":
            c = text[at]
            if c in "(（":
                i = at - 1
                while i >= 0 and text[i].isspace():
                    i -= 1
                own = i < 0 or text[i] in _STOPS + _CLOSERS + ")—" or "\n" in text[i + 1 : at] and "\n\n" in text[i + 1 : at]
                yield _S["bracket_own" if own else "bracket"], end
            else:
                nxt = text[end : end + 1]
                ended = at > 0 and (text[at - 1] in _STOPS or text[at - 1] in _CLOSERS and text[max(0, at - 3) : at - 1].strip()[-1:] in _STOPS)
                yield _S["unbracket_end" if ended and not (nxt and nxt in ",;:.，、") else "unbracket"], end
        elif kind == "line" or kind == "para":
            follows = _MARKER.match(text, end)
            if kind == "para":
                yield _S["item" if follows and (follows["head"] or follows["bullet"] or follows["number"]) else "para"], end
                continue
            if text.startswith(("```", "~~~", "$$", "|"), end) or text[end : end + 1] == "":
                yield _S["line"], end
                continue
            start = text.rfind("\n", 0, at) + 1
            line = text[start:at].rstrip()
            word = re.match(r"\s*\S*", text[end : end + 60]).group().strip()
            wrapped = width > 0 and len(line) + 1 + len(word) > width - SLACK
            if follows:
                if follows["number"] and wrapped and line and line[-1] not in _STOPS and not _MARKER.match(line):
                    continue
                yield _S["item" if follows["head"] or follows["bullet"] or follows["number"] else "line"], end
            elif not wrapped or line.lstrip().startswith("#"):
                yield _S["line"], end
            else:  # a wrap is a blank
                nxt = text[end : end + 1]
                if re.match(rf"[{_THAI}]", nxt) and line and re.match(rf"[{_THAI}0-9A-Za-z)%]", line[-1]) and _blank_ends(text, at, end):
                    yield _S["stop"], end
        elif kind == "fence":
            tick = m.group().lstrip()[0] == "`"
            bare = not m.group().strip("`~ \t")
            yield _S[("ticks" if tick else "tildes") + ("_bare" if bare else "")], end
        elif kind == "math":
            yield _S["math"], end
        elif _blank_ends(text, at, end):
            yield _S["stop"], end


def _blank_ends(text: str, at: int, end: int) -> bool:
    """Whether a blank before a script without marks ends a sentence."""
    if _CONTINUES.match(text, end):
        return any(text.startswith(w, end) for w in ("เพราะฉะนั้น", "ต่อมา", "จากนั้น"))
    w = _WORD_BEFORE.search(text[max(0, at - 60) : at])
    word = w.group() if w else ""
    if word in _OPENING_WORDS:
        return False
    return not re.fullmatch(r"(?:\d+[.)])|[#*•+—–-]+|(?:Student|Tutor|\w+):", word)


def first_state(text: str) -> int:
    """The state before the first character: a text may open with a heading or an item."""
    m = _MARKER.match(text.lstrip("\n\r\t " + _HIDDEN))
    return _TEXT.index((1, 0, 0)) if m and (m["head"] or m["bullet"] or m["number"]) else 0


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in _HIDDEN):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in _HIDDEN):
        b -= 1
    return a, b


def emit(text: str, first: int, last: int, width: int, state: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Segments (start, end, closed) of [first, last) and the state at its end; the last segment
    stays open. A cut may lie a little past `last`: the character there is blank or a mark."""
    out, at = [], first
    for symbol, end in scan(text, first, last, width):
        code = STEP[state][symbol]
        state = code >> 1
        if code & 1:
            a, b = _trim(text, at, end)
            out.append((a, b, True))
            at = end
    if at < last:
        a, b = _trim(text, at, last)
        out.append((a, b, False))
    return out, state


def transition(text: str, first: int, last: int, width: int) -> np.ndarray:
    """The chunk's state-transition function: the state it ends in, for each it may start in."""
    f = np.arange(N_STATES, dtype=np.int16)
    for symbol, _ in scan(text, first, last, width):
        f = NEXT[f, symbol]
    return f


def prefix_scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of functions (rows) under composition, in log2(rows) parallel rounds."""
    f = functions.copy()
    step = 1
    while step < len(f):
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.int64), axis=1)
        step *= 2
    return f


def units(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentence units of one text."""
    if not text:
        return []
    segments, _ = emit(text, 0, len(text), wrap_width(text), first_state(text))
    return [(a, b) for a, b, _ in segments if a < b]


# ---- over documents --------------------------------------------------------------------------

UNITS = "doc_id long, start_char long, end_char long"


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            for a, b in units(text):
                ids.append(doc)
                starts.append(a)
                ends.append(b)
        yield pd.DataFrame({"doc_id": ids, "start_char": starts, "end_char": ends}).astype("int64")


def _window(r) -> tuple[str, int, int, int]:
    """A chunk's text with margins, its borders therein, and the offset of position 0."""
    lead = r.first - r.offset
    text = r.body
    if r.offset:  # a letter before keeps the slice's start from looking like a line's start
        return "x" + text, lead + 1, lead + 1 + r.size, r.offset - 1
    return text, lead, lead + r.size, 0


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            text, a, b, _ = _window(r)
            f = transition(text, a, b, r.width)
            rows.append((r.doc_id, r.chunk_no, [int(f[first_state(text)])] * N_STATES if r.chunk_no == 0 else f.tolist()))
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "f"])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk_no")
    scanned = prefix_scan(np.array(pdf["f"].tolist(), dtype=np.int16).reshape(len(pdf), N_STATES))
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "chunk_no": pdf["chunk_no"].to_numpy() + 1, "state": scanned[:, 0].astype("int32")})


_SEGMENT = "doc_id long, chunk_no int, start_char long, end_char long, edge boolean, passed boolean, tail_start long, tail_end long"
_SEGMENT_COLUMNS = [c.split()[0] for c in _SEGMENT.split(", ")]
Span = tuple[int, int] | None


def _joined(a: Span, b: Span) -> Span:
    return (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b


def borders(segments: list[tuple[int, int, bool]]) -> tuple[list[tuple[int, int]], Span, bool, Span]:
    """(units within a chunk, what is open at its start, whether a unit ends in it, what is open at its end)."""
    within: list[tuple[int, int]] = []
    head: Span = None
    now: Span = None
    passed = False
    for a, b, closed in segments:
        if a < b:
            now = _joined(now, (a, b))
        if closed:
            if not passed:
                head, passed = now, True
            elif now:
                within.append(now)
            now = None
    return (within, head, True, now) if passed else (within, now, False, None)


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            text, a, b, shift = _window(r)
            found, _ = emit(text, a, b, r.width, first_state(text) if r.chunk_no == 0 else int(r.state))
            within, head, passed, tail = borders(found)
            at = lambda span: (span[0] + shift, span[1] + shift) if span else (None, None)  # noqa: B023, E731
            rows += [(r.doc_id, r.chunk_no, *at(x), False, None, None, None) for x in within]
            rows.append((r.doc_id, r.chunk_no, *at(head), True, passed, *at(tail)))
        out = pd.DataFrame(rows, columns=_SEGMENT_COLUMNS)
        yield out.astype({c: "Int64" for c in ("start_char", "end_char", "tail_start", "tail_end")})


def _crossing(pdf: pd.DataFrame) -> pd.DataFrame:
    """The units of a document that cross borders of its chunks."""
    rows = []
    now: Span = None
    whole = lambda a, b: None if pd.isna(a) else (int(a), int(b))
    for r in pdf.sort_values("chunk_no").itertuples(index=False):
        now = _joined(now, whole(r.start_char, r.end_char))
        if r.passed:
            rows += [now] if now else []
            now = whole(r.tail_start, r.tail_end)
    rows += [now] if now else []
    return pd.DataFrame([(pdf["doc_id"].iloc[0], a, b) for a, b in rows], columns=["doc_id", "start_char", "end_char"]).astype("int64")


_CHUNKS = "doc_id long, chunk_no int, width int, first long, offset long, size long, body string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts cut into chunks with margins; each text is gone through once."""
    for pdf in batches:
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            width = wrap_width(text)
            rows = []
            for no, first in enumerate(range(0, len(text), CHUNK)):
                offset, size = max(0, first - MARGIN), min(CHUNK, len(text) - first)
                rows.append((doc, no, width, first, offset, size, text[offset : first + size + MARGIN]))
                if len(rows) == 256:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNKS.split(", ")])
                    rows = []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNKS.split(", ")])


def sentence_units(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of every unit of every document.

    Short documents need no shuffle. The chunks of long ones are spread over all tasks; what meets
    in one task for a document are the numbers of its chunks, a transition function and the open
    borders for each `CHUNK` characters.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    short = spread(docs.where(F.length("text") <= CHUNK)).mapInPandas(_short, UNITS)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = docs.where(F.length("text") > CHUNK).mapInPandas(_cut, _CHUNKS).repartition(n, "doc_id", "chunk_no")
    functions = chunks.mapInPandas(_functions, "doc_id long, chunk_no int, f array<int>")
    entries = functions.groupBy("doc_id").applyInPandas(_entries, "doc_id long, chunk_no int, state int")
    segments = cut_lineage(chunks.join(entries, ["doc_id", "chunk_no"], "left").mapInPandas(_segments, _SEGMENT))  # numbers only
    crossing = segments.where("edge").groupBy("doc_id").applyInPandas(_crossing, UNITS)
    return short.unionByName(segments.where("not edge").select("doc_id", "start_char", "end_char")).unionByName(crossing)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of all documents."""
    return sentence_units(table(spark, sf_dir, "documents"))


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and their lengths by source."""
    docs = table(spark, sf_dir, "documents")
    u = sentence_units(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
    return u.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_units"), F.sum("chars").alias("n_chars"))


QUERIES = {"p9_found": found, "p9_by_source": by_source}
ORACLES: dict[str, str] = {}
