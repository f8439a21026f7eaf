"""Problem 5: noise in text from scanned pages.

Noisy-channel correction. Word and word-pair counts over all pages give the language model;
character confusion probabilities are estimated from rare words that one confusion turns into
frequent ones. Each line is a lattice of candidate words, and Viterbi decoding picks the path with
the largest product of channel and pair likelihoods. Words broken at a line's end are joined first,
page numbers are told by their sequence over the pages, and running heads by where they stand and
recur.

Counts cover all documents and all words and pairs; nothing is pruned or sampled. Each word form is
joined with the frequent words one confusion away. A confusion's rate is the share of its
occurrences that such forms hold, a form counting unless it is seen more often than the rates
explain. Rates are averages, and a word's own may be some times as large (scanned pages have another
share of the languages, and a reader errs once a word), so a form is a word only beyond `SPREAD`
times what they explain; both grow with the input, and a form is judged alike at any size. Scanned documents are read in buckets of bounded size; a bucket is sent the counts of the
words, candidates and pairs that occur in its own lines.

Rows: documents without `source_id`, or with a null or empty text, have no lines; a repeated
document counts once; line numbers count from 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table

BUCKET_DOCS = 4_000  # documents a bucket holds at most on average; bounds the memory of a task
STRONG = 20  # occurrences of a word that others may be misread from
KNOWN = 3  # occurrences, beyond those that confusion may explain, that make a word known
SPREAD = 6  # times the average that the rate of a confusion may be in one word
TWICE = 2e-6  # chance that a word has two confusions, or a blank read as a character; above the square of the rates
LEAST = 4  # characters of a form that rates are estimated from, and of the words it may come from
ROUNDS = 5  # of the estimation of rates
REACH = 9.4  # most that the pairs on both sides of a word can favour one candidate over another
_HYPHENS = "-‐‑­¬"
_PAGE = re.compile(r"^\s*<!-- loc page=(\d+) -->\s*$")
# fixed values: confusions known of optical readers, beside those estimated (read wrongly as)
_MULTI = [("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ni", "m"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("u", "ii"), ("n", "ri"), ("k", "lc")]
_SINGLE = {"e": "c", "r": "i", "a": "@", "i": "l1!|", "l": "1|I", "t": "f", "o": "0", "s": "5", "u": "n", "h": "b", "g": "9", "é": "6", "b": "6h", "z": "2", "c": "e", "n": "u", "f": "t", "q": "9", "y": "v"}
_TOKEN = re.compile(r"(?:[^\s.,;:?()«»“”„\"…\[\]—–’'/=<>{}+*^\\$~%¿¡]|(?<=[^\W\d_A-Z])\.(?=[^\W\d_A-Z]))+")


def words_of(line: str) -> list[tuple[int, str]]:
    """(position, word) of a line; a final `!` isn't part of a word, an inner one may be misread."""
    out = []
    for m in _TOKEN.finditer(line):
        w = m.group()
        if w.isalpha():
            out.append((m.start(), w))
            continue
        lead = len(w) - len(w.lstrip("-‐•"))
        if w[lead : lead + 1] == "!" and not w[lead + 1 : lead + 2].islower():
            lead += 1
        w = w[lead:].rstrip("!")
        if w and re.search(r"[^\W\d_]", w):
            out.append((m.start() + lead, w))
    return out


# ---- language model --------------------------------------------------------------------------


def _counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) and (a, b, n) over all lines. Words at a line's end that may be broken, and the
    rest of them, don't count; pairs don't cross lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one: Counter = Counter()
        two: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [(a, None, n) for a, n in one.items()] + [(a, b, n) for (a, b), n in two.items()]
            one.clear()
            two.clear()
            return pd.DataFrame(rows, columns=["a", "b", "n"])

        for pdf in batches:
            for text in pdf["body"]:
                broken = False
                for line in text.split("\n"):
                    ws = [w.lower() for _, w in words_of(line)]
                    if not ws:
                        continue
                    ends = line.rstrip()[-1:] in _HYPHENS
                    if broken:
                        ws = ws[1:]
                    if ends:
                        ws = ws[:-1]
                    broken = ends
                    one.update(ws)
                    two.update(zip(ws, ws[1:]))
            if len(one) + len(two) > 200_000:
                yield flush()
        yield flush()

    parts = texts.select("body").mapInPandas(run, "a string, b string, n long")
    total = cut_lineage(parts.groupBy("a", "b").agg(F.sum("n").alias("n")))
    return total.where("b is null").select(F.col("a").alias("word"), "n"), total.where("b is not null")


def _explained(n: int, expected: float, spread: float = SPREAD) -> bool:
    """Whether confusion alone may have made n occurrences of a form."""
    return n < KNOWN + spread * expected + 3 * math.sqrt(expected)


def _most_twice(top: int) -> float:
    """Occurrences from which two confusions in a word explain no form, `top` being the most frequent word's."""
    return KNOWN + TWICE * top + 3 * math.sqrt(TWICE * top)


def _is_listed(op: tuple[str, str]) -> bool:
    return op in _MULTI or op[1] in _SINGLE.get(op[0], "")


def _shares(n: int, near: list[tuple[int, tuple[str, str]]], rate: dict[tuple[str, str], float] | None) -> list[tuple[tuple[str, str], float]]:
    """n occurrences of a form shared among the confusions (count of the intended word, confusion)
    that explain it; without rates yet, by those counts, the listed confusions first."""
    if rate is None:
        near = [x for x in near if n <= max(KNOWN - 1, x[0] / 100)]
        near = [x for x in near if _is_listed(x[1])] or near
        weights = [float(c) for c, _ in near]
    else:
        weights = [c * rate.get(op, 0.0) for c, op in near]
        if not _explained(n, sum(weights)):
            return []
    total = sum(weights)
    return [(op, n * x / total) for (_, op), x in zip(near, weights) if x]


def _rates(seen: dict[tuple[str, str], float], shown: dict[str, float]) -> dict[tuple[str, str], float]:
    """Confusion probabilities from occurrences of misread forms and of what they were read from."""
    ops = [*[(a, b) for a, bs in _SINGLE.items() for b in bs], *_MULTI, *seen]
    return {op: (seen.get(op, 0.0) + (0.5 if _is_listed(op) else 0.02)) / max(shown.get(op[0], 0.0), 1000) for op in ops}


def _shown(words: dict[str, int]) -> Counter:
    """Occurrences of what may be misread, in the words that forms are held against."""
    out: Counter = Counter()
    for w, n in words.items():
        if len(w) < LEAST or not _open(w):
            continue
        for c in w:
            out[c] += n
        for right in {right for right, _ in _MULTI if len(right) > 1}:
            if k := w.count(right):
                out[right] += n * k
    return out


def _open(w: str) -> bool:
    return 2 <= len(w) <= 40 and w.isalpha()


def _opened(w: str) -> Iterator[tuple[str, str]]:
    """(the word with one character left open, that character)."""
    if len(w) <= 40:
        for i, c in enumerate(w):
            yield w[:i] + "\0" + w[i + 1 :], c


def _replaced(w: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """(word, confusion) by the confusions of several characters."""
    for right, wrong in _MULTI:
        at = w.find(wrong)
        while at >= 0:
            yield w[:at] + right + w[at + len(wrong) :], (right, wrong)
            at = w.find(wrong, at + 1)


class Channel:
    """Words, pairs and confusion probabilities."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], rate: dict[tuple[str, str], float], total: int | None = None, top: int | None = None) -> None:
        self.words, self.pairs = words, pairs
        self.total = total or sum(words.values()) + 1
        self.top = top or max(words.values(), default=0)  # the count of the most frequent word
        self.at: dict[str, list[str]] = {}  # a word with one character left open -> words
        for w, n in words.items():
            if n >= STRONG and _open(w):
                for key, _ in _opened(w):
                    self.at.setdefault(key, []).append(w)
        self.rate = rate or _rates({}, _shown(words))
        self.cache: dict[str, list[tuple[str, float]]] = {}

    def _edits(self, w: str) -> Iterator[tuple[str, tuple[str, str]]]:
        """(word, confusion) that one confusion may have turned into w."""
        for i, c in enumerate(w):
            for v in self.at.get(w[:i] + "\0" + w[i + 1 :], ()):
                if v != w:
                    yield v, (v[i], c)
        for v, op in _replaced(w):
            if self.words.get(v, 0) >= STRONG:
                yield v, op

    def _expected(self, low: str) -> float | None:
        """How often one confusion makes this form; None if none can."""
        near = [self.words[v] * self.rate.get(op, 0.0) for v, op in self._edits(low)]
        return sum(near) if near else None

    def _twice(self, low: str) -> dict[str, float]:
        """How often two confusions, or a blank read as a character, make this form of each word or two."""
        out = {v: self.words[v] * TWICE for mid in self._listed(low) for v, _ in self._edits(mid)}
        for i in range(2, len(low) - 2):
            a, b = self.words.get(low[:i], 0), self.words.get(low[i + 1 :], 0)
            if a >= 200 and b >= 200:
                out[low[:i] + " " + low[i + 1 :]] = min(a, b) * TWICE
        return out

    def known(self, low: str) -> bool:
        n = self.words.get(low, 0)
        if n < KNOWN:
            return False
        expected = self._expected(low)
        if expected is not None:
            return not _explained(n, expected)
        return len(low) < 6 or n >= _most_twice(self.top) or not _explained(n, max(self._twice(low).values(), default=0.0), 1)

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(lower-case word, log of its expected number of readings as `word`); the word itself is
        first, with the log of its own count or of a new word's chance."""
        if word in self.cache:
            return self.cache[word]
        low = word.lower()
        n, known = self.words.get(low, 0), self.known(low)
        if "-" in low[1:-1]:
            parts = low.split("-")
            if known or all(self.known(p) or not re.search(r"[^\W\d_]", p) for p in parts):
                self.cache[word] = [(low, math.log(n + 1.0))]
                return self.cache[word]
        name = word[:1].isupper()
        # a form's own occurrence is no evidence for it, nor are those that confusion is expected to make
        own = 0 if known else min(max(n - 1, 0), KNOWN + (self._expected(low) or 0.0))
        out = [(low, math.log(n) if known else math.log(own * 0.05 + (0.05 if name else 0.004)))]
        if len(low) >= 2:
            best: dict[str, float] = {}
            for v, op in self._edits(low):
                listed = _is_listed(op)
                odd = not word.isalpha() or not word[1:].islower()
                if not listed and (name and not odd or len(low) < 5 - odd):
                    continue
                p = self.rate.get(op, 1e-7 if name else 4e-6)
                if not known and not listed:
                    p = max(p, 4e-6)
                best[v] = max(best.get(v, -99.0), math.log(self.words[v] * p + 1e-12))
            if not best and not known and len(low) >= 6 and not name:
                best = {v: math.log(x) for v, x in self._twice(low).items()}
            out += [x for x in sorted(best.items(), key=lambda x: -x[1]) if x[1] >= out[0][1] - REACH]  # no path through the others can win
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[word] = out
        return out

    @staticmethod
    def _listed(w: str) -> Iterator[str]:
        for right, wrongs in _SINGLE.items():
            for wrong in wrongs:
                at = w.find(wrong)
                while at >= 0:
                    yield w[:at] + right + w[at + 1 :]
                    at = w.find(wrong, at + 1)

    def pair(self, a: str, b: str, read: bool = False) -> float:
        """Log of how much more likely b is after a than alone, with back-off. A pair as read is no
        evidence for itself."""
        n = max(self.pairs.get((a, b), 0) - read, 0)
        na, nb = self.words.get(a, 0), self.words.get(b, 0)
        if n == 0 or not na or not nb:
            return -0.7 if na > 200 and nb > 200 else 0.0
        return max(-0.7, min(4.0, math.log(n * self.total / (na * nb))))

    def decode(self, words: list[str]) -> list[str]:
        """Viterbi: the likeliest lower-case words behind those read."""
        lattice = [self.candidates(w) for w in words]
        score = [s for _, s in lattice[0]]
        back: list[list[int]] = []
        for prev, here in zip(lattice, lattice[1:]):
            step, froms = [], []
            for j, (v, s) in enumerate(here):
                options = [score[k] + self.pair(u, v, j == k == 0) for k, (u, _) in enumerate(prev)]
                k = max(range(len(options)), key=options.__getitem__)
                step.append(options[k] + s)
                froms.append(k)
            score = step
            back.append(froms)
        k = max(range(len(score)), key=score.__getitem__)
        path = [k]
        for froms in reversed(back):
            k = froms[k]
            path.append(k)
        path.reverse()
        return [lattice[i][k][0] for i, k in enumerate(path)]


# ---- pages -----------------------------------------------------------------------------------

_NUMBER = re.compile(r"^\s*(?P<dress>(?:page|seite|página|p\.|s\.|pág\.)?\s*[-–—\[(|·•~*]*)\s*(?P<n>[0-9]{1,4})\s*(?P<of>(?:/|of|von|de|sur|\|)\s*\d{1,4})?\s*[-–—\])|·•~*]*\s*$", re.I)
_CHAPTER = re.compile(r"^\s*(?:chapter|chapitre|kapitel|capítulo|part|teil|partie|parte|section|leçon|lesson|lektion|lección)\s+[\dIVXivxlO]+\.?\s*$", re.I)
#: a title as heads repeat it: at most five words, and as many again after a colon or dash, no sentence marks
_TITLE = re.compile(r"^\W*(?:\d{1,4}\W+)?(?:\w+ [\dIVXivx]+\. )?[^\s,;:!?]+(?: [^\s,;:!?]+){0,4}(?:(?: ?:| —| \||  +| ·| -) ?[^,;:!?]{1,80})?\W*(?:\d{1,4})?\W*$")
_NUMBERED = re.compile(r"^\s*\d+(?:\.\d+)*(?:[.)]|-\.?)\s+\S")
_BULLET = re.compile(r"^\s*[-*•–—+]\s+\S")


def _fold(line: str) -> str:
    """A head's text without page number and with look-alikes merged, for comparison."""
    t = re.sub(r"^\W*\d{1,4}\b\W*|\W*\b\d{1,4}\W*$", "", line.lower()).strip()
    t = t.replace("rn", "m").replace("cl", "d")
    return re.sub(r"\W+", " ", t.translate(str.maketrans("@015|!69éc", "aolslligee"))).strip()


def _alike(a: str, b: str) -> bool:
    if a == b:
        return bool(a)
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 6:
        return False
    same = sum(x == y for x, y in zip(a, b)) if len(a) == len(b) else sum(x == y for x, y in zip(a, b[: len(a)])) if a[:4] == b[:4] else 0
    if len(a) == len(b):
        return same >= len(a) - 2
    # one character more or less
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j >= max(len(a), len(b)) - 2


def _dress(line: str, m: re.Match) -> tuple[str, str]:
    return re.sub(r"\s|\d", "", line[: m.start("n")]).lower(), re.sub(r"[\s\d]", "", line[m.end("n") :])


def _dressed(dress: tuple[str, str]) -> bool:
    return dress not in (("", ""), ("(", ")"))


def _numbers_by_page(lines: list[str], pages: list[list[int]]) -> set[int]:
    """Page numbers where pages are marked: the dress and offset that most pages' edges share."""
    seen: dict[tuple, dict[int, tuple[bool, int]]] = {}
    for p, body in enumerate(pages):
        for i in body[:4] + body[-4:] if len(body) > 8 else body:
            if (m := _NUMBER.match(lines[i])) and "%" not in lines[i]:
                outer = i in body[:2] + body[-2:]
                at = seen.setdefault((_dress(lines[i], m), int(m["n"]) - p), {})
                at[p] = max(at.get(p, (False, -1)), (outer, i))
    if not seen:
        return set()
    worth = lambda key: 10 * len(seen[key]) + 3 * _dressed(key[0]) + sum(o for o, _ in seen[key].values()) / len(seen[key])
    key = max(seen, key=worth)
    if len(seen[key]) >= 2 or _dressed(key[0]) or len(pages) == 1 and any(o for o, _ in seen[key].values()):
        return {i for _, i in seen[key].values()}
    return set()


def _numbers_by_order(lines: list[str], body: list[int]) -> set[int]:
    """Page numbers where pages aren't marked: the longest run of numbers in one dress that goes up by one."""
    best: tuple[int, list[int]] = (0, [])
    chains: dict[tuple, dict[int, list[int]]] = {}
    for i in body:
        if (m := _NUMBER.match(lines[i])) and "%" not in lines[i]:
            dress, n = _dress(lines[i], m), int(m["n"])
            own = chains.setdefault(dress, {})
            before = max((own.get(n - k, []) for k in ((1, 2, 3) if _dressed(dress) else (1,))), key=len)  # a page may lack its number
            own[n] = max(before + [i], own.get(n, []), key=len)
            worth = 2 * len(own[n]) + 3 * _dressed(dress)
            if worth > best[0]:
                best = (worth, own[n])
    return set(best[1]) if best[0] >= 5 else set()


def _may_head(lines: list[str], i: int) -> bool:
    x = lines[i].strip()
    if len(x) > 130 or _NUMBER.match(x) or _NUMBERED.match(x) and not re.match(r"^\d+\s", x) or _CHAPTER.match(x) or _BULLET.match(x) or x.startswith(("--- [", "|", "$", "`", "#")):
        return False
    if re.search(r"[.!?;:,…)][»”\"’)]*$", x) or x[-1:] in _HYPHENS and not re.match(r"^[-–—].*[-–—]$", x) or not re.search(r"[^\W\d_]{3}", x):
        return False
    first = re.search(r"[^\W\d_]", x)
    return bool(re.match(r"\W*(?:\d+\W+)?[^\W\d_]", x) and first[0].isupper()) or bool(re.search(r"[@015|!69]", x[:2]))


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """(page numbers, running heads) as line numbers of one document."""
    pages: list[list[int]] = [[]]
    marked = False
    for i, x in enumerate(lines):
        if _PAGE.match(x):
            marked = True
            if pages[-1] or len(pages) > 1:
                pages.append([])
        elif x.strip():
            pages[-1].append(i)
    body = [i for b in pages for i in b]
    numbers = _numbers_by_page(lines, pages) if marked else _numbers_by_order(lines, body)
    # lines at the edges of pages: (page, line, folded text, stands apart)
    width = max((len(x) for x in lines), default=0)
    edges: list[tuple[int, int, str, bool]] = []
    near: list[tuple[int, int]] = []
    if marked:
        for p, b in enumerate(pages):
            rest = [i for i in b if i not in numbers]
            near += [(p, i) for i in dict.fromkeys(rest[:1] + rest[-1:])]
    else:
        rest = [i for i in body if i not in numbers]
        where = {i: k for k, i in enumerate(body)}
        p = 0
        for n in sorted(numbers):
            k = where[n]
            near += [(p, i) for i in dict.fromkeys(body[max(0, k - 1) : k] + body[k + 1 : k + 2]) if i not in numbers]
            p += 1
        near += [(p + k, i) for k, i in enumerate(rest) if _TITLE.match(lines[i]) and i not in {x for _, x in near}]
    for p, i in near:
        if not _may_head(lines, i):
            continue
        above = next((lines[j] for j in range(i - 1, -1, -1) if lines[j].strip()), "")
        if _CHAPTER.match(above):
            continue  # the chapter's own heading
        outside = lambda j: not 0 <= j < len(lines) or not lines[j].strip() or j in numbers or bool(_PAGE.match(lines[j]))
        numbered = bool(re.search(r"^\d{1,4}\W|\W\d{1,4}$", lines[i].strip()))
        apart = outside(i - 1) and outside(i + 1) or numbered and (outside(i - 1) or outside(i + 1))
        apart = apart or marked and len(lines[i].strip()) <= 0.6 * width  # a line of prose would be as wide as its neighbours
        edges.append((p, i, _fold(lines[i]), apart and (marked or i - 1 in numbers or i + 1 in numbers or numbered)))
    heads: set[int] = set()
    titles = [_fold(lines[j]) for i, x in enumerate(lines) if _CHAPTER.match(x) for j in range(i + 1, min(i + 4, len(lines))) if lines[j].strip()][:3]
    for p, i, f, apart in edges:
        again = sum(_alike(f, g) for q, _, g, _ in edges if q != p)
        named = any(_alike(f, t) or (len(t) > 8 and t in f) for t in titles)
        beside = i - 1 in numbers or i + 1 in numbers
        if all(map(_TITLE.match, lines[i].split(" — "))) and (again or named or apart or beside) or again >= 2:
            heads.add(i)
    # heads read so wrongly that they look like something else still resemble the others
    known = {_fold(lines[i]) for i in heads}
    for _, i in near:
        x = lines[i].strip()
        above = next((lines[j] for j in range(i - 1, -1, -1) if lines[j].strip()), "")
        if i not in heads and i not in numbers and not (_NUMBERED.match(x) or _BULLET.match(x) or _CHAPTER.match(above)) and any(_alike(_fold(x), f) for f in known if len(f) > 5):
            heads.add(i)
    return numbers, heads


def _body(lines: list[str], numbers: set[int], heads: set[int]) -> list[int]:
    return [i for i, x in enumerate(lines) if x.strip() and i not in numbers and i not in heads and not _PAGE.match(x) and not x.startswith(("--- [", "```"))]


def asked(text: str, edges: tuple[set[int], set[int]]) -> set[str]:
    """The words whose counts `read_document` may look up, beside their candidates."""
    lines = text.split("\n")
    body = [(lines[i], words_of(lines[i])) for i in _body(lines, *edges)]
    out = {w.lower() for _, words in body for _, w in words}
    for (x, words), (_, after) in zip(body, body[1:]):
        if x.rstrip()[-1:] in _HYPHENS and words and after:
            low_a, second = words[-1][1].rstrip(_HYPHENS).lower(), after[0][1].lower()
            low_b, stem = second.rstrip(_HYPHENS), low_a.split("-")[-1]
            out |= {stem + low_b, low_a + low_b, low_a + "-" + low_b, low_a + second, stem, low_b.split("-")[0]}
    return out | {p for w in out if "-" in w[1:-1] for p in w.split("-")}


def read_document(text: str, model: Channel, edges: tuple[set[int], set[int]] | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, str]]]:
    """((line, noise) of a document, (line, position, word read, word) corrections)."""
    lines = text.split("\n")
    numbers, heads = edges or furniture(lines)
    noise: list[tuple[int, str]] = [(i, "page_number") for i in sorted(numbers)] + [(i, "running_head") for i in sorted(heads)]
    body = _body(lines, numbers, heads)
    fixes: list[tuple[int, int, str, str]] = []
    fence = math_ = False
    carried: tuple[int, str] | None = None  # first part of a broken word
    for k, i in enumerate(body):
        x = lines[i]
        if x.strip().startswith("$$"):
            math_ = not math_ and x.strip().count("$$") == 1
            continue
        if fence or math_:
            continue
        words = words_of(x)
        skip_first = carried is not None
        broken = None
        tail = x.rstrip()
        if tail[-1:] in _HYPHENS and words and tail[-2:-1].isalnum() and k + 1 < len(body):
            after = words_of(lines[body[k + 1]])
            first = words[-1][1].rstrip(_HYPHENS)
            if after and lines[body[k + 1]].lstrip().startswith(after[0][1][:1]) and first:
                second = after[0][1]
                stem = first if not skip_first or len(words) > 1 else first
                if _is_break(stem, second, tail[-1], model):
                    noise.append((i, "hyphen_break"))
                    broken = (first, second)
        use = words[1:] if skip_first else words
        checked = use[:-1] if tail[-1:] in _HYPHENS and use else use
        bad = False
        if checked and any(len(model.candidates(w)) > 1 for _, w in checked):
            decoded = model.decode([w for _, w in checked])
            for (pos, w), v in zip(checked, decoded):
                if v != w.lower():
                    bad = True
                    fixes.append((i, pos, w, v))
        if bad:
            noise.append((i, "misread"))
        if skip_first and words and carried:
            prior, part = carried
            joined = part + words[0][1]
            v = model.candidates(joined)
            best = max(v, key=lambda c: c[1])[0]
            if best != joined.lower():
                # which line holds the wrong character
                cut = len(part)
                wrong_first = best[:cut] != part.lower()[: len(best[:cut])] and best[-len(words[0][1]) :] == words[0][1].lower()
                noise.append((prior if wrong_first else i, "misread"))
                fixes.append((i, words[0][0], joined, best))
        carried = (i, broken[0]) if broken else None
    return sorted(set(noise)), fixes


def _is_break(first: str, second: str, mark: str, model: Channel) -> bool:
    """Whether a word was broken here, rather than a compound at its own hyphen."""
    if mark in "­¬":
        return True
    low_a, low_b = first.lower(), second.lower().rstrip(_HYPHENS)
    stem = re.split(r"-", low_a)[-1]
    joined, kept = stem + low_b, low_a + "-" + low_b
    n_joined = max(model.words.get(joined, 0), model.words.get(low_a + low_b, 0))
    n_kept = model.words.get(kept, 0)
    if model.known(joined) or model.known(low_a + low_b) or n_kept >= 2:
        return n_joined >= n_kept
    if len(model.candidates(joined)) > 1 and max(model.candidates(joined)[1:], key=lambda c: c[1])[1] > -3:
        return True
    if second[:1].isupper() or second[:1].isdigit() or first[-1:].isdigit():
        return False
    # hyphenated inside, or two words of the language side by side
    a, b = model.words.get(stem, 0), model.words.get(re.split(r"-", low_b)[0], 0)
    return not (a >= 20 and b >= 20 and len(stem) > 2 and len(low_b) > 2)


def repair(text: str, model: Channel, edges: tuple[set[int], set[int]] | None = None) -> str:
    """Continuous paragraphs: furniture dropped, broken words joined, misread words corrected."""
    lines = text.split("\n")
    noise, fixes = read_document(text, model, edges)
    kinds: dict[int, set[str]] = {}
    for i, kind in noise:
        kinds.setdefault(i, set()).add(kind)
    for i, pos, w, v in sorted(fixes, reverse=True):
        if lines[i][pos : pos + len(w)] == w:
            lines[i] = lines[i][:pos] + (v.capitalize() if w[:1].isupper() else v) + lines[i][pos + len(w) :]
    paragraphs: list[str] = []
    now, last = "", -1
    for i, x in enumerate(lines):
        if kinds.get(i, set()) & {"page_number", "running_head"} or _PAGE.match(x):
            continue
        if not x.strip():
            if now and re.search(r"[.!?:…][»”\"’)]*$", now):
                paragraphs.append(now)
                now = ""
            continue
        if _NUMBERED.match(x) or _BULLET.match(x) or _CHAPTER.match(x):
            if now:
                paragraphs.append(now)
            paragraphs.append(x.strip())
            now = ""
            continue
        if now and now[-1:] in _HYPHENS:
            now = (now[:-1] if "hyphen_break" in kinds.get(last, ()) else now) + x.strip()
        else:
            now = f"{now} {x.strip()}".strip()
        last = i
    if now:
        paragraphs.append(now)
    return "\n\n".join(paragraphs)


# ---- over documents --------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "extracted_documents").where("document_id is not null and markdown is not null and markdown <> ''")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("document_id", F.col("markdown").alias("body"), F.col("metadata").getItem("source_id").isNotNull().alias("scanned")).repartition(n, "document_id").dropDuplicates(["document_id"])


_NEAR = "array<struct<v:string,n:bigint,a:string,b:string>>"


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, key, a, b) of a form: where a word that one confusion made into it would be found."""
    for pdf in batches:
        rows = []
        for w in pdf["word"]:
            rows += [(w, key, None, c) for key, c in _opened(w)]
            rows += [(w, v, a, b) for v, (a, b) in _replaced(w)]
        yield pd.DataFrame(rows, columns=["word", "key", "a", "b"])


def _far_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, key) of a form that one confusion doesn't explain: two confusions, or a blank misread."""
    for pdf in batches:
        rows: list[tuple[str, str]] = []
        for w in pdf["word"]:
            keys = {k for mid in Channel._listed(w) for k in [*(key for key, _ in _opened(mid)), *(v for v, _ in _replaced(mid))]}
            rows += [(w, k) for i in range(2, len(w) - 2) for k in (w[:i], w[i + 1 :])] + [(w, k) for k in keys]
        yield pd.DataFrame(rows, columns=["word", "key"])


def _strong_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for w, n in zip(pdf["word"], pdf["n"]):
            rows.append((w, w, n, None))
            rows += [(key, w, n, c) for key, c in _opened(w) if _open(w)]
        yield pd.DataFrame(rows, columns=["key", "v", "m", "c"])


def _near(words: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, n, near): each form's count and the frequent words it may have been misread from.

    `words` has counts, `forms` more words that are looked up, with or without a count.
    """
    strong = cut_lineage(words.where(F.col("n") >= STRONG).mapInPandas(_strong_keys, "key string, v string, m long, c string"))
    every = cut_lineage(words.unionByName(forms.select("word", F.lit(0).cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("n")))
    met = every.select("word").mapInPandas(_keys, "word string, key string, a string, b string").join(strong, "key").where("v <> word and (a is null) = (c is not null)")
    one = met.groupBy("word").agg(F.collect_list(F.struct("v", F.col("m").alias("n"), F.coalesce("a", "c").alias("a"), "b")).alias("near"))
    once = cut_lineage(every.join(one, "word", "left"))
    top = words.agg(F.max("n")).first()[0] or 0
    lone = once.where(F.col("near").isNull() & (F.col("n") < _most_twice(top)) & (F.length("word") >= 6)).select("word")
    far = lone.mapInPandas(_far_keys, "word string, key string").join(strong, "key").groupBy("word").agg(F.collect_set(F.struct("v", F.col("m").alias("n"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))).alias("far"))
    return cut_lineage(once.join(far, "word", "left").select("word", "n", F.coalesce("near", "far", F.array().cast(_NEAR)).alias("near")))


def _estimate(near: DataFrame) -> dict[tuple[str, str], float]:
    """Confusion rates from the occurrences of all forms that one confusion explains."""

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Counter = Counter()
        for pdf in batches:
            out.update(_shown(dict(zip(pdf["word"], pdf["n"]))))
        yield pd.DataFrame(list(out.items()), columns=["a", "n"])

    strong = near.where(F.col("n") >= STRONG).select("word", "n")
    base = {r["a"]: r["n"] for r in strong.mapInPandas(shown, "a string, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()}  # characters
    forms = near.where(f"n > 0 and length(word) >= {LEAST} and exists(near, x -> x.a is not null)").select("n", "near")
    rate: dict[tuple[str, str], float] | None = None
    for _ in range(ROUNDS):

        def run(batches: Iterator[pd.DataFrame], rate=rate) -> Iterator[pd.DataFrame]:
            out: Counter = Counter()
            for pdf in batches:
                for n, near in zip(pdf["n"], pdf["near"]):
                    for op, x in _shares(n, [(v["n"], (v["a"], v["b"])) for v in near], rate):
                        out[op] += x
            yield pd.DataFrame([(a, b, x) for (a, b), x in out.items()], columns=["a", "b", "x"])

        seen = forms.mapInPandas(run, "a string, b string, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).collect()  # pairs of characters
        rate = _rates({(r["a"], r["b"]): r["x"] for r in seen}, base)
    return rate


class _Recorder(Channel):
    """Notes the pairs that decoding looks up."""

    met: set[tuple[str, str]]

    def decode(self, words: list[str]) -> list[str]:
        lattice = [self.candidates(w) for w in words]
        for prev, here in zip(lattice, lattice[1:]):
            if len(prev) > 1 or len(here) > 1:
                self.met.update((u, v) for u, _ in prev for v, _ in here)
        return [w.lower() for w in words]


def _pages(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, document_id, body, numbers, heads) of scanned documents, and (bucket, word) of the words whose
    counts they look up; both from one reading."""
    n = max(2 * int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scanned.count() // BUCKET_DOCS))
    columns = ["bucket", "document_id", "body", "numbers", "heads", "word"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            words: set[tuple[int, str]] = set()
            for bucket, doc, text in zip(pdf["bucket"], pdf["document_id"], pdf["body"]):
                edges = furniture(text.split("\n"))
                rows.append((bucket, doc, text, sorted(edges[0]), sorted(edges[1]), None))
                words |= {(bucket, w) for w in asked(text, edges)}
            rows += [(bucket, None, None, None, None, w) for bucket, w in words]
            yield pd.DataFrame(rows, columns=columns).astype({"document_id": "Int64"})

    keyed = scanned.select(F.pmod(F.xxhash64("document_id"), F.lit(n)).cast("int").alias("bucket"), "document_id", "body")
    read = cut_lineage(keyed.mapInPandas(run, "bucket int, document_id long, body string, numbers array<int>, heads array<int>, word string"))
    return read.where("word is null").drop("word"), read.where("word is not null").select(F.col("bucket").alias("bucket"), F.col("word").alias("word")).distinct()


def _edges(pdf: pd.DataFrame) -> Iterator[tuple[int, str, tuple[set[int], set[int]]]]:
    for doc, text, numbers, heads in zip(pdf["document_id"], pdf["body"], pdf["numbers"], pdf["heads"]):
        yield doc, text, (set(numbers), set(heads))


def _read(docs: DataFrame, each, schema: str) -> DataFrame:
    """`each` (document_id, text, channel, edges) -> rows, over scanned documents by buckets; a
    bucket's channel holds what its own lines look up, with counts over all documents."""
    words, pairs = _counts(docs)
    pages, needed = _pages(docs.where("scanned"))
    needed = cut_lineage(needed)
    near = _near(words, needed.select("word").distinct())
    rate = _estimate(near)
    total, top = words.agg(F.coalesce(F.sum("n"), F.lit(0)) + 1, F.max("n")).first()
    own = cut_lineage(needed.join(near, "word").select("bucket", "word", "n", F.transform("near", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"))).alias("near")))

    def counts(rows: pd.DataFrame) -> dict[str, int]:
        out = {v["v"]: v["n"] for near in rows["near"] if near is not None for v in near}
        return out | {w: n for w, n in zip(rows["word"], rows["n"]) if n}

    def record(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        m = _Recorder(counts(rows), {}, rate, total, top)
        m.met = set()
        for _, text, edges in _edges(pdf):
            read_document(text, m, edges)
        bucket = pdf["bucket"].iloc[0] if len(pdf) else 0
        return pd.DataFrame([(bucket, a, b) for a, b in m.met], columns=["bucket", "a", "b"])

    met = pages.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInPandas(record, "bucket int, a string, b string")
    beside = met.join(pairs, ["a", "b"]).select("bucket", F.col("a").alias("word"), "b", "n", F.lit(None).cast("array<struct<v:string,n:bigint>>").alias("near"))
    model = own.select("bucket", "word", F.lit(None).cast("string").alias("b"), "n", "near").unionByName(beside)

    def decode(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        two = rows["b"].notna()
        pair = rows[two]
        m = Channel(counts(rows[~two]), dict(zip(zip(pair["word"], pair["b"]), pair["n"])), rate, total, top)
        out = [x for doc, text, edges in _edges(pdf) for x in each(doc, text, m, edges)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return pages.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInPandas(decode, schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy lines of scanned documents."""
    each = lambda doc, text, m, edges: [(doc, i, kind) for i, kind in read_document(text, m, edges)[0]]
    return _read(_docs(spark, sf_dir), each, "document_id long, line_no long, noise string")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned documents as continuous paragraphs."""
    return _read(_docs(spark, sf_dir), lambda doc, text, m, edges: [(doc, repair(text, m, edges))], "document_id long, body string")


QUERIES = {"p5_found": found, "p5_repaired": repaired}
ORACLES: dict[str, str] = {}
