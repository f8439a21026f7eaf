"""Problem 1: question and reply pairs whose reply is unusable, each with its one defect.

A reply is stripped of its dress (labels, source labels, markup, invisible characters) and then
tested in a fixed order: nothing left is `empty`; greedy string tiling that covers it with the
question is `copied_question`; a refusal grammar that accounts for all its sentences is `refusal`;
script and function-word checks on its prose give `other_language`; a pushdown parser over fences,
formulas, brackets, quotations and lists, with a model of how units end, gives `truncated`.

Python reads each reply once. Where that leaves a question open, counts over all replies answer it,
by joins: how often a pair of words closes a unit that carries its own end mark, for replies that
stop without one; and the words of replies in a clear language, for texts whose own function words
don't tell theirs. Nothing is sampled, and nothing but counts and open rows is shuffled.

A null or blank reply is `empty`, whatever the question; with a null question only `empty`,
`refusal` and `truncated` can apply; a repeated key counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, spread, table

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️]")
# fixed values: labels that open a reply, placeholders, and source labels
_LABEL = re.compile(
    r"^\W*(?:answer|response|reply|réponse|respuesta|antwort|question|pregunta|frage|q|a|r|f|p|assistant|tutor"
    r"|you ask|you asked|vous demandez|usted pregunta|sie fragen|la question est|the question is)\b\W*?[:：]\W*",
    re.I,
)
_PLACEHOLDER = re.compile(r"(?:null|none|nil|n/?a|nan|todo|tbd|vide|empty|leer|vacío|undefined|placeholder|\(?no answer\)?)", re.I)
_SOURCE = re.compile(r"(?:\b(?:sources?|quellen?|fuentes?)\s*:\s*)?\[(?:(?:doc|source)\s*\d+|(?:web|pdf)\b[^\]\n]*)\]", re.I)
_TAG = re.compile(r"</?\w+[^<>\n]*>")

_FENCE = re.compile(r"^(`{3,}|~{3,})[^\n]*\n.*?(?:^\1[^\S\n]*$|\Z)", re.M | re.S)
_FORMULA = re.compile(r"\$\$.*?(?:\$\$|\Z)|\\\[.*?(?:\\\]|\Z)|\$[^$\n]+\$|\\\(.*?\\\)", re.S)
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"\n]*\"|`[^`\n]*`|‘[^’]*’")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")


@lru_cache(maxsize=16)
def undress(text: str | None) -> str:
    """The text without invisible characters, source labels, tags, fence marks and opening labels."""
    t = _INVISIBLE.sub("", text or "")
    t = _SOURCE.sub(" ", t)
    t = _TAG.sub(" ", t)
    t = re.sub(r"^(?:`{3,}|~{3,})\w*\s*$", "", t, flags=re.M).strip()
    while m := _LABEL.match(t):
        t = t[m.end() :]
    return t.strip()


def is_empty(text: str | None) -> bool:
    t = undress(text)
    bare = re.sub(r"[\W_]+", " ", t).strip()
    return not bare or bool(_PLACEHOLDER.fullmatch(re.sub(r"^[\W_]+|[\W_]+$", "", t))) or bool(_LABEL.fullmatch(t + ":"))


# ---- copied questions ------------------------------------------------------------------------


_ACCENTS = re.compile("[\u0300-\u036f]+")


def _folded(text: str) -> list[str]:
    t = text.lower()
    return re.findall(r"[^\W_]+", t if t.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFKD", t)))


def tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest common runs first, each token used once; (at in a, at in b, length)."""
    used_a, used_b = [False] * len(a), [False] * len(b)
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    out = []
    while True:
        best = (least - 1, 0, 0)
        for i, w in enumerate(a):
            if used_a[i]:
                continue
            for j in where.get(w, ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        used_a[i : i + n] = [True] * n
        used_b[j : j + n] = [True] * n


def is_copy(question: str | None, reply: str) -> bool:
    """The reply holds the question, whole or nearly, once or several times, and hardly anything else."""
    q, r = _folded(undress(question)), _folded(undress(reply))
    if not q or not r:
        return False
    if q == r:
        return True
    own = set(q)
    if len(r) >= 1.8 * len(q) and sum(w in own for w in r) >= 0.85 * len(r):  # the question said again and again
        if sum(n for _, _, n in tiles(r, q * -(-len(r) // len(q))) if n >= 0.8 * len(q)) >= 0.85 * len(r):
            return True
    if len(r) > len(q) * 1.5 + 3:
        return False
    covered = sum(n for _, _, n in tiles(r, q))
    rest = len(r) - covered
    return covered >= 0.6 * len(q) and rest <= max(1, 0.25 * len(r)) and covered >= 0.7 * len(r)


# ---- refusals --------------------------------------------------------------------------------

# fixed values: the grammar's terminals. An opening may precede a refusing clause; a companion
# sentence (advice, apology, remark on one's role) adds no content.
_OPENING = (
    r"(?:(?:i['’]m|i am|we are) (?:very |so |really )?(?:sorry|afraid)[,;]? ?(?:but|that)?|sorry[,;:]?(?: but)?|unfortunately[,;]?|regrettably[,;]?|thank(?:s| you)[^;,.]*[;,] ?(?:however|but)[,;]?|as an? [^,.]*(?:assistant|model|tutor)[^,.]*[,;]"
    r"|désolée?[,;]?(?: mais)?|je (?:suis|regrette)[^,.]*désolée?[,;]?(?: mais)?|malheureusement[,;]?|merci [^;,.]*[;,] ?(?:toutefois|mais|cependant)[,;]?|en tant qu[^,.]*[,;](?: je dois l['’]avouer ?:)?"
    r"|lo siento[,;]?(?: pero)?|por desgracia[,;]?|lamentablemente[,;]?|desafortunadamente[,;]?|gracias [^;,.]*[;,] ?(?:sin embargo|pero)[,;]?|como asistente[^,.]*[,;]"
    r"|leider|bedauerlicherweise|es tut mir leid[,;]?(?: aber)?|danke [^;,.]*[;,] ?(?:jedoch|aber|allerdings)[,;]?|als [^,.]*assistent[^,.]*)"
)
_CLAUSE = (
    r"(?:"
    r"(?:i|we) (?:cannot|can['’]t|can not|could not|am unable|am not able|are unable|must decline|have to (?:pass|decline)|would rather not|prefer not|won['’]t|don['’]t (?:know|have)|do not (?:know|have)|have no (?:passage|information|source|basis|idea|document))"
    r"|no reliable (?:statement|answer)|it would be (?:wrong|dishonest)[^.]*guess|there is (?:no|nothing)\b[^.]*(?:basis|document|excerpt|passage|source|reply|answer)|nothing in (?:the|my) [^.]*(?:covers|answers|mentions|supports)"
    r"|(?:the|these|my) (?:[\w ]{0,30})?(?:course|excerpts?|passages?|sources?|documents?|notes|corpus|lessons|material)\b[^.]*(?:never|silent|nothing|no mention|leave this open|do(?:es)? not|don['’]t)"
    r"|that is beyond what|this (?:topic|subject|question) (?:lies|is|falls) (?:outside|beyond|out)|you will have to look elsewhere|outside the (?:scope|lessons)"
    r"|(?:je|nous) (?:ne (?:saurais|peux|puis|pouvons|sais|dispose|trouve)|préfère ne|me vois contraint|dois (?:m['’]abstenir|décliner|passer)|suis (?:incapable|dans l['’]impossibilité|au regret))"
    r"|il (?:m['’]est|nous est) impossible|il serait malhonnête|il faudra chercher ailleurs|on ne peut rien|aucun (?:passage|extrait|document)[^.]*(?:permet|répond|conclure)|aucune (?:réponse|information|source)[^.]*(?:trouve|fiable|permet|disponible)"
    r"|rien dans (?:les|mes) [^.]*(?:réponse|fonde|répond|permet)|ce (?:sujet|thème|point) (?:sort|est hors|n['’]est pas)|(?:le|les|mes|ces) (?:cours|corpus|extraits?|sources?|documents?)\b[^.]*(?:jamais|muet|muets|rien|se taisent|laissent la question ouverte|ne permettent pas|ne (?:contien|dis|mentionn|abord|trait)\w*)"
    r"|(?:no (?:puedo|sé|cabe|es posible|dispongo|tengo)|debo (?:abstenerme|declinar|pasar)|prefiero no|me es imposible|me veo obligad[oa])|ningún (?:pasaje|extracto|documento)[^.]*(?:permite|contesta|responde)|nada en (?:los|mis) [^.]*"
    r"|(?:el|los|mis|la|las) (?:curso|corpus|extractos?|fuentes?|documentos?|lecciones)\b[^.]*(?:nunca|nada|callan|no (?:dic|contien|mencion|permit)\w*)|este (?:tema|asunto) (?:queda|está) fuera|sería (?:deshonesto|incorrecto)|habrá que buscar"
    r"|(?:ich )?(?:kann|muss|möchte|darf) (?:ich )?(?:das|dazu|hierzu|hier|mich|diese frage|darauf|leider)?[^.]*(?:nicht (?:beantworten|sagen|äußern|helfen)|passen|ablehnen|enthalten)|(?:ich )?weiß (?:ich )?(?:es |das )?nicht"
    r"|lässt sich (?:hierzu|dazu)? ?nichts|(?:hierzu|dazu) (?:lässt sich|steht|sagen|schweigen|gibt es)[^.]*(?:nichts|quellen|keine?)?|(?:steht|sagen|gibt es)[^.]*dazu[^.]*nichts|sagen die auszüge|schweigen [^.]*quellen|kommt (?:das|dies)?[^.]*nie vor|liegt dieses thema|(?:dieses|das) thema liegt|(?:meine|die) (?:quellen|auszüge|unterlagen)[^.]*(?:schweigen|nichts|nicht)|es wäre (?:unredlich|falsch)"
    r")"
)
_REFUSES = re.compile(rf"\W*(?:{_OPENING}\s*)*{_CLAUSE}", re.I)
_TURNS = re.compile(r"(?:,| and| et| y| und)? ?\b(?:but|mais|pero|aber|sondern|and give)\b|:\s*\w|\bnot on\b|\busual\b", re.I)  # content follows
_FOREIGN_REFUSAL = re.compile(
    r"(?:к сожалению|извините|не могу|mi dispiace|non posso|purtroppo|infelizmente|desculpe|não posso|抱歉|无法|不能回答|对不起|申し訳|お答えできません|できません|عذر|لا أستطيع|आसफ|क्षमा करें|ขออภัย|ไม่สามารถ)", re.I
)
_COMPANION = re.compile(
    r"\b(?:teacher|enseignante?|professeur|docente|profesora?|lehrkraft|lehrer(?:in)?|librarian|bibliothécaire|bibliotecari[oa]|bibliothekar(?:in)?|encyclop\w+|enzyklopädie|enciclopedia|reference work|ouvrage spécialisé|nachschlagewerk"
    r"|rephras\w+|reformul\w+|formulieren sie|umformulier\w+|(?:ask|asking) (?:about|me|again)|poser une (?:autre )?question|toute question|stellen sie|preguntar? (?:sobre|por)|reply you were hoping|réponse espérée|respuesta que esperaba|erhoffte antwort|nicht die antwort"
    r"|(?:every|each) excerpt|chaque extrait|cada extracto|jeden auszug|guessing|deviner|adivinar|raten würde|my role|mon rôle|mi (?:papel|función)|meine (?:rolle|aufgabe)|teaching team|équipe enseignante|equipo docente"
    r"|(?:later|next|future) edition|prochaine édition|próxima edición|(?:nächste|spätere)\w* (?:auflage|ausgabe)|any (?:other )?chapter|another chapter|autre chapitre|cualquier capítulo|otro capítulo|(?:jedem|anderen?) kapitel|helfe ich gern|con gusto ayudo|happy to help|gladly"
    r"|rather than with such matters|plutôt que de telles questions|en lugar de (?:tales|esas)|statt (?:mit|von) solchen|les leçons traitent|the lessons deal|las lecciones tratan|die lektionen behandeln)",
    re.I,
)
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*[”»\"’)]*")


def is_refusal(reply: str) -> bool:
    """At least one refusing sentence, and no sentence with content; a last cut sentence is open."""
    t = undress(reply)
    if "```" in t or "$$" in t:
        return False
    sentences = [s.strip() for s in _SENTENCE.findall(t) if _WORD.search(s)]
    refuses = 0
    for i, s in enumerate(sentences):
        if ((m := _REFUSES.match(s)) and not _TURNS.search(s, m.end())) or (_FOREIGN_REFUSAL.search(s) and len(s) < 200):
            refuses += 1
        elif _COMPANION.search(s):
            continue
        elif i == len(sentences) - 1 and i and not re.search(r"[.!?。！？][”»\"’)]*$", s):
            continue
        else:
            return False
    return refuses > 0


# ---- language --------------------------------------------------------------------------------

# fixed values: frequent function words of each language
_FUNCTION = {
    "en": "the of and in is to that which it for with as are on at by from when what how does why who an this these but or not only while both than once who did do no be can will would must have has i you my your me we our here there any nothing please may if so about one cannot could does its their they it’s".split(),
    "fr": "le la les de des du et en est un une que qui dans pour sur au aux avec par ce cette il elle sans mais ou plus pourquoi comment quelle quel lorsque à d l n y dont leur sont pas ne quand oui deux après sous quoi où".split(),
    "es": "el la los las de del y en es un una que con por para su al como se más pero o cuando qué cómo por sin lo este esta ante aunque ocurre solo sí ambos antes tras bajo mientras cuál porque quién".split(),
    "de": "der die das den dem des und in ist ein eine einen zu mit von auf für nicht im bei wenn was wie warum wird aber oder nach ohne sich als es am beiden nur ja während wozu zum zur wer weil denn obwohl unter worin".split(),
    "it": "il lo gli di che e un una per con non sono del della nel quando perché come ma anche è dei delle".split(),
    "pt": "o os as do da dos das em um uma que com não para por mas quando como são é no na pelo pela ao".split(),
}
_WEIGHT: dict[str, dict[str, float]] = {}
for _lang, _words in _FUNCTION.items():
    for _w in set(_words):
        _WEIGHT.setdefault(_w, {})[_lang] = 1.0
for _w, _of in _WEIGHT.items():
    for _lang in _of:
        _of[_lang] = 1.0 / len(_of)
_LETTERS = {"ß": "de", "ä": "de", "ö": "de", "ñ": "es", "¿": "es", "¡": "es", "œ": "fr", "ê": "fr", "è": "fr", "ç": "fr", "ã": "pt", "õ": "pt", "ù": "fr", "â": "fr", "î": "fr", "û": "fr"}
_SCRIPTS = [
    ("ja", re.compile("[぀-ヿ]")),
    ("zh", re.compile("[一-鿿]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("hi", re.compile("[ऀ-ॿ]")),
    ("th", re.compile("[฀-๿]")),
    ("el", re.compile("[Ͱ-Ͽ]")),
    ("ko", re.compile("[가-힯]")),
]
_OTHER_SCRIPT = re.compile("[\u0370-\u1fff\u3040-\uffff]")
_MARKED = re.compile("[" + "".join(_LETTERS) + "]")


def prose(text: str) -> str:
    """Without code, formulas, quoted terms and source labels, none of which tell the language."""
    t = _FENCE.sub("\n", text)
    t = _FORMULA.sub(" ", t)
    t = _SOURCE.sub(" ", t)
    bare = _QUOTED.sub(" ", t)
    return bare if _WORD.search(bare) else t


def language(text: str) -> tuple[str | None, float]:
    """(language, margin over the second) by script, then function words and letters."""
    t = prose(text).lower()
    words = re.findall(r"[^\W\d_]+", t)
    if not words:
        return None, 0.0
    if _OTHER_SCRIPT.search(t):
        letters = sum(map(len, words))
        for lang, script in _SCRIPTS:
            n = len(script.findall(t))
            if n > 0.4 * letters or (n > 0.15 * letters and lang in ("ja", "zh", "th")):
                return lang, float(n)
    score: Counter = Counter()
    for w, times in Counter(words).items():
        for lang, x in _WEIGHT.get(w, {}).items():
            score[lang] += x * times
    if not t.isascii():
        for c, times in Counter(_MARKED.findall(t)).items():
            score[_LETTERS[c]] += 0.5 * times
    if not score:
        return None, 0.0
    (first, a), *rest = score.most_common(2)
    return first, a - (rest[0][1] if rest else 0.0)


@lru_cache(maxsize=16)
def spoken_in(text: str | None) -> tuple[str | None, float, list[str] | None, str]:
    """(language, margin, words, text it was told from): by script or function words where these are clear;
    else with the words that the counts are asked about, the language standing if they don't tell."""
    t = undress(_FENCE.sub("\n", text or ""))
    lang, margin = language(t)
    if margin < 2 and (lang is None or lang in _FUNCTION):
        return (lang if margin >= 0.5 else None), margin, re.findall(r"[^\W\d_]{2,}", prose(t).lower()), t
    return lang, margin, None, t


# ---- truncation ------------------------------------------------------------------------------

_OPENERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "（": "）", "「": "」", "『": "』"}
_PDA_TOKEN = re.compile(r"^(?:`{3,}|~{3,})[^\n]*$|\$\$|\\\[|\\\]|\\\(|\\\)|\*\*|`|[()\[\]{}«»“”„（）「」『』\"$]", re.M)


def pushdown(text: str) -> list[str]:
    """The stack left at the end of the text: what was opened and never closed."""
    stack: list[str] = []
    for m in _PDA_TOKEN.finditer(text):
        t, top = m.group(), stack[-1] if stack else ""
        if t[:3] in ("```", "~~~"):
            if top[:3] in ("```", "~~~"):
                if t.rstrip() == t[0] * len(t.rstrip()) and t[0] == top[0]:
                    stack.pop()
            elif top != "$$":
                stack.append(t[:3])
        elif top[:3] in ("```", "~~~"):
            continue
        elif t in ("$$", "`", '"', "**", "$"):
            if top == t:
                stack.pop()
            elif top in ("$$", "`", "$"):
                continue
            elif t == "$" and re.match(r"\s?\d", text[m.end() : m.end() + 2]):
                continue  # money
            else:
                stack.append(t)
        elif top in ("$$", "`", "$"):
            continue
        elif t in ("\\[", "\\("):
            stack.append(t)
        elif t in ("\\]", "\\)"):
            if top == {"\\]": "\\[", "\\)": "\\("}[t]:
                stack.pop()
        elif top == "„" and t in "“”":
            stack.pop()
        elif t in _OPENERS:
            stack.append(t)
        else:
            opener = next((o for o, c in _OPENERS.items() if c == t), None)
            if opener in stack:  # what was left open inside ends with it
                while stack.pop() != opener:
                    pass
    return stack


# fixed values: abbreviations whose full stop doesn't end a sentence
_ABBREVIATION = re.compile(
    r"(?:^|[\s(«“„])(?:e\.g|i\.e|cf|fig|eq|sec|no|vol|ed|vs|al|dr|mr|mrs|ms|prof|p|pp|ph|ph\.d|u\.s|u|approx|c\.-à-d|c|éd|t|env|chap|art|m|mme|n|abb|bd|bzw|ca|d\.\s?h|d|gl|hrsg|kap|nr|s|u\.\s?a|vgl|z\.\s?b|z|aprox|cap|ec|ej|p\.\s?ej|pág|sr|sra|sres|n\.º|a|[A-ZÀ-Þ])\.$",
    re.I,
)
_ENDS = re.compile(r"[.!?。！？…][\"”»“’)\]）」』*]*$")
_ITEM = re.compile(r"^\s*(?:[-*•–—+]|\d+[.)])\s+(\S.*)$")


def _tokens(text: str) -> list[str]:
    return [re.sub(r"\d+", "0", w) for w in re.findall(r"[^\W_]+|[,:;]", text.lower())]


def cut(reply: str) -> bool | tuple[str, str]:
    """Whether a reply stops early; where only counts can tell, (kind, its last unit): `s` for a sentence,
    `i` for a list item."""
    t = _INVISIBLE.sub("", reply)
    t = _SOURCE.sub("", t).rstrip()
    cut_label = re.search(r"\[(?:doc|web|pdf)?[^\]\n]*$", t, re.I)
    if cut_label and re.match(r"\[(?:d|do|doc[\s\d]*|w|we|web\b.*|p|pd|pdf\b.*)?$", cut_label.group(), re.I):
        t = t[: cut_label.start()].rstrip()
    t = re.sub(r"\b(?:sources?|quellen?|fuentes?)\s*:?$", "", t, flags=re.I).rstrip()
    t = _TAG.sub("", t).rstrip()
    if not t:
        return False
    if pushdown(t):
        return True
    last = t.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"`{3,}|~{3,}", last) or last.endswith("$$") or last.endswith("\\]"):
        return False
    if m := _ITEM.match(last):
        item = m[1].strip()
        if len(item) > 60 and _ENDS.search(item):
            return bool(_ABBREVIATION.search(item))
        return "i", item.rstrip(" .;")
    if re.fullmatch(r"(?:[-*•–—+]|\d+[.)])", last):
        return True
    if re.search(r"[:：,;]$", last):
        return True
    if _ENDS.search(last) and not re.search(r"(?:…|\.\.\.)[\"”»’)]*$", last):
        return bool(_ABBREVIATION.search(last.rstrip("\"”»’)*")))
    pieces = re.split(r"(?<=[.!?])[”»\"’)]*\s+(?=[\"“„«(¿¡]?[A-ZÀ-Þ0-9])", last)
    tail = re.sub(r"(?:…|\.\.\.)$", "", pieces[-1]).strip()
    if re.fullmatch(r"[\"“„«(\s]*#{0,6}\s*\S+", tail) and len(pieces) > 1:
        return True  # one lone word after a whole sentence
    return "s", re.sub(r"[\"”»’)\s]+$", "", tail)


# ---- over pairs ------------------------------------------------------------------------------

_READ = (
    "record_table string, record_id long, defect string, q_lang string, r_lang string, q_words array<string>, r_words array<string>, is_cut boolean, kind string, before string, last string, "
    "lang string, word string, n long"
)
_READ_COLUMNS = [c.split()[0] for c in _READ.split(", ")]
_ID = ["record_table", "record_id"]


def read_pair(question: str | None, reply: str | None, refusal_wanted: bool) -> tuple:
    """(defect, q_lang, r_lang, q_words, r_words, is_cut, kind, before, last) of a pair, in this order:
    a settled defect alone; else what is known and what the counts are asked about; all null if sound."""
    sound = (None,) * 9
    if is_empty(reply):
        return "empty", *sound[1:]
    if is_copy(question, reply):
        return "copied_question", *sound[1:]
    if not refusal_wanted and is_refusal(reply):
        return "refusal", *sound[1:]
    (q, _, q_words, _), (r, _, r_words, _) = spoken_in(question), spoken_in(reply)
    sure = q_words is None and r_words is None
    if sure and q and r and q != r:
        return "other_language", *sound[1:]
    stop = cut(reply)
    kind = before = last = None
    if isinstance(stop, tuple):
        w = ["^", *_tokens(stop[1])]
        kind, before, last = (stop[0], w[-2], w[-1]) if len(w) > 1 else (None, None, None)
        stop = None if kind else False
    if sure and stop is not None:
        return ("truncated" if stop else None), *sound[1:]
    return None, q, r, q_words, r_words, stop, kind, before, last


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settled and open pairs; and, without a key, words of replies in a clear language."""
    spoken: dict[str, Counter] = {}
    for pdf in batches:
        rows = []
        for name, key, q, a, wanted in zip(pdf["record_table"], pdf["record_id"], pdf["question"], pdf["reply"], pdf["refusal_wanted"]):
            got = read_pair(q, a, wanted)
            if got[0] or got[5] is not None or got[6] or got[3] is not None or got[4] is not None:
                rows.append((name, key, *got, None, None, None))
            if a and not got[0]:
                lang, margin, _, t = spoken_in(a)
                if margin >= 3 and lang in _FUNCTION:
                    spoken.setdefault(lang, Counter()).update(re.findall(r"[^\W\d_]{2,}", prose(t).lower()))
        if sum(map(len, spoken.values())) > 100_000:
            rows += [(None,) * 11 + (lang, w, n) for lang, c in spoken.items() for w, n in c.items()]
            spoken = {}
        yield pd.DataFrame(rows, columns=_READ_COLUMNS)
    yield pd.DataFrame([(None,) * 11 + (lang, w, n) for lang, c in spoken.items() for w, n in c.items()], columns=_READ_COLUMNS)


def ending_counts(replies: DataFrame) -> DataFrame:
    """(kind, before, last, total, ends): how often a word follows another in units of all replies, and how
    often the unit ends with it. Units are sentences that carry their end mark (`s`) and list items that
    another item follows (`i`, which may also go on after a colon)."""
    java = lambda p, flags: f"(?{flags}u)" + p.pattern.replace(r"\Z", r"\z").replace(r"[\w]", r"[\p{L}\p{N}_]")
    item = java(_ITEM, "d")
    text = F.col("reply")
    for pattern, flags, put in ((_SOURCE, "i", " "), (_FENCE, "msd", "\n\n"), (_FORMULA, "s", "\n\n")):
        text = F.regexp_replace(text, java(pattern, flags), put)
    lines = replies.where("reply is not null").select(F.split(text, "\n").alias("l"))
    items = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(item) & F.coalesce(F.get("l", i + 1).rlike(item), F.lit(False)), F.trim(F.regexp_extract(x, item, 1)))), lambda x: x.isNotNull())
    sentence = r"[^.!?]+(?:\.(?=[\p{L}\p{N}_])[^.!?]+)*[.!?]+[”»\"’)]*(?=\s|$)"
    sentences = F.flatten(F.transform(F.filter("l", lambda x: ~x.rlike(item)), lambda x: F.regexp_extract_all(x, F.lit(sentence), F.lit(0))))
    bare = lambda s: F.regexp_replace(s, r"[”»\"’)]+$", "")
    whole = F.filter(sentences, lambda s: ~bare(s).rlike(java(_ABBREVIATION, "id")) & ~bare(s).endswith(".."))  # dots are no end mark: they may stand for a cut
    unit = lambda kind: lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("u"))
    units = lines.select(F.explode(F.concat(F.transform(items, unit("i")), F.transform(whole, unit("s")))).alias("x")).select("x.kind", "x.u")
    words = F.transform(F.regexp_extract_all(F.lower("u"), F.lit(r"[\p{L}\p{N}]+|[,:;]"), F.lit(0)), lambda w: F.regexp_replace(w, r"\p{Nd}+", "0"))
    w = units.select("kind", F.concat(F.array(F.lit("^")), words).alias("w")).where("size(w) > 1")
    steps = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1),
        lambda i: F.struct(F.get("w", i - 1).alias("before"), F.get("w", i).alias("last"), ((i == F.size("w") - 1) | ((F.col("kind") == "i") & F.coalesce(F.get("w", i + 1) == ":", F.lit(False)))).alias("done")),
    )
    return w.select("kind", F.explode(steps).alias("s")).groupBy("kind", "s.before", "s.last").agg(F.count("*").alias("total"), F.sum(F.col("s.done").cast("long")).alias("ends"))


def _closes(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_table, record_id, closes): whether the last unit of a reply (kind, before, last) may end so."""
    key = lambda *parts: F.concat_ws("\1", *parts)
    opens = lambda c: F.when(F.col(c) == "^", "first").otherwise("later")
    two = cut_lineage(ending_counts(pairs))
    counts = two.select(key(F.lit("two"), "kind", "before", "last").alias("key"), "total", "ends")
    counts = counts.unionByName(two.groupBy(key(F.lit("one"), "kind", opens("before"), "last").alias("key")).agg(F.sum("total").alias("total"), F.sum("ends").alias("ends")))
    word = F.explode(F.when(F.col("before") == "^", F.array("before", "last")).otherwise(F.array("last")))
    counts = counts.unionByName(two.select(word.alias("w"), "total").groupBy(key(F.lit("word"), "w").alias("key")).agg(F.sum("total").alias("total"), F.lit(0).cast("long").alias("ends")))
    wanted = {
        "pair": key(F.lit("two"), "kind", "before", "last"), "lone": key(F.lit("one"), "kind", opens("before"), "last"), "s_pair": key(F.lit("two"), F.lit("s"), "before", "last"),
        "s_lone": key(F.lit("one"), F.lit("s"), opens("before"), "last"), "word": key(F.lit("word"), "before"),
    }
    each = asked.select(*_ID, "kind", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), k.alias("key")) for n, k in wanted.items()])).alias("x")).select(*_ID, "kind", "x.name", "x.key")
    met = each.join(counts, "key", "left").groupBy(*_ID, "kind")
    value = lambda n, c: F.coalesce(F.max(F.when(F.col("name") == n, F.col(c))), F.lit(0)).alias(f"{n}_{c}")
    got = met.agg(*[value(n, c) for n in wanted for c in ("total", "ends")])
    c = F.col
    sentence = (
        F.when(c("s_pair_total") >= 4, c("s_pair_ends") >= 0.12 * c("s_pair_total"))
        .when((c("s_pair_total") == 0) & (c("word_total") >= 50), F.lit(False))  # a pair never seen after a frequent word: most likely a cut word
        .when(c("s_lone_total") >= 4, c("s_lone_ends") >= 0.2 * c("s_lone_total"))
        .otherwise((c("s_lone_total") > 0) & (c("s_lone_ends") == c("s_lone_total")))
    )
    item = F.when(c("pair_total") > 0, c("pair_ends") >= 0.5 * c("pair_total")).when(c("lone_total") > 0, c("lone_ends") >= 0.5 * c("lone_total")).otherwise(sentence)
    return got.select(*_ID, F.when(c("kind") == "i", item).otherwise(sentence).alias("closes"))


def _guesses(asked: DataFrame, spoken: DataFrame) -> DataFrame:
    """(record_table, record_id, q_guess, r_guess): the likeliest language of Latin script by the words of
    clear replies, if it is clearly so. `spoken`: lang, word, n."""
    totals = {r["lang"]: r["t"] for r in spoken.groupBy("lang").agg(F.sum("n").alias("t")).collect()}  # one row a language of the list
    each = asked.select(*_ID, F.explode(F.array(F.struct(F.lit("q").alias("side"), F.col("q_words").alias("w")), F.struct(F.lit("r").alias("side"), F.col("r_words").alias("w")))).alias("x")).select(*_ID, "x.side", F.explode("x.w").alias("word"))
    if len(totals) < 2:
        return asked.select(*_ID, F.lit(None).cast("string").alias("q_guess"), F.lit(None).cast("string").alias("r_guess"))
    by_word = spoken.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n_{lang}") for lang in totals])
    counted = each.groupBy(*_ID, "side", "word").agg(F.count("*").alias("times")).join(by_word, "word")
    scores = counted.groupBy(*_ID, "side").agg(*[F.sum(F.col("times") * F.log((F.col(f"n_{lang}") + 0.1) / F.lit(t + 100.0))).alias(f"s_{lang}") for lang, t in totals.items()])
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"s_{lang}").alias("s"), F.lit(lang).alias("lang")) for lang in totals]), asc=False)
    best = scores.select(*_ID, "side", ranked.alias("k")).select(*_ID, "side", F.when(F.col("k")[0]["s"] - F.col("k")[1]["s"] >= 1.5, F.col("k")[0]["lang"]).alias("guess"))
    return best.groupBy(*_ID).agg(*[F.max(F.when(F.col("side") == x, F.col("guess"))).alias(f"{x}_guess") for x in "qr"])


PAIR = "record_table string, record_id long, defect string"


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as one relation of pairs; a key once, whichever of its repeated rows."""
    r = table(spark, sf_dir, "rag_results").select(F.lit("rag_results").alias("record_table"), F.col("result_id").alias("record_id"), F.col("query").alias("question"), F.col("answer").alias("reply"), F.lit(False).alias("refusal_wanted"))
    t = table(spark, sf_dir, "test_unanswerable_only").select(
        F.lit("test_unanswerable_only").alias("record_table"), F.col("item_id").alias("record_id"), "question", F.col("ground_truth").alias("reply"), F.coalesce(F.lower(F.trim("category")) == "unanswerable", F.lit(False)).alias("refusal_wanted")
    )
    return r.unionByName(t)


def defects(pairs: DataFrame) -> DataFrame:
    """(record_table, record_id, defect) of every pair with a defect; each key once."""
    pairs = pairs.where(F.col("record_id").isNotNull())
    read = cut_lineage(spread(pairs).mapInPandas(_read, _READ))
    rows = read.where("word is null").groupBy(*_ID).agg(*[F.min_by(c, F.struct(F.coalesce("defect", F.lit("~")), "before")).alias(c) for c in _READ_COLUMNS[2:11]])
    rows = cut_lineage(rows)
    open_ = rows.where("defect is null")
    guessed = _guesses(open_.where("q_words is not null or r_words is not null"), read.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    closing = _closes(open_.where("kind is not null").select(*_ID, "kind", "before", "last"), pairs.select("reply"))
    j = open_.join(guessed, _ID, "left").join(closing, _ID, "left")
    spoken = lambda x: F.when(F.col(f"{x}_words").isNotNull(), F.coalesce(f"{x}_guess", f"{x}_lang")).otherwise(F.col(f"{x}_lang"))
    other = F.coalesce(spoken("q") != spoken("r"), F.lit(False))
    decided = F.when(other, "other_language").when(F.coalesce("is_cut", ~F.col("closes"), F.lit(False)), "truncated")
    return rows.where("defect is not null").select(*_ID, "defect").unionByName(j.select(*_ID, decided.alias("defect")).where("defect is not null"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair with its one defect."""
    return defects(pairs_of(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by table and defect."""
    return found(spark, sf_dir).groupBy("record_table", "defect").agg(F.count("*").alias("n_pairs"))


QUERIES = {"p1_found": found, "p1_report": report}
ORACLES: dict[str, str] = {}
