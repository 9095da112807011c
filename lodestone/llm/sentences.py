"""Sentence units of texts in any script.

The sentence-break property of every character (STerm, ATerm, Close, Sp, Lower, Upper, OLetter)
comes from the Unicode tables. Terminators of any script end a sentence together with the closing
marks behind them; then suppressions apply: abbreviations by language, initials, ordinals, decimals
and versions, quotations and brackets inside a sentence that goes on, ellipses. A semicolon ends
Greek questions, a space ends Thai sentences. Blank lines and list marks always begin a unit.

The language of a passage is seen from its script and words, not from the row: paragraphs may be
in another language. Each language has its own abbreviations: titles before a name, words that are
abbreviations before a number only (``no``, ``art``, ``sec``), and those that always go on. A lone
capital is an initial unless a word follows that begins sentences (``plan B. It failed``).

Defined results: null, empty and blank texts give no row; a text without any terminator is one
unit; offsets count code points; text of any length is worked on whole, in linear time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by language. TITLES stand before a name (with a capital in languages of
# Latin script), NUMBERED before a number only, GO_ON before anything.
TITLES = {
    "en": "mr mrs ms dr prof rev hon st lt col gen capt sgt maj cmdr adm gov sen rep pres messrs mt ft ave",
    "de": "dr prof hr fr st dipl ing hrsg",
    "fr": "m mm mme mlle me dr pr st ste",
    "es": "sr sra srta dr dra d dña ud uds avda prof",
    "ru": "г ул проф акад доц обл р д им пр просп пл",
    "el": "κ κα κος δρ καθ λεωφ αγ",
    "hi": "डॉ श्री प्रो पं",
    "ar": "د أ م",
}
NUMBERED = {
    "en": "no nos fig figs vol vols sec secs art arts eq eqs ch chap p pp approx",
    "de": "nr abb bd kap tab str s",
    "fr": "art fig vol chap réf env n no p pp",
    "es": "núm art cap fig vol p pág págs tel",
    "ru": "рис гл см стр ст п т руб коп",
    "el": "εικ κεφ αρ σελ",
    "hi": "सं पृ",
    "ar": "ص ج",
}
#: Titles that as well stand behind a name (``Main St. Then``): not before a word that begins sentences.
STREETS = {"st", "ave", "mt", "ft", "pl", "str"}
#: Abbreviations that are words of no language of Latin script; they hold whatever the passage's language.
PLAIN = set("mr mrs ms dr prof mme mlle sr sra srta dra lt capt sgt messrs approx env fig figs vol vols nr núm réf pp pág págs kap abb chap bzw vgl".split())
GO_ON = {
    "en": "vs cf i.e e.g viz ca",
    "de": "ca bzw vgl evtl ggf inkl exkl zzgl sog z.b d.h u.a z o",
    "fr": "cf av env p.ex",
    "es": "ej p.ej aprox ee",
    "ru": "т.е т.д т.п тыс млн млрд напр др",
    "el": "π.χ χλμ π",
    "hi": "",
    "ar": "",
}
#: Abbreviations of two words, by the second: (first, second).
TWO_WORDS = {("p", "ex"), ("par", "ex"), ("p", "ej"), ("et", "al"), ("z", "b"), ("d", "h"), ("u", "a"), ("т", "е"), ("т", "д"), ("т", "п")}
LATIN = ("en", "de", "fr", "es")
#: Word: the languages that know it, by the kind of abbreviation.
KNOWN = {kind: {} for kind in ("title", "numbered", "go on")}
for _kind, _lists in (("title", TITLES), ("numbered", NUMBERED), ("go on", GO_ON)):
    for _lang, _words in _lists.items():
        for _w in _words.split():
            KNOWN[_kind].setdefault(_w, set()).add(_lang)
ABBREVIATIONS = set().union(*KNOWN.values()) | {b for _, b in TWO_WORDS}
# Abbreviations that may well end a sentence: a capital behind them begins one.
MAY_END = set("etc usw inc ltd co corp u.s u.k e.u uu д км jan feb mar apr jun jul aug sept sep oct nov dec a.m p.m jr".split())
# Words by which a passage of Latin script shows its language.
TELLING = {
    "en": "the of and to in that was is it for on with as he she they his her not but from this which were had said by".split(),
    "de": "der die das und ist nicht ein eine den dem mit von zu auf im wird sich auch wurde war nach ohne bei am".split(),
    "fr": "le la les et est un une des du dans que qui pour pas sur il elle au ce avec sans après à ont a".split(),
    "es": "el la los las y es un una de del en que por se con su al para lo sin está fue tras".split(),
}
TELLS = {}
for _lang, _words in TELLING.items():
    for _w in _words:
        TELLS.setdefault(_w, []).append(_lang)
# Words that begin a sentence and no name: behind them a lone capital was no initial.
STARTERS = set(
    """
    it he she we they you i the a an this that these those there then but and or so if when while as in on at for to no yes not
    what who why how where its his her our your their my one some many most all both each now here after before however
    er sie es wir ihr ich der die das ein eine dann aber und oder wenn als da hier dort dies diese dieser nun nach vor im am
    il elle on nous vous ils elles je le la les un une des ce cette ces mais et ou puis alors quand si dans
    él ella nosotros ellos yo el los las una pero y luego entonces cuando este esta esto en
    он она оно они мы вы я это этот эта но и а затем потом когда если в на
    """.split()
)
# Words before a German ordinal.
ORDINAL_BEFORE = set("der die das dem den des am im zum vom beim zur ab bis seit jeder jede jedes jeden ihr sein unser dieser diesem diesen und".split())
# After a quotation: how the sentence that holds it goes on in scripts without capitals. A verb of
# saying belongs to the quotation if a mark follows it; before a colon it opens the next one.
GOES_ON = regex.compile(
    r"""\s*(?:[,،、，;:：]|[—–-]\s|[—–]{1,2}
    |と|って(?!い)|という|라고|하고|이라고|고\s
    |[\p{Han}\p{Latin}\p{M}·.' -]{0,24}?(?:[问喊说写答叫吼嚷问]道|说|回答|道)(?=[，,。.！!；;])
    |[^\s।?!.,]{1,40}(?:\s[^\s।?!.,]{1,40})?\s+ने\s+[^\s।?!.,]{1,40}\s*[।?!.,]
    |(?:คุณ\s?)?[^\s]{0,40}?\s?(?:ถาม|กล่าว|บอก)|ने\s+[^\s।?!.,]{1,40}\s*[।?!.,])""",
    regex.VERBOSE,
)
# As above, but only after a question or a cry: a verb that begins the next sentence is as likely else.
ASKED = regex.compile(r"\s*(?:سأل|سألت|قال|قالت|صرخ|صرخت|أجاب|أجابت)\s")
ELLIPSIS = regex.compile(r"…+|\.{3,}|。{3,}|⋯+")
TERM = regex.compile(r"(?:[\p{SB=STerm}\p{SB=ATerm}…⋯]|(?<=\p{Greek}[»\"”)]?);|;)+(?:[\s ]*[!?‼⁇⁈⁉？！]+)*")
CLOSE = regex.compile(r"[   ]?»|[)\]}”’›」』）】》〉〕｝］\"'“‘]")
OPEN = "([{“‘«‹「『（【《〈〔｛［„‚"
PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "］": "［", "〕": "〔", "｝": "{"}
QUOTE_PAIRS = {"”": "“", "’": "‘", "»": "«", "›": "‹", "」": "「", "』": "『", "》": "《", "〉": "〈", "“": "„", "‘": "‚", '"': '"', "'": "'"}
BREAK = r"(?>\r\n|[\n\r\x85 ])"
BLANK = regex.compile(BREAK + r"[^\S\n\r\x85 ]*" + BREAK + r"\s*| \s*")
MARKED = regex.compile(r"(?:(?<=[\n\r\x85 ])|^)[^\S\n\r\x85 ]*(?=[-•] )")
INITIALS = regex.compile(r"\p{Lu}(?:\.?-\p{Lu})+")
BRACKET = re.compile(r"[(\[{（【［〔｛]")
MAY_CLOSE = set(")]}”’›」』）】》〉〕｝］»\"'“‘ \xa0\u2007\u2008\u2009\u202f")
ANY_BRACKET = re.compile(r"[(\[{（【［〔｛)\]}）】］〕｝]")
COUNTED = re.compile("[\"'“”„‘’‚]")
ELISION = re.compile("[.'’]")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
THAI = re.compile("[\u0e00-\u0e7f]")
THAI_SPACE = regex.compile(r"(?<=[\p{Thai}\p{Po}\p{Pf}\p{Pe}\"])\s+(?=[\p{Thai}\p{Pi}\p{Ps}\"])")
SKIP = regex.compile(r"[\s\p{Pi}\p{Ps}\"'„‚«‹¿¡*_=#]*")
LATIN_DIGIT = regex.compile(r"[\p{Latin}\p{N}]")
CASELESS = regex.compile(r"\p{SB=OLetter}")


def m_end(text: str, at: int) -> int:
    """The end of the white space at ``at``."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_" or c >= "\u0300" and unicodedata.category(c)[0] == "M"


def _word_before(text: str, at: int) -> str:
    """The word that ends at ``at``, with marks inside such as U.S or J.-P; 40 characters at most."""
    i, least = at, max(0, at - 40)
    while i > least:
        c = text[i - 1]
        if not (_in_word(c) or c in ".'’-" and i < at and i - 1 > least and _in_word(text[i - 2]) and _in_word(text[i])):
            break
        i -= 1
    return text[i:at]


class Passage:
    """What is known of one passage while its marks are gone through from left to right.

    Every counter only moves forward, so a passage costs its length once, whatever its sentences.
    """

    def __init__(self, text: str, begin: int, end: int, has_quotes: bool, has_brackets: bool):
        self.text, self.begin, self.end = text, begin, end
        self.at = begin  # where the sentence begins
        self.seen = begin  # marks before this are counted
        self.counts: dict[str, int] = {}
        # brackets of the passage that have a mate, in the order they open
        self.pairs: list[tuple[int, int]] = []
        self.next_pair, self.reach = 0, -1
        if has_brackets:
            open_: dict[str, list[int]] = {}
            for m in ANY_BRACKET.finditer(text, begin, end):
                c = m.group()
                if c in PAIRS:
                    if open_.get(PAIRS[c]):
                        self.pairs.append((open_[PAIRS[c]].pop(), m.start()))
                else:
                    open_.setdefault(c, []).append(m.start())
            self.pairs.sort()
        self.has_quotes = has_quotes
        self.lang: tuple[str, ...] | None = None
        self._start_sentence(begin)

    def _start_sentence(self, at: int) -> None:
        self.at = at
        self.first = m_end(self.text, at) if at < self.end else at
        self.seen, self.reach = max(self.seen, at), -1
        self.counts.clear()

    cut = _start_sentence

    def advance(self, to: int) -> None:
        """Count the quotation marks and find the brackets before ``to``."""
        if self.has_quotes:
            text = self.text
            for m in COUNTED.finditer(text, self.seen, to):
                c, i = m.group(), m.start()
                if c != "'" or not (i > 0 and text[i - 1].isalnum() and i + 1 < len(text) and text[i + 1].isalnum()):
                    self.counts[c] = self.counts.get(c, 0) + 1
        while self.next_pair < len(self.pairs) and self.pairs[self.next_pair][0] < to:
            left, right = self.pairs[self.next_pair]
            if left > self.first:
                self.reach = max(self.reach, right)
            self.next_pair += 1
        self.seen = to

    def closes(self, at: int) -> int:
        """The end of the closing marks that follow a terminator at ``at``."""
        text, end = self.text, self.end
        if at >= end or text[at] not in MAY_CLOSE:
            return at
        more: dict[str, int] = {}
        n = lambda c: self.counts.get(c, 0) + more.get(c, 0)
        while at < end and (m := CLOSE.match(text, at, end)):
            mark = m.group()[-1]
            if mark in "\"'“‘":
                # a mark that may open as well closes only what is open
                if mark == "'" and m.end() < end and text[m.end()].isalnum():
                    break
                if mark in "\"'":
                    if n(mark) % 2 == 0:
                        break
                elif n(QUOTE_PAIRS[mark]) <= n(mark):
                    break
            more[mark] = more.get(mark, 0) + 1
            at = m.end()
        return at

    def knows(self, word: str, kind: str) -> bool:
        """Whether the passage's language has the word among its abbreviations of a kind."""
        langs = KNOWN[kind].get(word)
        if not langs:
            return False
        if word in PLAIN or not any(x in LATIN for x in langs):
            return True  # the word or its script says it
        if self.lang is None:
            self.lang = self._language()
        return any(x in langs for x in self.lang)

    def _language(self) -> tuple[str, ...]:
        """Languages of Latin script with the most telling words; all of them if hardly one is there."""
        votes = dict.fromkeys(LATIN, 0)
        for m in LETTERS.finditer(self.text, self.begin, self.end):
            for x in TELLS.get(m.group().lower(), ()):
                votes[x] += 1
        most = max(votes.values())
        return tuple(x for x in LATIN if votes[x] == most or most < 2)


def _prior(text: str, begin: int, at: int) -> str:
    """The word before the one that begins at ``at``, within the sentence."""
    i = at
    while i > begin and (text[i - 1].isspace() or text[i - 1] in ".("):
        i -= 1
        if at - i > 8:
            return ""
    return _word_before(text, i) if i > begin else ""


def _ends(p: Passage, m: regex.Match, closed: int) -> bool:
    """Whether the terminator ``m``, with its closing marks up to ``closed``, ends the sentence."""
    text, end, mark = p.text, p.end, m.group()
    if closed >= end:
        return True
    start = SKIP.match(text, closed, end).end()
    if start >= end:
        return True
    spaced = text[closed].isspace()
    nxt = text[start]
    quoted = closed > m.end() and any(c in QUOTE_PAIRS for c in text[m.end() : closed])
    if quoted and mark[-1] in "؟?!" and ASKED.match(text, closed, end):
        return False
    if p.reach >= m.start():
        return False  # within a bracket that the sentence opened
    if (quoted or mark[-1] not in ".") and (quoted or text[closed] in ",،、，") and GOES_ON.match(text, closed, end):
        return False
    first = mark[0]
    if ELLIPSIS.match(mark):
        if mark[-1] not in ".…⋯。":
            return not nxt.islower()
        return spaced and (nxt.isupper() or text[closed:start].strip() != "" or nxt.isdigit())
    if mark == ".":
        before = text[m.start() - 1] if m.start() > p.at else ""
        if not spaced and closed == m.end():
            if before.isdigit() and nxt.isdigit() and start == closed:
                return False
            if start == closed and not (nxt.isupper() or CASELESS.match(nxt)):
                return False
            if start == closed and LATIN_DIGIT.match(before or ".") and not before.islower() and not before.isdigit():
                return False
            if start > closed and text[closed] not in OPEN + '"¿¡':
                return False
        if nxt.islower():
            return False
        if closed == m.end():
            return not _abbreviated(p, m.start(), start, spaced)
        return True
    if first in ";;":
        return True
    # ! ? and the terminators of other scripts; in a name (Zapp! parser) a small letter goes on
    return not nxt.islower()


def _abbreviated(p: Passage, dot: int, start: int, spaced: bool) -> bool:
    """Whether the word before the full stop at ``dot`` is an abbreviation, initial or ordinal that goes on at ``start``."""
    text, nxt = p.text, p.text[start]
    word = _word_before(text, dot)
    at = dot - len(word)
    low = word.lower()
    tail = ELISION.split(low)[-1]
    if len(word) > 3 and tail == low and low not in ABBREVIATIONS and "-" not in low:
        return False
    if not spaced and nxt.isupper() and len(tail) < 2 and not CASELESS.match(word[-1:] or "."):
        return True
    if word[len(word) - len(tail) :][:1].isupper() or not _latin(word):
        if p.knows(low, "title") or p.knows(tail, "title"):
            return tail not in STREETS or _next_word(text, start, p.end) not in STARTERS
    if low in MAY_END:
        return False
    if nxt.isdigit() and (p.knows(low, "numbered") or p.knows(tail, "numbered")):
        return True
    if p.knows(low, "go on") or p.knows(tail, "go on") and tail not in STARTERS:
        return True
    prior = _prior(text, p.at, at)
    if (prior.lower().rpartition(".")[2], tail) in TWO_WORDS or "." in low and tuple(low.split(".")[-2:]) in TWO_WORDS:
        return True
    if len(word) == 1 and word.isalpha() and (word.isupper() or CASELESS.match(word)) or INITIALS.fullmatch(word):
        # an initial at the beginning, behind a name, a title or another initial; else only if a name may follow
        if at <= p.first or prior[:1].isupper() or p.knows(prior.lower(), "title"):
            return prior[:1].isupper() is False or len(prior) <= 1 or _next_word(text, start, p.end) not in STARTERS
        return _next_word(text, start, p.end) not in STARTERS
    if "." in word and all(len(x) == 1 for x in word.split(".")):
        return _next_word(text, start, p.end) not in STARTERS
    if word.isdigit() and len(word) <= 3 and nxt.isupper():
        if prior.lower().rpartition(".")[2] in ORDINAL_BEFORE:
            return True
        if at <= p.first:
            return True  # the number of a list or a day
    return False


def _latin(word: str) -> bool:
    return LATIN_DIGIT.match(word) is not None


def _next_word(text: str, start: int, end: int) -> str:
    """The word at ``start`` in lower case; a longer one than 20 letters is no starter and may be cut."""
    m = LETTERS.match(text, start, min(end, start + 20))
    return m.group().lower() if m else ""


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, without the white space around it."""
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    is_thai = THAI.search(text) is not None
    kinds = COUNTED.search(text) is not None, BRACKET.search(text) is not None
    edges = {0, len(text)}
    for m in BLANK.finditer(text):
        edges.add(m.end())
    for m in MARKED.finditer(text):
        edges.add(m.end())
    edges = sorted(edges)
    for begin, end in zip(edges, edges[1:]):
        stop = end
        while stop > begin and text[stop - 1].isspace():
            stop -= 1
        thai = THAI_SPACE.finditer(text, begin, stop) if is_thai else ()
        marks = [(m.start(), m) for m in TERM.finditer(text, begin, stop)] + [(m.start(), None) for m in thai]
        if not marks:
            add(begin, stop)
            continue
        p = Passage(text, begin, stop, *kinds)
        for pos, m in sorted(marks, key=lambda x: x[0]) if is_thai else marks:
            if pos < p.at:
                continue
            if m is None:
                # a space of Thai text: one of its sides is a Thai letter
                side = text[pos - 1], text[m_end(text, pos)]
                if any("฀" <= c <= "๿" for c in side) and not (pos - p.first == 1 and text[p.first] in "-•"):
                    add(p.at, pos)
                    p.cut(pos)
                continue
            after = m.end()
            if after < stop and text[after].isdigit() and pos > begin and text[pos - 1].isdigit() and after == pos + 1 and text[pos] == ".":
                continue  # a decimal or a version
            p.advance(after)
            closed = p.closes(after)
            if _ends(p, m, closed):
                add(p.at, closed)
                p.cut(closed)
        add(p.at, stop)
    return out


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char) of every sentence, in one pass and without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                rows, start, end = [], [], []
                for i, t in enumerate(piece.column("__text").to_pylist()):
                    if t:
                        for a, b in spans(t):
                            rows.append(i)
                            start.append(a)
                            end.append(b)
                yield pa.RecordBatch.from_arrays([piece.column("__key").take(pa.array(np.array(rows, np.int64))), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[key, "start_char", "end_char"])

    return docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).mapInArrow(work, f"`{key}` {kind}, start_char int, end_char int")
