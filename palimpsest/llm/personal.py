"""Problem 2: personal details in free text.

A transducer rewrites each text into a plain form: look-alike letters and digits of other scripts become Latin, invisible
characters go, spelled digits become digits, and the disguises of @ and . in addresses are undone. Every character of
the plain form knows the source characters it came from. Detectors run on the plain form; their spans are mapped back,
and only the source characters under them are replaced by a placeholder of the kind.

Names with a title are found by it. For others the corpus decides: every pair of capitalised words, and every pair of
words that are rare in lower case, may be a name. Some stand where names stand (beside a contact detail, after the label
of a field, after a word for a person or a greeting, before a verb of speech), and a word's share of such places among all
its places as a given or family name tells names from places and products. A pair is a name, in every text and in any
case, if the log-odds of its two words say so.

Defined results: null gives null, and texts without details come back unchanged; spans of different kinds that overlap
are one span of the kind found first in KINDS; repeated rows repeat; replacing twice changes nothing more.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.batches import map_lists
from palimpsest.operators.joins import salted
from palimpsest.session import cut

KINDS = ("email", "identity_number", "phone", "street_address", "person")

# Look-alikes of other scripts, characters without width, spelled digits.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν‐‑‒–—−﹘＠．․。﹒", "ABEKMHOPCTXaeopcyxijsdABEZHIKMNOPTYXoav-------@....."))
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {w: str(i) for i, w in enumerate("zero uno due tre quattro cinque sei sette otto nove".split())} | {"oh": "0"}

_ONE = {c: LOOKALIKES.get(c) or (str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else unicodedata.normalize("NFKC", c)) for c in [*LOOKALIKES, *map(chr, range(0xFF01, 0xFF5F)), *map(chr, range(0x660, 0x66A)), *map(chr, range(0x6F0, 0x6FA)), *map(chr, range(0x966, 0x970))]}
_ONE |= {" ": " ", " ": " ", " ": " "}
TABLE = str.maketrans(_ONE)
HIDDEN = re.compile(f"[{INVISIBLE}]")
_SPELLED = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?i)\b(?:(?:double|triple)[ -])?(?:{_SPELLED})(?:[ ,-]+(?:(?:double|triple)[ -])?(?:{_SPELLED}))" + r"{4,}\b")
AT = re.compile(r"(?i)(?<=[\w+])\s{0,2}(?:[\[({<]\s?(?:at|chiocciola)\s?[\])}>]|\s(?:at|chiocciola)\s(?=\s?[\w-]+(?:\s?[\[({]\s?(?:dot|punto)|\s(?:dot|punto)\s))|\s?@\s)\s{0,2}(?=\w)|(?<=\w)\s@(?=\w+\.)")
DOT = re.compile(r"(?i)(?<=\w)\s{0,2}(?:[\[({<]\s?(?:dot|punto)\s?[\])}>])\s{0,2}(?=\w)")
DOT_WORD = re.compile(r"(?i)(?<=\w)\s(?:dot|punto)\s(?=\w)")
DISGUISED = ("@ ", " @", "(at", "[at", "{at", "<at", "( at", "[ at", "chiocciola", " dot ", " punto ", "(dot", "[dot", "{dot")


NUMERALS, SIGNS = frozenset(DIGITS), frozenset("at dot punto chiocciola".split())
BREAKS = {c: " " for c in range(0x250) if not (chr(c).isalpha() or chr(c) in "'-")} | {ord(c): " " for c in "‘“”„…–—•·«»"} | {0x2019: "'"}


class Plain:
    """The plain form of a text and, if it differs in length, the source places of its characters."""

    def __init__(self, source: str):
        self.source, self.text, self.at = source, source, None
        if not source.isascii():
            self.text = source.translate(TABLE)
            self.rewrite(HIDDEN, lambda m: "")
        low = self.text.lower()
        self.words = set(low.translate(BREAKS).split())
        if not NUMERALS.isdisjoint(self.words) and sum(w in DIGITS for w in low.replace(",", " ").replace("-", " ").split()) > 4 or any("-" in w and w.partition("-")[0] in DIGITS for w in self.words):
            self.rewrite(SPELLED, self.digits)
        if "@" not in low and SIGNS.isdisjoint(self.words) or not any(x in low for x in DISGUISED):
            return
        self.rewrite(AT, lambda m: "@")
        self.rewrite(DOT, lambda m: ".")
        if "@" in self.text:
            self.rewrite(re.compile(r"(?i)(?<=@)(?:[\w-]+\s(?:dot|punto)\s)+(?=\w)"), lambda m: DOT_WORD.sub(".", m[0] + "x")[:-1])

    @staticmethod
    def digits(m: re.Match) -> str:
        out, times = [], 1
        for w in re.findall(r"[a-z]+", m[0].lower()):
            if w in ("double", "triple"):
                times = 2 if w == "double" else 3
            else:
                out.append(DIGITS[w] * times)
                times = 1
        return "".join(out)

    def rewrite(self, rule: re.Pattern, by) -> None:
        found = list(rule.finditer(self.text))
        if not found:
            return
        at = self.at or list(range(len(self.text) + 1))
        text, places, last = [], [], 0
        for m in found:
            new = by(m)
            text += [self.text[last : m.start()], new]
            places += at[last : m.start()]
            places += [at[m.start()]] * len(new)
            last = m.end()
        text.append(self.text[last:])
        places += at[last:]
        self.text, self.at = "".join(text), places

    def back(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the plain span; the end is that of the last rewritten group of characters."""
        if self.at is None:
            return a, b
        end = b
        while end < len(self.text) and end > 0 and self.at[end] == self.at[end - 1]:
            end += 1
        return self.at[a], self.at[end]


_W = r"[^\W\d_]"
EMAIL = re.compile(r"(?<![\w.+/:@-])(?:mailto:)?(?P<v>[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w@]|:[\w./~])")
_S = r"[ .\-]"
PHONE = re.compile(
    rf"(?<![\w.,#/+-])(?P<v>\+\d{{1,3}}{_S}?(?:\(0\){_S}?)?\d{{1,4}}(?:{_S}?\d{{2,5}}){{1,4}}"
    rf"|\(\d{{3}}\) ?\d{{3}}{_S}?\d{{4}}|[2-9]\d{{2}}([. -])[2-9]\d{{2}}\2\d{{4}}"
    rf"|0\d(?:[. ]\d{{2}}){{4}}|0\d{{2}} \d{{4}} \d{{4}}|0\d{{3,4}} \d{{3}} ?\d{{3}}|0\d{{10}}|3\d{{2}}[ .]\d{{3}} ?\d{{4}})(?![\w-]|[.,]\d|/\d)"
)
PHONE_CUE = re.compile(r"(?i)(?:\b(?:tel|cell|call)|phone|mobile|whatsapp|richiama|chiamare|(?:my|phone|il mio|di telefono) (?:number|numero))[\w.]*[:=]?\s*(?:is|it is|è)?\s*(?P<v>\+?\(?\d[\d().\s-]{5,16}\d)(?![\w-])")
CODE = re.compile(r"\b(?P<v>[A-Za-z]{3} ?[A-Za-z]{3} ?\d{2}[A-EHLMPR-Ta-ehlmpr-t]\d{2} ?[A-Za-z]\d{3}[A-Za-z])\b")
INSURANCE = re.compile(r"\b(?P<v>[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])\b|\b(?P<w>QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D])\b")
SOCIAL = re.compile(r"(?<![\w.+/#-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-]|\.\d)")
ID_CUE = re.compile(
    r"(?i)\b(?:SSN|ID|NI|passport|passaporto|identit\w+|card|carta|tessera|letter|copy|document[oi]?|licen[cs]e|patente|permit|certificate|codice fiscale|tax code|social security|national insurance)\b"
    r"[^.\n\d]{0,30}?(?:n\. ?|no\. ?)?(?P<v>(?<![\w.+/#-])(?:\d{3}[ -]?\d{2}[ -]?\d{4}|[A-Z]{1,2}\d{6,8}|[A-Z]{2}\d{5}[A-Z]{2}|\d{8,11}))(?![\w-]|\.\d)"
)
_ROAD = r"(?:Street|St|Road|Rd|Lane|Ln|Terrace|Ter|Row|Court|Ct|Avenue|Ave|Drive|Dr|Close|Crescent|Place|Pl|Square|Sq|Way|Walk|Hill|Gardens|Grove|Mews|Boulevard|Blvd|Parade|Quay|Rise|View)"
_TOWN = rf"(?:(?:,| in) {_W}+(?: {_W}+)?)?(?: [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}})?"
_FLAT = r"(?i:flat|apt|unit|suite|interno|int)\.? ?\d+[A-Za-z]?"
_NUMBER = r"\d{1,5}(?:[A-Za-z]|-\d{1,4})?"
_WORDS = rf"(?:[A-ZÀ-Ý][\w'’]*\.? ){{1,3}}{_ROAD}\b\.?"
_LOW_WORDS = rf"(?:(?!(?:more|than|the|further|of|my|cases|times|days|where|and|or|in|on|per|for|to|from|with|other|new|old) )[a-z][\w'’]* ){{1,3}}(?:{_ROAD.lower()})\b\.?(?=,? (?:in )?(?:{_FLAT})?[A-Z])"
STREET = re.compile(rf"(?<![\w.#-])(?P<v>(?:{_FLAT},? )?{_NUMBER},? (?:{_WORDS}|{_LOW_WORDS}|(?:[A-ZÀ-Ý]+ ){{1,3}}{_ROAD.upper()}\b\.?)(?:,? {_FLAT})?{_TOWN})")
BOX = re.compile(rf"(?i)(?<!\w)(?P<v>(?:P\.? ?O\.? ?Box|post box|casella postale|C\.P\.) ?(?:n\. ?)?\d+{_TOWN})")
VIA = re.compile(rf"(?i)(?<!\w)(?P<v>(?:via|viale|v\.le|piazza|p\.?zza|piazzale|corso|c\.so|vicolo|largo|strada|lungomare|contrada|borgo)\.? (?:{_W}[\w'’.]*\s){{1,4}}?(?:n\. ?|n° ?|, ?)?\d{{1,4}}(?:/?[a-z])?\b(?:(?:,| -) ?(?:\d{{5}} )?{_W}+)?)")
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Rev|Dott|Dott\.ssa|Sig|Sigg|Sig\.ra|Sig\.na|Ing|Avv|Rag|Geom|Arch)"
_CAP = r"[A-ZÀ-Ý][\w'’-]+"
TITLED = re.compile(rf"(?<!\w)(?P<v>{_TITLE}\.? (?:[A-Z]\. )?(?:{_CAP}, )?{_CAP}(?: [A-Z]\.)?(?: {_CAP})?)")
#: Two words that may be a name: both capitalised, or (in lower case) both rare; pairs may share a word.
PAIR = re.compile(rf"(?<![\w.@/'’-])(?=(?P<a>{_CAP})(?P<s>, | (?:[A-Z]\. )?)(?P<b>{_CAP})(?![\w@/]))")
LOW_PAIR = re.compile(rf"(?<![\w.@/'’-])(?=(?P<a>{_W}[\w'’-]+)(?P<s>, | (?:\w\. )?)(?P<b>{_W}[\w'’-]+)(?![\w@/]))")
# Common words beside which a human's name stands, in both languages. Beside one of them a pair of words may
# be a name, no more: what the corpus knows of the two words decides.
ROLES = "landlord landlady boss manager neighbour neighbor doctor dentist lawyer teacher colleague friend sister brother mother father uncle aunt cousin wife husband son daughter partner client patient tenant director editor author nurse assistant captain judge collega fratello sorella madre padre zio zia cugino cugina moglie marito figlio figlia amico amica vicino vicina capo medico dottore dottoressa avvocato maestro maestra professore professoressa cliente paziente inquilino direttore signor signora"
MEETINGS = "ask asked tell told call called phone phoned meet met thank thanked contact contacted reach reached invite invited remind reminded email emailed visit visited hire hired chiama chiamato incontra incontrato ringrazia contatta sentito"
GREETINGS = "dear hi hello hey thx thanks cheers regards sincerely ciao caro cara gentile egregio saluti grazie"
DOINGS = "said told wrote asked replied phoned promised answered lives works agreed insisted dice scrive risponde vive lavora"
BEFORE, AFTER = frozenset(f"{ROLES} {MEETINGS} {GREETINGS}".split()), frozenset(DOINGS.split())
#: What a text must hold, in lower case, for a rule to be run on it.
NEEDS = {
    "box": ("box", "casella postale", "c.p."),
    "via": tuple(f"{w}{e}" for w in ("via", "viale", "v.le", "piazza", "p.zza", "pzza", "piazzale", "corso", "c.so", "vicolo", "largo", "strada", "lungomare", "contrada", "borgo") for e in (" ", ". ")),
    "call": ("tel", "phone", "mobile", "cell", "whatsapp", "call", "richiama", "chiamare", "numero", "number"),
    "card": ("ssn", "id", "passport", "passaporto", "identit", "card", "carta", "tessera", "letter", "copy", "document", "licen", "patente", "permit", "certificate", "fiscale", "tax code", "social security", "national insurance", "ni "),
}
TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Dott", "Sig", "Ing", "Avv", "Rag", "Geom")
DIGIT, SIX = re.compile(r"\d"), re.compile(r"\d\d ?\d\d ?\d\d ?[A-D]|\d{6}|\d{5}[A-Za-z]{2}")
NUMBERS = re.compile(r"\d[\d().\s-]{6,}\d")
CODED = re.compile(r"\d\d ?[A-Za-z]\d\d")
SPOKEN = frozenset("speak spoke spoken talk talked write wrote ask asked look wait sign signed addressed sent send belongs given work works live lives chiedi chiedere scrivi scrivere parlato parlare firmato intestato intestata inviato indirizzato consegnato affidato scritto".split())
DIRECTED, PREPOSITIONS = frozenset("with to for as by a ad con da".split()), frozenset("of on in at about near over from between su di in da del della sul sulla per tra fra".split())
AFTER_TITLE = re.compile(rf"^(?:{_TITLE}\b\.? )?")
#: What may stand between a name and a contact detail, and a field's label before a name.
GAP_WORD = re.compile(r"(?i)\b(?:at|on|or|is|al|a|o|via|email|e-mail|mail|tel|phone|cell|id)\b|mailto")
JOINS = (" or ", " and ", " e ", " o ", ", ")
LABEL = re.compile(r"(?:[^\n]*[|;,] *)?[*_> -]*[^\W\d_]{2,12}(?: ?[:=]| n\.) *")
#: A word is common from this share of all words in lower case on, so at most 1 / COMMON words are, and LEAST times.
COMMON, LEAST = 2e-5, 20
#: Share of the places of a name, and of other capitalised pairs, that tell a name; share of pairs that are names; most that one word tells.
TOLD_NAMES, TOLD_OTHERS, NAMES, MOST = 0.6, 0.04, 0.03, 8.0


def parts(name: str) -> tuple[str, str]:
    """Given and family name, in lower case; the given one is empty if only a family name is there."""
    name = AFTER_TITLE.sub("", name).lower()
    if ", " in name:
        family, _, given = name.partition(", ")
        return given.split()[0], family
    words = [w for w in name.split() if not w.endswith(".")]
    return (words[0], words[1]) if len(words) > 1 else ("", words[0] if words else "")


ROADS = frozenset("street st road rd lane ln terrace row court ct avenue ave drive dr close crescent place pl square sq way walk hill gardens grove mews boulevard blvd parade quay rise view ter".split())


def details(t: str, words: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the details in a plain form that their form or a title tells; in order and disjoint."""
    spans: list[tuple[int, int, str]] = []

    def add(kind: str, rule: re.Pattern, check=None) -> None:
        for m in rule.finditer(t):
            for g in ("v", "w"):
                if g in rule.groupindex and m[g] and (check is None or check(m, g)):
                    spans.append((*m.span(g), kind))

    if "@" in t:
        add("email", EMAIL, lambda m, g: not t.startswith("git@", m.start(g)) and "://" not in word_before(t, m.start(g)))
    if DIGIT.search(t):
        low = t.lower()
        has = lambda name: any(x in low for x in NEEDS[name])
        long = NUMBERS.search(t)
        enough = lambda m, g: 8 <= sum(c.isdigit() for c in m[g]) <= 15
        six = SIX.search(t)
        if CODED.search(t):
            add("identity_number", CODE)
        if long:
            add("identity_number", SOCIAL)
            add("phone", PHONE, enough)
            if has("call"):
                add("phone", PHONE_CUE, enough)
        if six:
            add("identity_number", INSURANCE)
        if (long or six) and has("card"):
            add("identity_number", ID_CUE)
        if not ROADS.isdisjoint(words):
            add("street_address", STREET)
        if has("box"):
            add("street_address", BOX)
        if has("via"):
            add("street_address", VIA)
    if any(x in t for x in TITLES):
        add("person", TITLED)
    out: list[tuple[int, int, str]] = []  # in order and disjoint
    for a, b, kind in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0], -x[1])):
        at = near(out, a, b)
        if at is not None and kind == "person" and a < at:  # a name may end where an address begins
            b = a + len(t[a:at].rstrip(" ,"))
            at = near(out, a, b) if TITLED.fullmatch(t[a:b]) else at
        if at is None:
            insort(out, (a, b, kind))
    return out


def near(spans: list[tuple[int, int, str]], a: int, b: int) -> int | None:
    """Where the first of the spans (in order and disjoint) that overlaps a..b begins; None: there is none."""
    i = bisect_left(spans, (a,))
    if i and spans[i - 1][1] > a:
        return spans[i - 1][0]
    return spans[i][0] if i < len(spans) and spans[i][0] < b else None


def word_before(t: str, at: int) -> str:
    """What stands before the place up to the white space before it."""
    start = at
    while start and not t[start - 1].isspace():
        start -= 1
    return t[start:at]


def told(t: str, a: int, b: int, spans: list[tuple[int, int, str]]) -> bool:
    """Does what stands around t[a:b] say that it may well be a human's name?"""
    before = t[max(0, a - 40) : a]
    bare = before.rstrip(" \t|*_>([\"'")
    line = before.rpartition("\n")[2]
    i = bisect_left(spans, (a,))
    for c, d in ((spans[i - 1][1], a) if i else (0, 99), (b, spans[i][0]) if i < len(spans) else (0, 99)):
        if d - c <= 16 and not any(x.isalnum() for x in GAP_WORD.sub("", t[c:d])):  # beside a contact detail
            return True
    if LABEL.fullmatch(line):
        return True
    words = bare.rstrip(",:\n \t").lower().split()[-3:]
    last = words[-1] if words else ""
    if last in BEFORE or last in DIRECTED and not SPOKEN.isdisjoint(words[:-1]):
        return True
    after = t[b : b + 14].lstrip(", ").split(None, 1)
    return bool(after) and t[b : b + 1] in (" ", ",") and last not in PREPOSITIONS and after[0].rstrip(".,:;") in AFTER


def candidates(t: str, words: set[str], details: list[tuple[int, int, str]], common: frozenset | set) -> list[tuple[int, int, str, str, bool, bool]]:
    """(start, end, given, family, told, capital) of the pairs of words that may be a name; common: words usual in lower case."""
    found, spans, contacts = [(m, True) for m in PAIR.finditer(t)], details, [x for x in details if x[2] != "person"]
    rare = {w for w in words - common if len(w) > 2 and w in t}
    if len(rare) > 1:
        found += [(m, False) for m in LOW_PAIR.finditer(t) if m["a"] in rare and m["b"] in rare]
    out, last = [], -1  # where the last told pair ends
    for m, capital in sorted(found, key=lambda x: x[0].start()):
        a, b = m.start("a"), m.end("b")
        if near(spans, a, b) is None:
            x, y = m["a"].lower(), m["b"].lower()
            if x in common and y in common:
                continue
            given, family = (y, x) if m["s"] == ", " else (x, y)
            tells = told(t, a, b, contacts) or 0 <= last < a and t[last:a] in JOINS
            last = b if tells else last
            out.append((a, b, given, family, tells, capital))
    return out


def odds(told: int, n: int) -> float:
    """Log-odds that a word which stands n times in capitalised pairs, told of them where names stand, is part of names."""
    got = told * math.log(TOLD_NAMES / TOLD_OTHERS) + (n - told) * math.log((1 - TOLD_NAMES) / (1 - TOLD_OTHERS))
    return max(-MOST, min(MOST, got))


def find(source: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the details in one text, in order and disjoint; what tells names is this text alone."""
    plain = Plain(source)
    spans = details(plain.text, plain.words)
    pairs = candidates(plain.text, plain.words, spans, frozenset())
    known = [(*n, True, True) for a, b, k in spans if k == "person" and all(n := parts(plain.text[a:b]))] + [x[2:] for x in pairs]
    given, family = Counter(), Counter()
    for g, f, tells, capital in known:
        given[g, tells] += capital
        family[f, tells] += capital
    of = lambda c, w: odds(c[w, True], c[w, True] + c[w, False]) if c[w, True] + c[w, False] else -math.inf
    names = [plain.back(a, b) for a, b, g, f, *_ in pairs if of(given, g) + of(family, f) + math.log(NAMES) > 0]
    return joined([(*plain.back(a, b), k) for a, b, k in spans], names)


def replace(source: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [source[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, source[at:]])


def joined(spans: list[tuple[int, int, str]], names: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans and those of names, which may overlap each other."""
    out = list(spans)
    last = -1
    for a, b in sorted(names):
        if a < last:
            out[-1] = (out[-1][0], max(b, last), "person")
        else:
            out.append((a, b, "person"))
        last = out[-1][1]
    return sorted(out)


def common_words(source: DataFrame) -> frozenset:
    """Words that are usual in lower case; at most 1 / COMMON."""

    def count():
        def run(texts):
            n: Counter = Counter()
            for t in texts:
                n.update(w for w in t.translate(BREAKS).split() if len(w) > 2)
            return list(n), list(n.values())

        return run

    words = map_lists(source.select("__text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.word for r in words.where((F.col("n") >= max(LEAST, COMMON * total)) & (F.col("word") == F.lower("word"))).select("word").collect())


def scanned(df: DataFrame, key: list[str], text: Column | str, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(seen, hits): the texts with the spans that tell themselves, and (__id, key columns, __a, __b) of names that the corpus tells."""
    source = df.select(*key, (F.col(text) if isinstance(text, str) else text).alias("__text")).where("__text is not null")
    kept = ", ".join(f"`{n}` {t}" for n, t in source.drop("__text").dtypes)
    common = source.sparkSession.sparkContext.broadcast(common_words(source))
    dicts = lambda names, rows: [dict(zip(names, r)) for r in rows]

    def look():
        def run(*cols):
            spans, pairs, titled = [], [], []
            for t in cols[-1]:
                plain = Plain(t)
                found = details(plain.text, plain.words)
                back = lambda a, b, *rest: (*plain.back(a, b), *rest)
                spans.append(dicts(("a", "b", "kind"), [back(*x) for x in found]))
                pairs.append(dicts(("a", "b", "given", "family", "told", "capital"), [back(*x) for x in candidates(plain.text, plain.words, found, common.value)]))
                titled.append(dicts(("given", "family"), {n for a, b, kind in found if kind == "person" and all(n := parts(plain.text[a:b]))}))
            return (*cols[:-1], [t if with_text else None for t in cols[-1]], spans, pairs, titled)

        return run

    schema = f"{kept}, __text string, __spans array<struct<a: int, b: int, kind: string>>, __pairs array<struct<a: int, b: int, given: string, family: string, told: boolean, capital: boolean>>, __titled array<struct<given: string, family: string>>"
    seen = cut(map_lists(source, look, schema).withColumn("__id", F.monotonically_increasing_id()))
    pairs = seen.select("__id", *key, F.explode("__pairs").alias("__p"))
    n = lambda c: F.sum(c.cast("bigint"))
    counted = pairs.select("__p.*").groupBy("given", "family").agg(n(F.col("told") & F.col("capital")).alias("told"), n(F.col("capital")).alias("n"))
    titled = seen.select(F.explode("__titled").alias("p")).select("p.*").groupBy("given", "family").agg(F.count("*").alias("told")).withColumn("n", F.col("told"))
    counted = cut(counted.unionByName(titled).groupBy("given", "family").agg(F.sum("told").alias("told"), F.sum("n").alias("n")))
    hit, miss = math.log(TOLD_NAMES / TOLD_OTHERS), math.log((1 - TOLD_NAMES) / (1 - TOLD_OTHERS))

    def learnt(word: str) -> DataFrame:
        """As odds()."""
        sums = counted.groupBy(word).agg(F.sum("told").alias("told"), F.sum("n").alias("n")).where("n > 0")
        return sums.select(word, F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("told") * hit + (F.col("n") - F.col("told")) * miss)).alias(f"odds_{word}"))

    names = counted.join(learnt("given"), "given").join(learnt("family"), "family").where(F.col("odds_given") + F.col("odds_family") + math.log(NAMES) > 0)
    pairs = pairs.select("__id", *key, *(F.col(f"__p.{x}").alias(f"__{x}") for x in ("a", "b", "given", "family")))
    hits = salted(pairs, names.select(F.col("given").alias("__given"), F.col("family").alias("__family")), ["__given", "__family"], "__id").select("__id", *key, "__a", "__b")
    return seen.drop("__pairs", "__titled"), hits


def kinds_found(df: DataFrame, key: list[str], text: Column | str = "text") -> DataFrame:
    """key columns, kind: distinct rows of each text and kind found in it."""
    seen, hits = scanned(df, key, text, with_text=False)
    return seen.select(*key, F.explode("__spans.kind").alias("kind")).unionByName(hits.select(*key, F.lit("person").alias("kind"))).distinct()


def personal(df: DataFrame, key: list[str], text: Column | str = "text") -> DataFrame:
    """key columns, text with placeholders, kinds: the sorted kinds found; only rows with text."""
    seen, hits = scanned(df, key, text, with_text=True)
    seen = seen.join(hits.groupBy("__id").agg(F.collect_list(F.struct(F.col("__a").alias("a"), F.col("__b").alias("b"))).alias("__names")), "__id", "left").drop("__id")
    kept = ", ".join(f"`{n}` {t}" for n, t in seen.select(*key).dtypes)

    def make():
        def run(*cols):
            *keys, texts, spans, names = cols
            found = [joined([(x["a"], x["b"], x["kind"]) for x in s], [(x["a"], x["b"]) for x in n or []]) for s, n in zip(spans, names)]
            return (*keys, [replace(t, s) for t, s in zip(texts, found)], [sorted({k for *_, k in s}) for s in found])

        return run

    return map_lists(seen, make, f"{kept}, text string, kinds array<string>")
