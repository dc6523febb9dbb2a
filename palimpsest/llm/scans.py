"""Problem 1: noise in text read from scanned pages.

A text is taken for a scan if its lines are broken where a page of one width would break them. A line at the edge of a
page (beside a page number or a gap, or where the text reads on without it) may be a running header or footer. Such lines
are compared fuzzily: words that few of them hold count as any word, and what remains must be repeated at the edges of
other pages, of the text itself or of other texts; a title beside a page number needs no more. Page numbers count by their form
(as in "p. 5" or "[5]"), or, if they are bare numbers, as sequences that rise from page to page. Words broken over two
lines are joined by what the corpus vocabulary knows: the joined word, the compound with a hyphen, or neither. Misread
characters are found in the vocabulary: a word that becomes a far more frequent one when a usual confusion of characters
is undone. What remains is put together into paragraphs.

Defined results: null gives null; texts that are no scans come back unchanged with no defects; repeated rows of one id
count once; line numbers count from 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.batches import map_lists
from palimpsest.operators.joins import salted
from palimpsest.session import cut, spread

TOKEN = re.compile(r"[^\W_](?:[^\W_|!]|\||!(?=[^\W_]))*(?:-[^\W_](?:[^\W_|!]|\||!(?=[^\W_]))*)*")
# Marks of broken words, forms of page numbers, words within and before titles, confusions of characters (read -> true).
SOFT = "­¬"
BROKEN = re.compile(rf"(?P<left>[^\W\d_]+)(?P<mark>[-‐{SOFT}])[ \t]*$")
_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})"
PAGE = rf"(?:- ?\d{{1,4}} ?-|– ?\d{{1,4}} ?–|\[\d{{1,4}}\]|(?i:p|pp|pag|pg)\. ?\d{{1,4}}|(?i:page|pagina) \d{{1,4}}(?: (?i:of|di) \d{{1,4}})?|\d{{1,4}}/\d{{1,4}}|\d{{1,4}}|{_ROMAN})"
#: A number alone may be anything, and one or two letters may be a word; with a sign or word of a page, or as a longer well-formed numeral, it is one.
BARE_NUMBER = re.compile(r"\d{1,4}|[ivxlc]{1,2}")
PAGE_LINE = re.compile(rf"\s*{PAGE}\s*")
PAGE_END = re.compile(rf"\s{{2,}}({PAGE})\s*$")
PAGE_START = re.compile(rf"^\s*({PAGE})\s{{2,}}(?=\S)")
CONNECT = set("of on in at to the a an and or for by with di del della dei delle da e il la lo le gli i un una su per con vol no n".split())
OPENERS = {"between", "per", "secondo", "tra", "fra", "with", "by", "for"}
CONFUSED = [("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("c", "e"), ("e", "c"), ("cl", "d"), ("rn", "m"), ("ri", "n"), ("li", "h"), ("ii", "n"), ("ii", "u"), ("vv", "w"), ("tl", "h"), ("in", "m"), ("nn", "m"), ("d", "cl"), ("m", "rn"), ("h", "li"), ("f", "t"), ("y", "v")]
#: A word of letters alone is a misreading if the other word is so many times as frequent; with signs or digits in it, fewer will do.
RATIO, RATIO_SIGNS, LEAST = 20, 2, 3
#: Words of at least this share of the lines at page edges count in their comparison, so at most the words of a line by EDGE_SHARE do.
EDGE_SHARE, EDGE_LEAST = 0.02, 2
#: Bare numbers of following pages rise by at most this.
PAGE_STEP = 3
#: Two edge lines of one text are the same header from this share of equal words on.
SAME_LINE = 0.6


def words(text: str) -> list[str]:
    """Lower-case tokens, compounds with hyphens whole and in parts."""
    out = []
    for w in TOKEN.findall(text.lower()):
        out.append(w)
        if "-" in w:
            out += w.split("-")
    return out


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def is_number(line: str) -> bool:
    return bool(PAGE_LINE.fullmatch(line))


def close(line: str) -> bool:
    return line.rstrip(" \t\"'”’)»").endswith((".", "!", "?", ":", "…"))


def unspaced(line: str) -> str:
    """Letter-spaced lines as words."""
    s = line.strip()
    if re.fullmatch(r"(?:\S {1,1}){3,}\S(?:\s{2,}(?:\S ?)+)*", s) or re.fullmatch(r"(?:\S(?: \S)*)(?:\s{3}\S(?: \S)*)+", s) and sum(len(x) == 1 for x in s.split()) > 0.8 * len(s.split()):
        s = re.sub(r"\s+", " ", re.sub(r"(?<=\S) (?=\S)", "", s))
    return s


def edge_words(line: str) -> list[str]:
    """The words of a line as compared: in lower case, numbers as #."""
    return ["#" if w.isdigit() else w for w in re.findall(r"[^\W\d_]+|\||—|\d+", unspaced(line).lower())]


def title(line: str) -> bool:
    """Does the line look like a title: capitalised but for connectives, no sentence?"""
    s = unspaced(line)
    if close(s) or s.endswith((",", ";", "-", "‐", *SOFT)):
        return False
    found = re.findall(r"[^\W\d_]+|\||—|\d+", s)
    names = [w for w in found if w[0].isalpha() and w.lower() not in CONNECT]
    if not names or not all(w[0].isupper() for w in names) or found[-1].lower() in CONNECT or found[0].lower() in OPENERS:
        return False
    return not sentence_ends(s) and bool(re.fullmatch(r"[\w\s|—–.,'’&:()-]+", s))


def sentence_ends(line: str) -> bool:
    return bool(re.search(r"[.!?;:]\s", re.sub(r"(?i)\b(?:vol|no|n)\.", "", line)))


def value(number: str) -> tuple[str, int]:
    """Style and value of a page number."""
    digits = re.search(r"\d+", number)
    if digits:
        return re.sub(r"\d+", "#", number.strip(), count=1), int(digits[0])
    one = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    parts = [one[c] for c in number.strip().lower() if c in one]
    return "roman", sum(-x if x < y else x for x, y in zip(parts, [*parts[1:], 0]))


def rising(marks: list[tuple[int, str]]) -> set[int]:
    """Of (line, number) marks in order of their lines those that count as page numbers.

    Marks that can be nothing else do. Bare ones must be part of the longest sequence of their style that rises by at
    most PAGE_STEP from one to the next; a single one of its style stands for its page.
    """
    out = {i for i, x in marks if not BARE_NUMBER.fullmatch(x.strip())}
    by_style: dict[str, list[tuple[int, int]]] = {}
    for i, x in marks:
        if i not in out:
            style, n = value(x)
            by_style.setdefault(style, []).append((i, n))
    for found in by_style.values():
        best: list[list[int]] = []
        for j, (i, n) in enumerate(found):
            before = [best[h] for h in range(j) if 0 < n - found[h][1] <= PAGE_STEP]
            best.append([*max(before, key=len, default=[]), i])
        longest = max(best, key=len)
        out |= set(longest if len(longest) > 1 or len(found) == 1 else [])
    return out


def bare(line: str) -> str:
    """Without a page number at either end."""
    return PAGE_START.sub("", PAGE_END.sub("", line))


def width_of(lines: list[str]) -> int:
    """Length of the longest line of text; 0 for fewer than two lines."""
    full = [len(x.rstrip()) for x in lines if x.strip() and not is_number(x) and not title(bare(x))]
    return max(full) if len(full) > 1 else 0


def is_scan(lines: list[str]) -> bool:
    """Are lines broken where the next word no longer fitted?"""
    body = [x.rstrip() for x in lines]
    width = width_of(lines)
    if width < 2:
        return False
    wraps = breaks = 0
    for x, y in zip(body, body[1:]):
        if x.strip() and y.strip() and not is_number(x) and not is_number(y):
            first = y.split()[0]
            breaks += 1
            wraps += len(x) + 1 + len(first) > width - 1 and not x.startswith((" ", "\t", "-", "*", "|", "```")) and " " in x.strip()
    if not wraps or wraps < 0.5 * breaks:
        return False
    return any(x.strip() and y.strip() and not close(x) and y.lstrip()[0].islower() for x, y in zip(body, body[1:])) or any(BROKEN.search(x) for x in body[:-1])


def repeats(lines: dict[int, frozenset]) -> set[int]:
    """The lines of which another one has at least SAME_LINE of the words of both.

    Equal lines are told at once. Of others, those that are alike enough share one of the rarest words that each has beyond
    what may differ, so only lines that meet there are compared.
    """
    of: dict[frozenset, list[int]] = {}
    for i, w in lines.items():
        of.setdefault(w, []).append(i)
    out = {i for found in of.values() if len(found) > 1 for i in found}
    n = Counter(w for words_ in of for w in words_)
    met: dict[str, list[frozenset]] = {}
    for words_ in of:
        rare = sorted(words_, key=lambda w: (n[w], w))
        for w in rare[: len(rare) - math.ceil(SAME_LINE * len(rare)) + 1]:
            for other in met.get(w, ()):
                if len(words_ & other) >= SAME_LINE * len(words_ | other):
                    out.update(of[words_], of[other])
            met.setdefault(w, []).append(words_)
    return out


class Page:
    """A scan's lines with what each is: text, blank, number, or what may be a header."""

    def __init__(self, text: str):
        self.lines = lines_of(text)
        self.width = width_of(self.lines)
        self.heads: dict[int, bool] = {}  # line at a page edge that may be a header -> a title beside a page number, or repeated here
        marks = [(i, x.strip()) for i, x in enumerate(self.lines) if x.strip() and is_number(x) and not self.inside(i)]
        ends = [(i, (PAGE_END.search(x) or PAGE_START.search(x))[1]) for i, x in enumerate(self.lines) if x.strip() and bare(x) != x and title(bare(x))]
        kept = rising(sorted(marks + ends))
        self.numbers = {i for i, _ in marks if i in kept}
        self.attached = {i for i, _ in ends if i in kept}  # headers with a page number in the line
        lines = {i: bare(x) if i in self.attached else x for i, x in enumerate(self.lines) if x.strip() and i not in self.numbers}
        titles = {i for i, x in lines.items() if title(x)}
        # Titles beside page numbers first, so that the text around the others is known.
        certain = self.attached | {i for i in titles if any(self.step(i, d) in self.numbers for d in (-1, 1))}
        self.heads = dict.fromkeys(sorted(self.attached), True)
        for i in sorted(titles, key=lambda i: (i not in certain, i)):
            if i not in self.heads and self.goes_on(i):
                self.heads[i] = i in certain
        for i, x in lines.items():
            if i not in titles and self.short(i) and not close(x) and not sentence_ends(x) and len(edge_words(x)) > 1 and not x.lstrip().startswith(("-", "*", "|", "`", "#")) and not BROKEN.search(x) and self.goes_on(i):
                self.heads[i] = False
        for i in repeats({i: frozenset(edge_words(lines[i])) for i in self.heads}):
            self.heads[i] = True

    def short(self, i: int) -> bool:
        """Is the line at a gap or an edge of the text, and not broken by the page's width?"""
        gap = i == 0 or i + 1 == len(self.lines) or not self.lines[i - 1].strip() or not self.lines[i + 1].strip()
        after = self.text_at(i, 1)
        return gap and (after is None or len(self.lines[i].rstrip()) + 1 + len(after.split()[0]) < self.width - 1)

    def inside(self, i: int) -> bool:
        """A number of one line that belongs to a list or table: its neighbours are numbers too."""
        return all(0 <= j < len(self.lines) and self.lines[j].strip() and is_number(self.lines[j]) for j in (i - 1, i + 1))

    def step(self, i: int, d: int) -> int:
        j = i + d
        while 0 <= j < len(self.lines) and not self.lines[j].strip():
            j += d
        return j

    def text_at(self, i: int, d: int) -> str | None:
        """The next line of text before or after i, past blanks, numbers and known headers."""
        j = i + d
        while 0 <= j < len(self.lines) and (not self.lines[j].strip() or j in self.numbers or j in self.heads):
            j += d
        return self.lines[j].strip() if 0 <= j < len(self.lines) else None

    def goes_on(self, i: int) -> bool:
        """Does the text read on without the line? Either in the middle of a sentence or between two."""
        before, after = self.text_at(i, -1), self.text_at(i, 1)
        if after is None:
            return before is not None and (close(before) or self.step(i, -1) in self.numbers)
        if before is None or close(before):
            return not after[0].islower()
        if i + 1 < len(self.lines) and self.lines[i + 1].strip() and len(self.lines[i].rstrip()) + 1 + len(self.lines[i + 1].split()[0]) < self.width - 1:
            return True  # a page of this width would not have broken the line here
        return after[0].islower() or (not self.lines[i - 1].strip() or i + 1 < len(self.lines) and not self.lines[i + 1].strip())

    def broken(self, heads: set[int]) -> list[tuple[int, int, str, str, str]]:
        """(line, next line, left, right, mark) of words broken at line ends."""
        skip = self.numbers | heads
        body = [i for i, x in enumerate(self.lines) if x.strip() and i not in skip]
        out = []
        for i, j in zip(body, body[1:]):
            m = BROKEN.search(self.lines[i])
            r = re.match(r"\s*([^\W\d_]+)", self.lines[j])
            if m and r and (r[1][0].islower() or m["left"].isupper()):
                out.append((i, j, m["left"], r[1], m["mark"]))
        return out


def evidence(text: str) -> list[tuple[str, int, str, str, bool]]:
    """(kind, line, a, b, sure): what may be wrong; what isn't sure needs the corpus."""
    lines = lines_of(text)
    if not is_scan(lines):
        return []
    page = Page(text)
    out = [("page_no", i, "", "", True) for i in page.numbers | page.attached]
    out += [("header", i, " ".join(edge_words(bare(page.lines[i]) if i in page.attached else page.lines[i])), "title" if title(bare(page.lines[i])) else "", sure) for i, sure in page.heads.items()]
    broken = page.broken({i for i, sure in page.heads.items() if sure or title(page.lines[i])})
    out += [("hyphen", i, a.lower(), b.lower(), mark in SOFT) for i, _, a, b, mark in broken]
    parts = {a.lower() for _, _, a, _, _ in broken} | {b.lower() for _, _, _, b, _ in broken}
    seen = set()
    for i, x in enumerate(page.lines):
        if i not in page.numbers and not (i in page.heads and title(x)):
            for w in TOKEN.findall(x.lower()):
                seen |= set(w.split("-"))
    seen |= {a.lower() + b.lower() for _, _, a, b, _ in broken}
    out += [("word", -1, w, "", False) for w in seen - parts if len(w) > 2]
    return out


def corrections(word: str) -> set[str]:
    """Words that a usual confusion, at one or two places, turns into the given one."""
    once = set()
    signs = any(not c.isalpha() for c in word)
    for read, true in CONFUSED:
        at = word.find(read)
        while at >= 0:
            once.add(word[:at] + true + word[at + len(read) :])
            at = word.find(read, at + 1)
    plain = unicodedata.normalize("NFKC", word)
    out = once | ({plain} if plain != word else set())
    if signs:
        for w in once:
            if any(not c.isalpha() for c in w):
                for read, true in CONFUSED[:11]:
                    at = w.find(read)
                    if at >= 0:
                        out.add(w[:at] + true + w[at + len(read) :])
    return {w for w in out if w != word and w.isalpha()}


def misread(vocab: DataFrame) -> DataFrame:
    """word, right: words that are probably misread, and what they should be."""

    def make():
        def run(ws, ns):
            rows = [(w, n, c) for w, n in zip(ws, ns) if len(w) > 2 and "-" not in w and sum(x.isalpha() for x in w) > 1 for c in corrections(w)]
            return list(zip(*rows)) or [()] * 3

        return run

    tried = map_lists(vocab.select("word", "n"), make, "word string, n bigint, right string")
    known = vocab.select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    ratio = F.when(F.col("word").rlike(r"^\p{L}+$"), RATIO).otherwise(RATIO_SIGNS)
    likely = tried.join(known, "right").where((F.col("n_right") >= LEAST) & (F.col("n_right") >= ratio * F.col("n")))
    return likely.groupBy("word").agg(F.max_by("right", F.struct("n_right", "right")).alias("right"))


def repeated(heads: DataFrame) -> DataFrame:
    """key, line of the edge lines (key, line, a: their words, b, sure) that are headers: sure ones, and those repeated fuzzily in other texts.

    Words that few edge lines hold count as any word. A title must keep a word, another line two and half of its words.
    """
    lines = heads.select("key", "a").distinct()
    n = lines.count()
    each = lines.select("key", F.explode(F.array_distinct(F.split("a", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    kept = [r.word for r in each.where(F.col("n") >= max(EDGE_LEAST, EDGE_SHARE * n)).select("word").collect()]  # at most the words of a line / EDGE_SHARE
    known = heads.sparkSession.sparkContext.broadcast(frozenset(kept))

    def shape():
        def run(keys, numbers, lines, titles, sure):
            shapes, enough = [], []
            for x, t in zip(lines, titles):
                words_ = x.split(" ")
                held = [w if w in known.value else "*" for w in words_]
                n = len([w for w in held if w.isalpha()])
                shapes.append(re.sub(r"\*( \*)+", "*", " ".join(held)))
                enough.append(n > 0 if t else n > 1 and 2 * n >= len(held))
            return keys, numbers, shapes, enough, sure

        return run

    kind = dict(heads.dtypes)["key"]
    shaped = cut(map_lists(heads.select("key", "line", "a", "b", "sure"), shape, f"key {kind}, line int, shape string, enough boolean, sure boolean"))
    often = shaped.where("enough").groupBy("shape").agg(F.count_distinct("key").alias("texts")).where("texts > 1").select("shape")
    by_repetition = salted(shaped.where("enough and not sure"), often, "shape", "key").select("key", "line")
    return shaped.where("sure").select("key", "line").unionByName(by_repetition)


def defects(df: DataFrame, key: str = "message_id", text: str = "text") -> DataFrame:
    """key, kind (page_no, header, hyphen, compound, glyph), line, a, b: every defect; compound: a break at a hyphen that stays."""
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and key is not null")).dropDuplicates(["key"])

    def make():
        def run(keys, texts):
            out = [(k, *e, 0) for k, t in zip(keys, texts) for e in evidence(t)]
            out += [(None, "count", -1, w, "", True, n) for w, n in Counter(w for t in texts for w in words(t)).items()]
            return list(zip(*out)) or [()] * 7

        return run

    found = cut(map_lists(rows, make, f"key {dict(rows.dtypes)['key']}, kind string, line int, a string, b string, sure boolean, n bigint"))
    vocab = cut(found.where("kind = 'count'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")))
    heads = repeated(found.where("kind = 'header'"))
    # Each kind of broken word is looked up once: its parts, joined and with a hyphen.
    broken = found.where("kind = 'hyphen'")
    kinds = broken.select("a", "b").distinct()
    forms = F.array(*(F.struct(F.lit(n).alias("form"), c.alias("word")) for n, c in (("joined", F.concat("a", "b")), ("compound", F.concat_ws("-", "a", "b")), ("left", F.col("a")), ("right", F.col("b")))))
    looked = salted(kinds.select("a", "b", F.explode(forms).alias("f")).select("a", "b", "f.*"), vocab, "word", "b")
    n = lambda form: F.coalesce(F.max(F.when(F.col("form") == form, F.col("n"))), F.lit(0)).alias(f"n_{form}")
    known = looked.groupBy("a", "b").agg(*(n(form) for form in ("joined", "compound", "left", "right")))
    stays = (F.col("n_compound") > F.col("n_joined")) | ((F.col("n_joined") == 0) & (F.col("n_left") > 4) & (F.col("n_right") > 4) & (F.length("a") > 2) & (F.length("b") > 2))
    broken = broken.join(known.where(stays).select("a", "b", F.lit(True).alias("stays")), ["a", "b"], "left")
    broken = broken.withColumn("kind", F.when(~F.col("sure") & F.col("stays"), "compound").otherwise("hyphen"))
    wrong = salted(found.where("kind = 'word'").select("key", "line", F.col("a").alias("word")), misread(vocab), "word", "key").select("key", F.lit("glyph").alias("kind"), "line", F.col("word").alias("a"), F.col("right").alias("b"))
    fields = ["key", "kind", "line", "a", "b"]
    out = found.where("kind = 'page_no'").select(fields).unionByName(heads.select("key", F.lit("header").alias("kind"), "line", F.lit("").alias("a"), F.lit("").alias("b"))).unionByName(broken.select(fields)).unionByName(wrong)
    return out.withColumnRenamed("key", key)


def same_case(right: str, like: str) -> str:
    return right.upper() if like.isupper() and len(like) > 1 else right.capitalize() if like[:1].isupper() else right


def repair(text: str, heads: set[int], compounds: set[int], right: dict[str, str]) -> str:
    """The text as paragraphs, without headers, page numbers, broken and misread words."""
    page = Page(text)
    heads |= page.attached
    skip = page.numbers | heads
    joined = {i: (j, mark) for i, j, _, _, mark in page.broken(heads)}

    def words_of(x: str) -> str:
        def fix(m: re.Match) -> str:
            return "-".join(same_case(right[p.lower()], p) if p.lower() in right else p for p in m[0].split("-"))

        return TOKEN.sub(fix, x) if right else x

    paragraphs: list[str] = []
    now, glue, gap = "", "", False
    for i, x in enumerate(page.lines):
        if i in skip:
            continue
        if not x.strip():
            gap = True
            continue
        if gap and now and close(now) or gap and not any(k in skip for k in range(i)) and now:
            paragraphs.append(now)
            now, glue = "", ""
        gap = False
        s = x.strip()
        now = f"{now}{glue}{s}" if now else s
        glue = " "
        if i in joined:
            now = re.sub(rf"[-‐{SOFT}][ \t]*$", "-" if i in compounds else "", now)
            glue = ""
    if now:
        paragraphs.append(now)
    return "\n\n".join(words_of(p) for p in paragraphs)


def repaired(df: DataFrame, key: str = "message_id", text: str = "text") -> DataFrame:
    """key, text, n_defects: every text, scans repaired."""
    found = defects(df, key, text)
    pick = lambda kind, value: F.collect_set(F.when(F.col("kind") == kind, value))
    by_text = found.groupBy(key).agg(
        F.count_if(F.col("kind") != "compound").cast("int").alias("n_defects"), F.count("*").alias("n"), pick("header", F.col("line")).alias("heads"),
        pick("compound", F.col("line")).alias("compounds"), pick("glyph", F.struct("a", "b")).alias("glyphs"),
    )
    rows = df.select(key, text).dropDuplicates([key]).join(by_text, key, "left")

    def make():
        def run(keys, texts, n, found, heads, compounds, glyphs):
            out = [t if t is None or not f else repair(t, set(h), set(c), {g["a"]: g["b"] for g in gs}) for t, f, h, c, gs in zip(texts, found, heads, compounds, glyphs)]
            return keys, out, [x or 0 for x in n]

        return run

    return map_lists(rows, make, f"`{key}` {dict(df.dtypes)[key]}, text string, n_defects int")
