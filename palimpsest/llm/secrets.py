"""Problem 3: credentials in source code and configuration.

Every detection rule is a regular expression. What trigrams a text must hold to match it is derived from its parse tree:
a conjunction of alternatives of literals, small character classes and line ends included, and no rule goes without.
The texts (files, and chunks of files) get a stored trigram index: segments of postings, for the trigrams that some rule
requires. Postings are united and intersected as each rule demands, segment by segment without a shuffle, and only texts
that remain are fetched by a join and searched, each with the rules that it may match.

Defined results: null and empty texts hold nothing; lines count from 1 and end at LF; repeated rows repeat; redaction
keeps every line and every character outside the values, and redacting twice changes nothing more.
"""

from __future__ import annotations

import re
from re import _parser as parser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.batches import map_lists
from palimpsest.operators.joins import salted
from palimpsest.session import cut

# Names under which credentials stand, forms of keys of public issuers, characters of values.
NAME = r"(?:passw(?:or)?d|pass_?phrase|(?:db|user|root|admin)_?pass|pwd|secret|secret_?key|token|api_?key|access_?key|auth|credentials?|signing_?key|private_?key)"
ISSUED = [
    r"\b(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}",
    r"\bglpat-[A-Za-z0-9_-]{20,}",
    r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}",
    r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"\bwhsec_[A-Za-z0-9+/=]{24,}",
    r"\bAIza[A-Za-z0-9_-]{35}",
    r"\bya29\.[A-Za-z0-9_-]{20,}",
    r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"\bnpm_[A-Za-z0-9]{36}",
    r"\bpypi-[A-Za-z0-9_-]{32,}",
    r"\bdop_v1_[a-f0-9]{64}",
    r"\bhf_[A-Za-z0-9]{30,}",
    r"\bshp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}",
    r"\bsk-(?:proj-)?[A-Za-z0-9_-]{32,}",
    r"\bkey-[a-f0-9]{32}\b",
    r"\beyJ[A-Za-z0-9_-]{12,}(?:\.[A-Za-z0-9_-]{6,})*",
]
VALUE = r"[!#-&(-_a-~]"  # printable, no quotes, no blanks
Q = "[\"'`]"

#: kind -> expression with the group v.
RULES: dict[str, str] = {
    "issued": rf"(?P<v>{'|'.join(ISSUED)})",
    # a short name of the issuer or kind before a long random part
    "prefixed": r"(?<![\w./+-])(?P<v>[A-Za-z][A-Za-z0-9]{1,5}(?:_[a-z]{2,4})?[_.-][A-Za-z0-9_-]{16,})(?![\w./+=-])",
    "quoted": rf"(?i){NAME}[\"'\]]*\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}(?P<q>[\"'`])(?P<v>[^\"'`\s]{{6,}})(?P=q)",
    "plain": rf"(?im){NAME}[ \t]?[:=][ \t]?(?P<v>[^\s\"'`<>,;(){{}}\[\]$][^\s\"'`<>,;(){{}}\[\]]{{5,}})[ \t]*(?:\r?$|[#;])",
    "element": rf"(?i)<(?P<q>[\w.-]*{NAME})>\s*(?P<v>[^<\s]{{6,}})\s*</",
    "attribute": rf"(?i)(?:name|key|id)=[\"'][\w.-]*{NAME}[\"']\s+value=[\"'](?P<v>[^\"'\s]{{6,}})[\"']",
    "column": rf"(?i)['\"][\w.-]*{NAME}['\"]\s*,\s*['\"](?P<v>[^'\"\s]{{6,}})['\"]",
    "sql": r"(?i)(?:password|identified\s+by)\s+(?:is\s+)?'(?P<v>[^'\s]{6,})'",
    "url": r"://[^\s/:@\"'<>]*:(?P<v>[^\s@\"'<>]{4,})@",
    "parameter": rf"(?i)[?&]{NAME}=(?P<v>[^\s&\"'<>#]{{6,}})",
    "header": r"(?i)(?:\b(?:bearer|basic)[ \t]+|x-[a-z-]*(?:key|token|auth)\s*[:=]\s*[\"']?|authorization\s*:\s*(?!bearer|basic))(?P<v>[^\s\"'`<>]{6,})",
    "option": rf"(?i)--(?:[\w-]{{0,24}}[_-])?(?:{NAME}|pass|key)[ =][\"']?(?P<v>[^\s\"'`]{{6,}})",
    "user": r"(?m)(?:^|[ \t])(?:-u|--user)[ =]?[\"']?[\w.-]+:(?P<v>[^\s\"'`]{6,})",
    "attached": r"[ \t]-u[ ]?[\w.-]+\s+(?:-\w+\s+)*-p(?P<v>[^\s\"'`]{6,})",
    "argument": r"(?i)\b\w*(?:connect|login|auth|client|session|open|sign)\w*\(\s*(?:[\"'][^\"'\n]*[\"']\s*,\s*){1,4}[\"'](?P<v>[^\"'\s]{6,})[\"']",
    "noted": r"(?i)[:=][ \t]*[\"'](?P<v>[^\"'\s]{6,})[\"'][;,]?[ \t]*(?://|#|--|/\*).*\b(?:auth|login|unseal|vault|token|password|secret|signing|credential)\b",
    "dated": r"(?im)(?://|#|--|/\*|<!--)[^\n\"'=]*?\b(?:works? with|log in with|sign in with|try|use)[ \t]+(?P<v>[^\s\"'`<>()]{8,})(?=[ \t,])[^\n]*\b(?:until|rotate|expires|temporary|for now)\b",
    "comment": rf"(?im)(?://|\#|--|/\*|<!--|\(|\*)[^\n\"'=]*?(?:\b(?:logins?|console|vault|previous value|todo remove|staging|{NAME})\b|\b(?:box|until [a-z]+):)[^\n\"'=]*?[ \t/:](?P<v>[^\s\"'`<>()]{{8,}})[ \t]*(?:\*/|-->|\))?[ \t]*\r?$",
    # any literal that is given to a name and looks random: the value itself tells
    "assigned": rf"(?m)[=:] ?{Q}(?P<v>{VALUE}{{20,}}){Q}",
    "key block": r"-----(?:BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----",
    "folded": rf"(?im){NAME}[\"']?[ \t]*:[ \t]*[>|][+-]?[ \t]*\r?\n",
    "joined": rf"[=:][ \t]*[\"'](?P<a>{VALUE}{{4,}})[\"'](?: ?[+\\.] ?| ?)\r?\n(?:[ \t]*\r?\n)?[ \t]*[+.]?[ \t]*[\"'](?P<b>{VALUE}{{2,}})[\"']",
}
#: Rules of chunks, which may be cut within a value or a key block.
CUT_RULES: dict[str, str] = {
    "cut off": rf"[=:][ \t]*[\"'](?P<v>{VALUE}{{12,}})[\"'] ?[+\\][ \t]*\r?\n?\Z",
    "cut element": rf"(?i)<[\w.-]*{NAME}>\s*(?P<v>[^<\s]{{6,}})\s*\Z",
    "brought over element": rf"(?i)\A\[FILE: [^\n]*\n\s*(?P<v>[^<\s]{{6,}})\s*</[\w.-]*{NAME}>",
    "brought over": rf"\A\[FILE: [^\n]*\n[ \t]*[\"'](?P<v>{VALUE}{{6,}})[\"'];?[ \t]*\r?(?:\n|\Z)",
    "bare key": r"(?m)^[ \t]*(?:[#*/\"'][ \t]*)?[A-Za-z0-9+/]{64}\r?$",
}
BLOCK = re.compile(RULES["key block"])
BODY = re.compile(r"[ \t]*(?:(?://|#|\*|\"|')[ \t]*)?[A-Za-z0-9+/]{32,80}={0,2}(?:\\n)?[\"']?[ \t]*[+,\\]?\r?")
SHORT = re.compile(r"[ \t]*[A-Za-z0-9+/]{2,}={0,2}\r?")
BARE = re.compile(r"[ \t]*(?:[#*/\"'][ \t]*)?[A-Za-z0-9+/]{64}\r?")
#: Words before a value that say that it is no credential, and names whose value is a secret whatever it looks like.
PUBLIC = re.compile(r"(?i)(?:sha\d*|sum|commit|trace|hash|integrity|digest|etag|nonce|fingerprint|public\w*|revision|\brev|build|version|uuid|guid|span|request|correlation)[\w-]*[\"'\]]*\s*$")
PASSWORD = re.compile(r"(?i)(?:passw(?:or)?d|pass_?phrase|pass|pwd|identified\s+by)[\"'\]]*(?:\s*(?::=|=>|[:=,>])\s*|\s+(?:is\s+)?)[\"'`]?$")

NO_VALUE = re.compile(r"(?i)^(?:[x*.#_-]+|todo|tbd|\[?redacted\]?|none|null|true|false|change_?me.*|example.*|dummy.*|placeholder.*|your[_-].*|my[_-].*|insert[_-].*|<.*|\$.*|%.*|\{.*|@.*|\w+\(.*|(?:os|process|env|system|config|settings|vault|secrets)[.:\[].*|.*\$\{.*|.*\{\{.*|\d{1,7}|\d+[./]\d.*)$")


def literal(value: str, secret: bool = False) -> bool:
    """A value that may be a credential, not a placeholder, reference or plain word. secret: its name is a password's, so letters alone will do."""
    if len(value) < 6 or NO_VALUE.match(value) or len(set(value)) < 5:
        return False
    return any(c.isalpha() for c in value) and (secret and value[0] not in "/.:<&" or any(c.isdigit() for c in value) or scrambled(value))


def scrambled(value: str) -> bool:
    """Letters of both cases as if drawn: capitals stand next to each other, as they don't in names of several words."""
    letters = [c for c in value if c.isalpha()]
    capitals = sum(c.isupper() for c in letters)
    together = sum(x.isupper() and y.isupper() for x, y in zip(letters, letters[1:]))
    return len(letters) >= 16 and min(capitals, len(letters) - capitals) >= 0.15 * len(letters) and together >= 2 and sum(x.isupper() != y.isupper() for x, y in zip(letters, letters[1:])) >= 0.3 * len(letters)


def random_like(value: str) -> bool:
    """For places that tell nothing by themselves: digits and letters in one token that is no word, path, time or version."""
    return literal(value) and len(value) >= 8 and not re.match(r"(?i)^(?:[a-z]+://|\d{4}-\d\d|v?\d+(?:\.\d+)+|[0-9a-f]{8}-[0-9a-f]{4}-|sha\d+[-:]|\w+\.(?:py|js|ts|go|java|sql|sh|css|html|json|ya?ml|xml|md|txt|idl|tgz|zip)\b)", value) and not re.match(r"^[\d.,:%/-]+[a-z]{0,3}$", value)


#: A random value of more characters than this is data, if nothing but its look speaks for a credential.
LONGEST = 256


def drawn(value: str) -> bool:
    """Letters of both cases and digits, changing between them as often as drawn ones do; no hexadecimal number, no words."""
    kinds = ["A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "." for c in value]
    core = [k for k in kinds if k != "."]
    if not 16 <= len(core) or len(kinds) > LONGEST or len(core) < 0.9 * len(kinds) or not {"A", "a", "0"} <= set(core) or not random_like(value):
        return False
    changes = sum(x != y for x, y in zip(core, core[1:]))
    return changes >= 0.4 * len(core) and len(set(value.lower())) >= 10


def required(pattern: str, most: int = 6000) -> list[set[str]]:
    """Clauses, each a set of literals of at least three characters, in lower case: a match holds one of every clause."""

    def long(exact: set[str]) -> list[set[str]]:
        return [exact] if exact and all(len(x) >= 3 for x in exact) else []

    def members(items) -> set[str] | None:
        """The characters of a class, if they are few: of negated ones nothing is known."""
        out: set[str] = set()
        for op, arg in items:
            if str(op) == "LITERAL":
                out.add(chr(arg).lower())
            elif str(op) == "RANGE" and arg[1] < 128:
                out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            elif str(op) == "CATEGORY" and str(arg) == "CATEGORY_DIGIT":
                out |= set("0123456789")
            else:
                return None
        return out

    def cross(a: set[str], b: set[str]) -> set[str] | None:
        return {x + y for x in a for y in b} if len(a) * len(b) <= most else None

    def flat(items):
        """Groups are sequences within the sequence."""
        for op, arg in items:
            if str(op) == "SUBPATTERN":
                yield from flat(arg[3])
            else:
                yield op, arg

    def walk(items) -> tuple[set[str] | None, list[set[str]]]:
        """(all strings that it can be, or None; clauses)."""
        now: set[str] = {""}
        clauses: list[set[str]] = []
        whole = True

        def stop():
            nonlocal now, whole
            clauses.extend(long(now))
            now, whole = {""}, False

        for op, arg in flat(items):
            name, exact, inner, after = str(op), None, [], None
            if name == "LITERAL":
                exact = {chr(arg).lower()}
            elif name == "IN":
                exact = members(arg)
            elif name == "BRANCH":
                parts = [walk(x) for x in arg[1]]
                if all(e is not None for e, _ in parts):
                    exact = set().union(*(e for e, _ in parts))
                else:
                    best = [max([*c, *long(e or set())], key=lambda x: min(map(len, x)), default=None) for e, c in parts]
                    if all(best):
                        inner = [set().union(*best)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, sub = arg
                e, c = walk(sub)
                if e is not None and high == 1:
                    exact = e | {""} if low == 0 else e
                elif low:  # what stands before meets the first, what follows the last
                    twice = cross(e, e) if e is not None and low > 1 else None
                    first = twice and cross(now, twice) or (cross(now, e) if e is not None else None)
                    inner, after = c + long(first or set()) + long(e or set()), e
                    if twice and len(twice) * 3 < most:
                        after = twice
            elif name == "AT":
                edge = str(arg).startswith("AT_END") or str(arg).startswith("AT_BEGINNING") and not any(now - {""})
                exact = {"\n"} if edge and not str(arg).endswith("STRING") else {""}
            elif name in ("ASSERT", "ASSERT_NOT"):
                exact = {""}
            joined = cross(now, exact) if exact is not None else None
            if joined is not None:
                now = joined
            else:
                stop()
                clauses.extend(inner)
                clauses.extend(long(exact or set()))
                now = after or {""}
        clauses.extend(long(now) if not whole else [])
        return (now if whole else None), clauses

    exact, clauses = walk(parser.parse(pattern))
    return clauses + (long(exact) if exact else [])


class Index:
    """Inverted index of texts by the trigrams that some rule requires.

    A segment is the postings of some texts: for each trigram the ordinals of the texts that hold it. Texts stand in lower
    case between line breaks, so that the start and the end of a line are characters too.
    """

    def __init__(self, rules: dict[str, str]):
        clauses = {k: required(p) for k, p in rules.items()}
        if bad := [k for k, c in clauses.items() if not c]:
            raise ValueError(f"no trigram is required by {bad}")
        grams = sorted({g for cs in clauses.values() for c in cs for x in c for g in self.grams(x)})
        place = {g: i for i, g in enumerate(grams, 1)}
        self.n = len(grams) + 1
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in place.items():
            self.table[int.from_bytes(g, "big")] = i
        # Of each rule's clauses the trigrams any of which will do, and longer literals of which all trigrams are needed.
        self.clauses = {k: [(np.array([place[x.encode()] for x in c if len(x) == 3], int), self.rows([[place[g] for g in self.grams(x)] for x in c if len(x) > 3])) for c in cs] for k, cs in clauses.items()}

    @staticmethod
    def rows(lists: list[list[int]]) -> np.ndarray:
        """As a matrix, short rows filled up with their first."""
        most = max(map(len, lists), default=1)
        return np.array([x + x[:1] * (most - len(x)) for x in lists], int).reshape(-1, most)

    @staticmethod
    def grams(x: str) -> list[bytes]:
        b = x.encode()
        return sorted({b[i : i + 3] for i in range(len(b) - 2)})

    def segment(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ordinals): the texts that hold trigram g are ordinals[starts[g]:starts[g + 1]]."""
        blobs = [f"\n{t.lower()}\n".encode() for t in texts]
        ends = np.cumsum([len(b) + 3 for b in blobs])
        data = np.frombuffer(b"\0\0\0".join([*blobs, b""]), np.uint8)
        codes = data[:-2].astype(np.int32)
        codes <<= 8
        codes |= data[1:-1]
        codes <<= 8
        codes |= data[2:]
        grams = self.table[codes]
        at = np.flatnonzero(grams)
        kind = np.uint32 if self.n * len(texts) < 1 << 32 else np.uint64
        pairs = np.sort(grams[at].astype(kind) * kind(len(texts)) + np.repeat(np.arange(len(texts), dtype=kind), np.diff(np.searchsorted(at, ends), prepend=0)))
        pairs = pairs[np.diff(pairs, prepend=kind(self.n * len(texts))) != 0]
        return np.searchsorted(pairs, np.arange(self.n + 1, dtype=kind) * kind(len(texts))).astype(np.int32), (pairs % kind(max(1, len(texts)))).astype(np.int32)

    def candidates(self, texts: list[str]) -> dict[str, np.ndarray]:
        return self.search(*self.segment(texts), len(texts))

    def search(self, starts: np.ndarray, ordinals: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Rule -> the texts, of n, that hold what it requires: postings united within clauses and intersected over them."""
        post = lambda g: ordinals[starts[g] : starts[g + 1]]
        sizes, held, out = np.diff(starts), np.zeros(n, bool), {}
        for rule, clauses in self.clauses.items():
            ok = np.ones(n, bool)
            for single, longer in clauses:
                some = np.zeros(n, bool)
                for g in single[starts[single + 1] > starts[single]]:
                    some[post(g)] = True
                for gs in longer[(sizes[longer] > 0).all(1)]:
                    gs = np.unique(gs)
                    gs = gs[np.argsort(sizes[gs])]
                    all_ = post(gs[0])
                    for g in gs[1:]:
                        held[post(g)] = True
                        met = held[all_]
                        held[post(g)] = False
                        all_ = all_[met]
                    some[all_] = True
                ok &= some
            out[rule] = np.flatnonzero(ok)
        return out


def block_spans(text: str) -> list[tuple[int, int]]:
    """Lines of private key blocks, whole or cut off at either end."""
    out = []
    starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    lines = [text[a : b - 1] for a, b in zip(starts, starts[1:])]
    k = 0
    while k < len(lines):
        m = BLOCK.search(lines[k])
        if m and m.group().startswith("-----BEGIN"):
            end = k
            if not re.search("-----END [A-Z0-9 ]*PRIVATE KEY", lines[k]):
                while end + 1 < len(lines) and (BODY.fullmatch(lines[end + 1]) or not lines[end + 1].strip()):
                    end += 1
                if end + 1 < len(lines) and "-----END" in lines[end + 1]:
                    end += 1
                elif end + 2 < len(lines) and len(lines[end + 1]) <= 80 and "-----END" in lines[end + 2]:  # a short last line
                    end += 2
                elif end > k and end + 2 == len(lines) and SHORT.fullmatch(lines[end + 1]):
                    end += 1
            out += [(starts[j], starts[j] + len(lines[j])) for j in range(k, end + 1) if lines[j].strip()]
            k = end
        elif m:
            first = last = k
            while last > 0 and not lines[last - 1].strip():
                last -= 1
            if last > 0 and SHORT.fullmatch(lines[last - 1]):
                first = last - 1
            while first > 0 and (BODY.fullmatch(lines[first - 1]) or not lines[first - 1].strip()):
                first -= 1
            out += [(starts[j], starts[j] + len(lines[j])) for j in range(first, k + 1) if lines[j].strip()]
        k += 1
    return out


def bare_spans(text: str) -> list[tuple[int, int]]:
    """Lines of the middle of a private key block: at least two, at the start or end of the chunk, with no mark of a block in it."""
    lines, at, starts = text.split("\n"), 0, []
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    like = [bool(BARE.fullmatch(x)) and any(c.isupper() for c in x) and any(c.islower() for c in x) and any(c.isdigit() for c in x) for x in lines]
    first = 1 if lines[0].startswith("[FILE: ") else 0
    out: list[int] = []
    j = first
    while j < len(lines) and like[j]:
        j += 1
    if j - first > 1:
        out += range(first, j)
    k = len(lines)
    while k > j and like[k - 1]:
        k -= 1
    if len(lines) - k > 1:
        out += range(k, len(lines))
    return [(starts[i], starts[i] + len(lines[i])) for i in out]


ALL_RULES = RULES | CUT_RULES
#: Rules whose values need not look random, as a name of a credential stands beside them.
NAMED = {"quoted", "element", "attribute", "column", "sql", "parameter", "option", "user", "attached"}


class Detector:
    def __init__(self, indexed: bool = True):
        self.rules = {k: re.compile(p) for k, p in ALL_RULES.items()}
        self.index = Index(ALL_RULES) if indexed else None

    def spans(self, texts: list[str], bare: bool = False) -> list[list[tuple[int, int, str]]]:
        """Of each text the (start, end, kind) of its credentials. bare: texts may be the middle of a key block."""
        of: list[list[str]] = [[] for _ in texts]
        for rule, rows in self.index.candidates(texts).items():
            for r in rows:
                of[r].append(rule)
        return [self.verify(t, rules, bare) for t, rules in zip(texts, of)]

    def verify(self, t: str, rules: list[str], bare: bool = False) -> list[tuple[int, int, str]]:
        """The credentials that these rules find in the text, in order and disjoint."""
        out: list[tuple[int, int, str]] = []
        for rule in rules:
            if rule in CUT_RULES and not bare:
                continue
            if rule == "key block":
                out += [(a, b, "private_key") for a, b in block_spans(t)]
            elif rule == "bare key":
                if not BLOCK.search(t):
                    out += [(a, b, "private_key") for a, b in bare_spans(t)]
            elif rule == "folded":
                out += self.folded(t)
            elif rule == "joined":
                for m in self.rules[rule].finditer(t):
                    if random_like(m["a"] + m["b"]) and not PUBLIC.search(line_before(t, m.start())):
                        out += [(*m.span("a"), "joined"), (*m.span("b"), "joined")]
            else:
                for m in self.rules[rule].finditer(t):
                    if self.counts(rule, t, m):
                        out.append((*m.span("v"), "joined" if rule in CUT_RULES else rule))
        return merge(out)

    @staticmethod
    def counts(rule: str, t: str, m: re.Match) -> bool:
        v = m["v"]
        if rule == "issued":
            return True
        if rule in ("prefixed", "assigned"):
            before = line_before(t, m.start() if rule == "assigned" else m.start("v"))
            return drawn(v) and not PUBLIC.search(before.rstrip(" =:\"'`"))
        if rule == "url":
            return not NO_VALUE.match(v) and len(set(v)) > 2
        if rule in NAMED or rule == "plain" and PASSWORD.search(t[m.start() : m.start("v")]):
            return literal(v, bool(PASSWORD.search(t[m.start() : m.start("v")])))
        return random_like(v)

    def folded(self, t: str) -> list[tuple[int, int, str]]:
        """Values in the indented lines after a name."""
        out = []
        for m in self.rules["folded"].finditer(t):
            indent = re.match(r"[ \t]*", t[t.rfind("\n", 0, m.start()) + 1 :]).end()
            for x in FOLDED_LINE.finditer(t, m.end()):
                if not x.group(2) or len(x.group(1)) <= indent:
                    break
                if literal(x.group(2)) or len(x.group(2)) >= 16 and " " not in x.group(2):
                    out.append((*x.span(2), "folded"))
        return out


FOLDED_LINE = re.compile(r"([ \t]*)(\S[^\r\n]*)?(?:\r?\n|$)")


def line_before(t: str, at: int) -> str:
    return t[t.rfind("\n", 0, at) + 1 : at]


def merge(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Every value becomes [REDACTED]; line breaks inside a value stay."""
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], "\n".join("[REDACTED]" for _ in range(text.count("\n", a, b) + 1))]
        at = b
    return "".join([*out, text[at:]])


#: Characters of the texts of one segment, at least one text.
SEGMENT = 4_000_000


def build_index(texts: DataFrame) -> DataFrame:
    """ids, starts, ordinals: a stored row for each segment of texts (id, text): their ids, and the postings over them."""

    def make():
        index = Index(ALL_RULES)

        def run(ids, texts):
            out, first = [], 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= SEGMENT):
                    size += len(texts[last])
                    last += 1
                starts, ordinals = index.segment(texts[first:last])
                out.append((np.array(ids[first:last], np.int64).tobytes(), starts.tobytes(), ordinals.tobytes()))
                first = last
            return list(zip(*out))

        return run

    return cut(map_lists(texts.select("id", "text"), make, "ids binary, starts binary, ordinals binary"))


def candidates(segments: DataFrame) -> DataFrame:
    """id, rules: the texts that hold what some rule requires, with a bit for each such rule in the order of ALL_RULES."""

    def make():
        index = Index(ALL_RULES)

        def run(ids, starts, ordinals):
            out = [], []
            for i, s, o in zip(ids, starts, ordinals):
                of = np.frombuffer(i, np.int64)
                bits = np.zeros(len(of), np.int64)
                for k, rows in enumerate(index.search(np.frombuffer(s, np.int32), np.frombuffer(o, np.int32), len(of)).values()):
                    bits[rows] |= 1 << k
                some = np.flatnonzero(bits)
                out[0].extend(of[some].tolist())
                out[1].extend(bits[some].tolist())
            return out

        return run

    return map_lists(segments, make, "id bigint, rules bigint").groupBy("id").agg(F.bit_or("rules").alias("rules"))


def _verified(df: DataFrame, key: list[str], text: Column | str, bare: bool, every: bool, make_run, schema: str) -> DataFrame:
    """The texts that are candidates (or every text) with their rules, through make_run(names of the rules, detector)."""
    # Rows of equal text share an id: their candidates are the same.
    source = df.select(*key, (F.col(text) if isinstance(text, str) else text).alias("__text")).withColumn("__id", F.xxhash64("__text"))
    found = candidates(build_index(source.where("__text is not null").select(F.col("__id").alias("id"), F.col("__text").alias("text"))))
    source = salted(source, found.withColumnRenamed("id", "__id"), "__id", key, salts=4, how="left" if every else "inner").drop("__id")  # of one text there may be many copies
    kept = ", ".join(f"`{n}` {t}" for n, t in source.select(*key).dtypes)
    names = list(ALL_RULES)

    def make():
        detector = Detector(indexed=False)

        def run(*cols):
            *keys, texts, rules = cols
            found = [detector.verify(t, [k for j, k in enumerate(names) if r >> j & 1], bare) if t and r else [] for t, r in zip(texts, rules)]
            return make_run(keys, texts, found)

        return run

    return map_lists(source, make, f"{kept}, {schema}")


def secrets(df: DataFrame, key: list[str], text: Column | str, bare: bool = False) -> DataFrame:
    """key columns, line_no, kind: one row per line that holds all or part of a credential."""

    def rows(keys, texts, found):
        out = [[] for _ in range(len(keys) + 2)]
        for i, spans in enumerate(found):
            for a, b, kind in spans:
                first = texts[i].count("\n", 0, a) + 1
                for line in range(first, first + texts[i].count("\n", a, b) + 1):
                    for c, v in zip(out, (*(x[i] for x in keys), line, kind)):
                        c.append(v)
        return out

    return _verified(df, key, text, bare, False, rows, "line_no bigint, kind string")


def redacted(df: DataFrame, key: list[str], text: str, bare: bool = False) -> DataFrame:
    """key columns, text redacted, n_secrets: every row, those of null texts too."""

    def rows(keys, texts, found):
        return (*keys, [t if t is None else redact(t, s) for t, s in zip(texts, found)], [len(s) for s in found])

    return _verified(df, key, text, bare, True, rows, "text string, n_secrets int")
