"""Problem 6: cut oversized texts into pieces under a limit, at natural boundaries, with overlap.

Balanced targets: the fewest pieces that can hold the text give equal-length targets, all placed first. Each is snapped
to the strongest boundary near it, else to the nearest from where the other pieces still suffice; only if there is none,
one more piece is planned and all targets are placed anew. Texts with a run without white space that leaves no room for
the overlap are cut step by step, balancing what is left after each piece.

Defined results: null, empty and short texts give one piece (null gives none); limits and offsets count code points;
repeated rows give repeated pieces; columns beyond key and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.batches import map_lists

LIMIT, OVERLAP = 800, 80
#: A boundary is near a target within this share of the limit.
NEAR = 0.1
#: A boundary is white space; what stands before it gives its strength.
SPACE = re.compile(r"\s+")


def strength(text: str, a: int, b: int) -> int:
    """Of the white space text[a:b]: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 word."""
    lines = text.count("\n", a, b)
    if lines:
        return 5 if lines > 1 else 4
    before = text[a - 1] if a else ""
    return 3 if before in ".!?…" else 2 if before in ",;:" else 1


def balanced(text: str, limit: int, overlap: int) -> list[int] | None:
    """Ends of all pieces but the last, with whole overlaps; None if a run of text leaves no room for the overlap."""
    n, reach, near = len(text), limit - overlap, max(1, int(limit * NEAR))
    spaces = [m.span() for m in SPACE.finditer(text)]
    edges = [0, *(x for s in spaces for x in s), n]
    if any(b - a > reach for a, b in zip(edges[::2], edges[1::2])):
        return None
    after = [b for _, b in spaces]
    strong = [strength(text, a, b) for a, b in spaces]

    def snap(low: int, high: int, target: float) -> int | None:
        """The place in low..high, or else None: the strongest near the target, or the nearest."""
        best = None
        k = bisect_left(after, low)
        while k < len(spaces) and spaces[k][0] < high:
            at = min(after[k], high)
            far = abs(at - target)
            best = max(best or (-1, 0, 0), (strong[k] if far <= near else 0, -far, at))
            k += 1
        return best[2] if best else None

    pieces = max(1, -(-(n - overlap) // reach))
    while True:
        length = (n + (pieces - 1) * overlap) / pieces
        ends, last = [], overlap
        for i in range(1, pieces):
            end = snap(max(last + 1, n - (pieces - i) * reach), min(last + reach, n - 1), length + (i - 1) * (length - overlap))
            if end is None:
                break
            ends.append(end)
            last = end
        if len(ends) == pieces - 1 and n - last <= reach:
            return ends
        pieces += 1
        if pieces > n:
            return None


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece; forced: its start is inside a run without white space.

    Consecutive pieces share `overlap` characters, or fewer where the whole overlap would force a cut into a word run
    that fits into a piece by itself. A start is forced only if a run is longer than `limit`.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    n, start, cut, forced, out = len(text), 0, 0, False, []
    ends = balanced(text, limit, overlap) if n > limit else None
    if ends is not None:
        return [(max(0, a - overlap), b, False) for a, b in zip([0, *ends], [*ends, n])]
    while cut < n and n - start > limit:
        rest = n - start
        pieces = -(-(rest - overlap) // (limit - overlap))
        step = (rest - overlap) / pieces
        target = start + overlap + round(step)
        slack = max(1, limit // 4)
        best = None
        for lo, hi in ((max(cut + 1, target - slack), min(start + limit, target + slack)), (cut + 1, start + limit), (cut + 1, cut + limit)):
            for m in SPACE.finditer(text, max(cut, lo - 1), min(n, hi + 1)):
                a, b = m.span()
                end = min(b, hi)
                if end >= lo and end > cut and (best is None or (strength(text, a, b), -abs(end - target)) > best[0]):
                    best = (strength(text, a, b), -abs(end - target)), end
            if best:
                break
        if not best and n - cut <= limit:  # the rest is one run that fits with less overlap
            best = None, n
        if best:
            end, next_forced = best[1], False
            start = max(start, end - limit)
        else:  # more than `limit` characters without white space follow
            end, next_forced = start + limit, True
        out.append((start, end, forced))
        cut, forced = end, next_forced
        start = end - overlap if end - overlap > start else end
    if cut < n or not n:
        out.append((start, n, forced))
    return out


def pieces(df: DataFrame, key: list[str], text: Column | str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """key columns, piece_no, start_pos, end_pos, forced, piece."""
    keys = df.select(*key).dtypes
    source = df.select(*key, (F.col(text) if isinstance(text, str) else text).alias("__text")).where(F.col("__text").isNotNull())

    def make():
        def run(*cols):
            out = [[] for _ in range(len(keys) + 5)]
            for row in zip(*cols):
                t = row[-1]
                for i, (a, b, forced) in enumerate(cuts(t, limit, overlap)):
                    for c, v in zip(out, (*row[:-1], i, a, b, forced, t[a:b] if with_text else None)):
                        c.append(v)
            return out

        return run

    schema = ", ".join(f"`{n}` {t}" for n, t in keys) + ", piece_no int, start_pos int, end_pos int, forced boolean, piece string"
    return map_lists(source, make, schema)
