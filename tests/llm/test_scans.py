"""Headers by repetition, page numbers by sequences, words kept."""

import random
import textwrap

from palimpsest.llm import scans

WORDS = "harbour parser ladder window garden signal copper thread meadow lantern winter engine marble timber ribbon pepper silver basket candle bridge".split()


def page_text(rng, n, width):
    sentences = " ".join(" ".join(rng.choices(WORDS, k=rng.randint(6, 14))).capitalize() + "." for _ in range(n))
    return textwrap.wrap(sentences, width, break_on_hyphens=False, break_long_words=False)


def scan(rng, head, number, width=60):
    lines = page_text(rng, max(12, width // 5), width)
    cut = next(i for i in range(4, len(lines)) if not lines[i - 1].endswith("."))
    return "\n".join([*lines[:cut], "", *([number] if number else []), *([head] if head else []), "", *lines[cut:]]), " ".join(lines)


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "message_id bigint, text string")


def test_headers_in_any_case_are_told_by_repetition(spark):
    rng = random.Random(1)
    heads = [f"annual report of the {w} office" for w in WORDS[:8]] + ["one line that stands nowhere else"]
    made = [scan(rng, h, "") for h in heads]
    got = {r.message_id: r.text for r in scans.repaired(rows(spark, [t for t, _ in made])).collect()}
    for i, (_, whole) in enumerate(made[:8]):
        assert " ".join(got[i].split()) == whole, heads[i]
    assert heads[8] in got[8]


def test_page_numbers_rise_and_words_are_none(spark):
    assert scans.rising([(1, "12"), (5, "13"), (9, "1999"), (12, "14")]) == {1, 5, 12}
    assert scans.rising([(1, "12")]) == {1} and scans.rising([(1, "40"), (5, "12")]) == set()
    assert scans.rising([(1, "p. 40"), (5, "[12]"), (7, "xxxiv")]) == {1, 5, 7}
    for word in ("civil", "vivi", "ill", "livid", "mix", "dill"):
        assert not scans.is_number(word), word
    assert all(scans.is_number(x) for x in ("xxxiv", "xlii", "iv", "- 7 -", "Page 3 of 9", "[5]"))


def test_any_width_and_every_word(spark):
    rng = random.Random(2)
    made = [scan(rng, "", f"- {k} -", width) for k, width in enumerate([18, 40, 100, 140, 300], 5)]
    got = {r.message_id: r for r in scans.repaired(rows(spark, [t for t, _ in made])).collect()}
    for i, (_, whole) in enumerate(made):
        assert got[i].n_defects == 1 and " ".join(got[i].text.split()) == whole


def test_repair_loses_no_word(spark):
    rng = random.Random(3)
    made = []
    for k in range(30):
        text, whole = scan(rng, "A Handbook of Lanterns", f"{k}/90", rng.choice([44, 60, 72]))
        lines = text.split("\n")
        i = next(i for i in range(len(lines) - 1) if lines[i] and lines[i + 1] and len(lines[i + 1].split()[0]) > 5)
        first, _, rest = lines[i + 1].partition(" ")
        lines[i], lines[i + 1] = f"{lines[i]} {first[:3]}-", f"{first[3:]} {rest}"
        made.append(("\n".join(lines), whole))
    got = {r.message_id: r for r in scans.repaired(rows(spark, [t for t, _ in made])).collect()}
    for i, (_, whole) in enumerate(made):
        assert got[i].text.split() == whole.split()
