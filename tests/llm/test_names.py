"""Names in sentences that no rule was written from."""

from palimpsest.llm import personal

GIVEN = "Marta Tomas Ingrid Pavel Chiara Bastien Saoirse Emeka Yuki Oskar".split()
FAMILY = "Aldini Novotny Bergqvist Okafor Tanaka Moreau Kelleher Lindholm Ferrante Duarte".split()
#: What letters, forms and minutes hold anyway: these tell the words of names.
LETTERS = ["Dear {},\nthank you for the parcel.", "See you soon.\n\nBest regards,\n{}", "From: {} <{}@mail.example>\nSubject: roof", "Yesterday I met {} at the station.", "Signed by {} on the last page.", "Gentile {},\nla riunione è spostata.", "Name: {}\nDate: 3 May", "My colleague {} will join later.", "Call {} before noon.", "Ho parlato con {} della caldaia."]
#: Held out: where names stand without any such sign.
HELD_OUT = [
    "{} moved out on Monday and left the plants.", "The minutes were approved after {} objected to the second item.", "I think {} has the spare key.", "A parcel for {} is still in the hallway.", "Nobody had seen {} since the concert.", "It was {} who repaired the bicycle.",
    "The prize went to {}, as expected.", "Photos by {} and others.", "We painted the fence while {} cooked.", "{} owes us forty euros.", "Ieri {} ha perso il treno.", "La bicicletta di {} è in cortile.", "Secondo me {} non viene.", "Present: {}, two guests and the caretaker.", "the keys are with {} until friday",
    "Her notes mention {} twice.", "\"No,\" {} insisted.", "The flat above {} is empty.", "There is a message from {} on the machine.", "Ask whether {} minds the noise.",
]
#: Capitalised pairs that are no humans.
OTHERS = [
    "We drove from Porto Velho to Santa Brisa.", "Porto Velho was cold, Santa Brisa colder.", "The Northern Line was closed near Porto Velho.", "Acme Robotics shipped the Nimbus Drive late.", "Nimbus Drive needs an update, says Acme Robotics.", "Il mercato di Santa Brisa apre alle nove.", "Acme Robotics opened an office in Porto Velho.",
    "The Silver Harbour sailed from Santa Brisa.", "Silver Harbour is a ferry.", "The Nimbus Drive failed again near Silver Harbour.", "Visit Santa Brisa in spring.", "Santa Brisa and Porto Velho are twinned.", "On Monday Morning Post arrives late.", "Great Expectations was on the shelf.",
]


def test_names_in_ordinary_sentences(spark):
    names = [f"{g} {FAMILY[(i + j) % 10]}" for i, g in enumerate(GIVEN) for j in range(3)]
    told = [LETTERS[k % 10].replace("{}", n, 1).replace("{}", n.split()[0].lower()) for k, n in enumerate(names)]
    held = [x.replace("{}", f"{GIVEN[(3 * k) % 10]} {FAMILY[(7 * k + 4) % 10]}") for k, x in enumerate(HELD_OUT)]
    texts = [*told, *held, *OTHERS]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = {r.k for r in personal.kinds_found(rows, ["k"]).where("kind = 'person'").collect()}
    first, last = len(told), len(told) + len(held)
    recall = sum(k in found for k in range(first, last)) / len(held)
    wrong = [texts[k] for k in found if k >= last]
    print(f"recall {recall:.2f}, wrong {len(wrong)} of {len(OTHERS)}")
    assert recall >= 0.9, [texts[k] for k in range(first, last) if k not in found]
    assert len(wrong) <= 1, wrong
    got = {r.k: r.text for r in personal.personal(rows, ["k"]).collect()}
    assert got[first] == "[PERSON] moved out on Monday and left the plants."


def test_long_texts_and_clashing_names(spark):
    """Work grows with the text, not with its square; key columns may have any name."""
    text = "Dear Marta Aldini, write to marta@mail.example or Pavel Novotny. " * 8000
    df = spark.createDataFrame([(1, 2, "x", text), (1, 2, "x", None), (3, 4, "y", "")], "a int, given int, word string, text string")
    got = personal.personal(df, ["a", "given", "word"]).orderBy("a").collect()
    assert len(got) == 2 and got[0].kinds == ["email", "person"] and got[0].text.startswith("Dear [PERSON], write to [EMAIL] or [PERSON].")
    assert {r.kind for r in personal.kinds_found(df, ["a", "given", "word"]).collect()} == {"email", "person"}
