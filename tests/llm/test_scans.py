import random

from vitalake.llm import scans as g

BODY = "The evening crew has finished the window frames.\nThe supplier portal needs the annual report because the forms were incomplete.\nA full-time vacancy in the laboratory is open."
NOISY = """Katrijn Vellualdi | Curriculum Vitae
The evening crew has finislied the win-
dow frames. A full-
time vacancy in the lab0ra-
tory is open.
Page 1 of 3
Katrijn Vellualdi | Curriculum Vitae
The supp1ier portal needs the an¬
nual report because the forms were incomplete
2017
Page 2 of 3
Katrijn Vellualdi | Curricu1um Vitae
The certiﬁed crew (P0L) is open.

Page 3 of 3"""
HEADER = "{} | Curriculum Vitae\nThe crew has finished.\n{}\n{} | Curriculum Vitae\nThe report is open.\n{}"


def rows():
    out = [(k, BODY + "\nThe certified crew is open.", 1) for k in range(30)]
    out += [(100 + k, HEADER.format(n, 1, n, 2), 2) for k, n in enumerate(["Ann Bb", "Cc Dd", "Ee Ff", "Gg Hh"])]
    return out


def test_findings(spark):
    extra = [(500, NOISY, 3), (501, NOISY, 3), (502, None, 1), (503, "", None), (504, "x " * 60_000, 1)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows() + extra], "pdf_id bigint, text string, page_count int, line string, kind string")
    got = {}
    for r in g.find_noise(df, "pdf_id", "text", "page_count").collect():
        got.setdefault(r["pdf_id"], set()).add((r["line_no"], r["kind"]))
    want = {
        (1, "header"), (2, "misread"), (2, "hyphen"), (4, "misread"), (4, "hyphen"), (6, "page_number"), (7, "header"), (8, "misread"), (8, "hyphen"),
        (11, "page_number"), (12, "header"), (13, "misread"), (15, "page_number"),
    }
    assert got[500] == want and got[501] == want
    assert 502 not in got and 503 not in got and 504 not in got and not [k for k in got if k < 100]
    fixed = {r["pdf_id"]: r for r in g.repair(df, "pdf_id", "text", "page_count").collect()}
    text = fixed[500]["text"]
    assert text.startswith("The evening crew has finished the window frames. A full-time vacancy in the laboratory is open. The supplier portal needs the annual report because")
    assert "certified" in text and "Page" not in text and "Curriculum" not in text and fixed[500]["n_noise"] == len(want)
    assert fixed[502]["text"] is None and fixed[503]["text"] == ""
    assert g.find_noise(df.limit(0), "pdf_id", "text", "page_count").count() == 0


def test_confusions():
    assert g.confusion_cost("finislied", "finished") == g.SLIP and g.confusion_cost("rnodern", "modern") == g.SLIP and g.confusion_cost("oﬃce", "office") == g.SLIP
    assert g.confusion_cost("word", "word") == 0 and g.confusion_cost("ward", "word") is None


def test_page_numbers():
    for s in ("Page 2 of 3", "- 2 -", "– 2 –", "[2]", "2/3", "p. 2", "Seite 2 von 3", "   2", "\x0cPage 2", "iii", "- ii -", "I"):
        assert g.page_number(s, 3), s
    for s in ("2017", "372.", "Page", "05/2014", "2 apples", "12", "", "iv", "ill", "civil"):
        assert not g.page_number(s, 3), s


def misread(word, slips, r):
    """The word with so many confusions made, at places that do not touch each other's letters."""
    parts = [(i, k, x) for i in range(len(word)) for k in (1, 2, 3) if i + k <= len(word) for x in g.CONFUSED.get(word[i : i + k], ())]
    for _ in range(slips):
        if not parts:
            return word
        i, k, new = r.choice(parts)
        word = word[:i] + new + word[i + k :]
        parts = [p for p in parts if p[0] + p[1] <= i]
    return word


def test_every_accepted_pair_shares_a_key():
    r = random.Random(1)
    words = ["gefahrstoffverzeichnis", "moment", "office", "affluent", "waffle", "donaudampfschifffahrtsgesellschaft", "commitment", "rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz", "x" * 44 + "mm"]
    words += ["".join(r.choice("mdhuwnolisbgqetfzarclviüäöß") for _ in range(n)) for n in (*range(3, 60), 200) for _ in range(5)]
    for w in words:
        for _ in range(20):
            read = misread(w, r.choice((1, 2)), r)
            assert g.confusion_cost(read, w) is not None
            assert g.join_keys(read, False) & g.join_keys(w, True), (read, w)
    for true, wrongs in g.CONFUSED.items():
        assert {g.levelled(x) for x in wrongs} == {g.levelled(true)}, true


def test_long_and_twice_misread_words(spark):
    long = "donaudampfschifffahrtselektrizitätenhauptbetriebswerk"
    pairs = [("gefalirstoffverzeichnis", "gefahrstoffverzeichnis"), ("rnornent", "moment"), ("oﬃce", "office"), ("aﬄuent", "affluent"), (long.replace("h", "li", 1), long)]
    docs = [(k, " ".join(x[1] for x in pairs), 1) for k in range(30)] + [(100, " ".join(x[0] for x in pairs), 1)]
    df = spark.createDataFrame(docs, "key bigint, text string, pages int")
    lexicon = g.Lexicon(df)
    assert {(r["w"], r["fix"]) for r in lexicon.fixes(lexicon.forms).collect()} == set(pairs)
