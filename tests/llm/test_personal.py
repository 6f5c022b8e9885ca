import pytest

from vitalake.llm import personal as g

NAMES = g.Names({"Mark", "Grace", "Joost", "Greta", "Will"}, {"period", "the"})


def kinds(line):
    return [(line[a:z], k) for a, z, k in g.detect(line, NAMES)]


CASES = {
    "Emergency contact Joost Bramvbeek (+33 1 99 00 77 37)": [("Joost Bramvbeek", "name"), ("+33 1 99 00 77 37", "phone")],
    "joost_b+jobs (at) greywater (dot) example (dot) net": [("joost_b+jobs (at) greywater (dot) example (dot) net", "email")],
    "jb @ büro-nord.example": [("jb @ büro-nord.example", "email")],
    "x ｊｂ＠ｍａｉｌ．ｔｅｓｔ": [("ｊｂ＠ｍａｉｌ．ｔｅｓｔ", "email")],
    "mаrk@mail.test": [("mаrk@mail.test", "email")],
    "call plus four nine three zero five five five zero one two three": [("plus four nine three zero five five five zero one two three", "phone")],
    "۰۲۱-۵۵۵۰۱۳۳": [("۰۲۱-۵۵۵۰۱۳۳", "phone")],
    "Mozzetti, Greta | (503) 555-0113": [("Mozzetti, Greta", "name"), ("(503) 555-0113", "phone")],
    "V. Mozzinger": [("V. Mozzinger", "name")],
    "Greta M. WEXLHOLT": [("Greta M. WEXLHOLT", "name")],
    "کد ملی: 7806034314": [("کد ملی: 7806034314", "id_number")],
    "SSN: 910-22-6604": [("SSN: 910-22-6604", "id_number")],
    "Flat 35, 201 Juniper Rd": [("Flat 35, 201 Juniper Rd", "address")],
    "Calle del Farol 26": [("Calle del Farol 26", "address")],
    "54 bis, rue de la Saline": [("54 bis, rue de la Saline", "address")],
    "OldTanneryweg 21": [("OldTanneryweg 21", "address")],
}
NOTHING = [
    "Mark the delivery dates in May and grant a grace period of ten days.", "Grace Period Office", "Will the violet labels arrive? Version 10.2.93.93 is due.", "Handles such as @warehouse_board are used.", "ISBN 978-0-00-259720-88",
    "Invoice 2031-10945-77, order 1094510945, article 410945.", "Budget 1.250.850,00 EUR against 1 190 850 EUR planned.", "Opening hours 08:30-17:00, 0.5 FTE", "Ratio 3:2 @ 40 units per hour", "ISO 16191 audit, room 12, building 4, floor 3.", "Hollow Oak Furniture, Mark the box", "", "x" * 100_000,
]


def test_findings():
    for line, want in CASES.items():
        assert kinds(line) == want, line
    for line in NOTHING:
        assert kinds(line) == [], line


def test_rest_of_the_text_is_untouched():
    text = "ﬁrst line\r\nＭail jb (at) x (dot) test, ok…\n\tOldTanneryweg 21 !"
    assert g.mask(text, NAMES) == ("ﬁrst line\r\nＭail [EMAIL], ok…\n\t[ADDRESS] !", 2)


def test_tables(spark):
    rows = [(i, f"Contact: {n} Velluani{'abcdefgh'[i]}, 030/2312516{i}", "x") for i, n in enumerate(["Zeno", "Zeno", "Zeno", "Imke"])] + [(8, None, None), (9, "", None), (10, "Zeno Quiskani\n\nZeno Quiskani", None), (10, "dup a@b.example", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, name string")
    names = g.learn_names(df.withColumn("text", df["text"]), "text")
    assert names.first in ({"Zeno"}, set())
    names = g.Names({"Zeno"}, set())
    got = sorted(tuple(r) for r in g.find_personal(df, ["id"], "text", names).where("id > 7").collect())
    assert got == [(10, 1, "email"), (10, 1, "name"), (10, 3, "name")]
    masked = {(r["id"], r["text"]) for r in g.mask_personal(df, ["id"], "text", names).where("id > 7").collect()}
    assert masked == {(8, None), (9, ""), (10, "[NAME]\n\n[NAME]"), (10, "dup [EMAIL]")}
    assert g.find_personal(df.limit(0), ["id"], "text", names).count() == 0


def test_learning(spark):
    rows = [(f"Emergency contact {n} {s} (x)",) for n in ("Zeno", "Imke") for s in ("Velluani", "Quiskani", "Bramvez")] + [("Zeno Period is a period, the period of periods, a period",), (None,)]
    names = g.learn_names(spark.createDataFrame(rows, "text string"), "text")
    assert names.first == {"Zeno", "Imke"} and names.ordinary == {"period"}


def test_disguises_with_nothing_else_on_the_line():
    names = g.Names({"Jan", "Mark"}, set())
    for line, kind in {
        "Jan de Vries": "name", "maria[arroba]firma.es": "email", "max.muster[AT]firma[DOT]de": "email", "max (ät) firma (punkt) de": "email", "john AT acme DOT com": "email", "jean {à} societe {point} fr": "email",
        "zéro zéro trois trois un neuf neuf zéro zéro sept sept": "phone", "oh oh three three one nine nine oh oh seven seven": "phone", "plus-three-three-one-nine-nine-oh-oh-seven-seven": "phone",
    }.items():
        assert [k for _, _, k in g.detect(line, names)] == [kind], line
        assert g.mask(line, names)[0] == f"[{kind.upper()}]", line


def test_too_many_ordinary_words_are_refused(spark, monkeypatch):
    rows = [(f"Emergency contact Zeno {x} (x)",) for x in ("Velluani", "Quiskani", "Bramvez")] + [(f"Zeno {x.title()} is a {x}, the {x} of {x}",) for x in ("period", "season")]
    monkeypatch.setattr(g, "MOST_NAMES", 1)
    with pytest.raises(ValueError, match="ordinary"):
        g.learn_names(spark.createDataFrame(rows, "text string"), "text")
