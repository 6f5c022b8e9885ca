import pytest

from vitalake.llm import mojibake as m

CLEAN = ["Die Prüfung der Bücher für Österreich – fünf €", "l’été à la forêt", "mañana señor ¿qué?", "گروه برنامه‌ریزی", "PÃO, MAÇÃ, IRMÃ", "Łączna żółte", "Итого закрыт", "45° – 3 × 4"] * 3


def broken(text, written, read):
    return m._read(text.encode(written), read)


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>mac-roman", "utf-8>cp437", "utf-8>cp850", "utf-8>cp1251", "cp1252>mac-roman", "cp1252>cp850", "utf-8>cp1252+utf-8>cp1252"])
def test_forms_and_their_way_back(chain):
    word = "Prüfbüroübergrößen"
    form = {c: f for f, c in m.garble(word).items()}.get(chain)
    assert form and form != word and m.ungarble(form, chain) == word


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN)]
    bad = {100: broken(CLEAN[0], "utf-8", "cp1252"), 101: broken(CLEAN[1], "utf-8", "mac-roman"), 102: broken(CLEAN[2], "cp1252", "cp850"), 103: broken(CLEAN[3], "utf-8", "cp437"), 104: "plain then " + broken("für", "utf-8", "latin-1"), 105: CLEAN[0].encode("cp1252").decode("utf-8", "replace"), 106: broken(broken(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252"), 107: "lost ���zz"}
    fine = {200: None, 201: "", 202: "ascii only", 203: "x" * 50_000 + " ü", 204: "=?UTF-8?Q?Pr=C3=BCfung?= Pr=C3=BCfung &Atilde;&frac14;"}
    df = spark.createDataFrame([*rows, *bad.items(), *fine.items(), (100, bad[100])], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in m.find_garbled(df, "doc_id", "text").collect()}
    assert set(got) == set(bad)
    back = {r["doc_id"]: r["text"] for r in m.restore(df.where("doc_id <> 100 or text is not null").dropDuplicates(), "doc_id", "text").collect()}
    for k in (100, 106):
        assert "Prüfung der Bücher für Österreich" in back[k], k
    assert back[102] == CLEAN[2] and back[103] == CLEAN[3] and back[104] == "plain then für" and "été" in back[101]
    assert m.find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_long_words_and_whole_words(spark):
    long = "абвгдежзиклмнопрстуфхцчшщэюя" * 3 + "конец"
    rows = [(k, f"Prüfung {long} für") for k in range(4)] + [(100, broken(long, "utf-8", "cp1251")), (101, broken("Prüfung", "utf-8", "cp1252") + " ZPrÃ¼fungonx"), (102, broken(long, "cp1251", "latin-1"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in m.find_garbled(df, "doc_id", "text").collect()} == {100, 101, 102}
    back = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in m.restore(df, "doc_id", "text").collect()}
    assert back[100] == (long, 1) and back[102] == (long, 1)
    # a word that merely holds a garbled one is left alone
    assert back[101] == ("Prüfung ZPrÃ¼fungonx", 1)
