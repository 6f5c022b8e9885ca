import numpy as np

from vitalake.llm import languages as g

SENTENCES = {
    "en": ["The training unit has finished the safety course.", "We still need the spare keys for the building.", "Please send the report before the end of the month."],
    "de": ["Die Schulungsabteilung hat den Lehrgang beendet.", "Wir brauchen noch die Schlüssel für das Gebäude.", "Bitte schicken Sie den Bericht vor dem Ende des Monats."],
    "fr": ["Le service de formation a terminé le cours.", "Nous avons encore besoin des clés du bâtiment.", "Veuillez envoyer le rapport avant la fin du mois."],
    "fa": ["واحد آموزش دوره ایمنی را کامل کرد.", "هنوز کلیدهای ساختمان لازم است.", "لطفا گزارش را پیش از پایان ماه بفرستید."],
}


def training():
    texts, labels = [], []
    for y, xs in SENTENCES.items():
        for k in range(12):
            texts.append("\n".join(xs[(k + j) % 3] for j in range(2)))
            labels.append(y if k % 6 else "en")  # a sixth of the labels is wrong
    return texts, labels


def test_code_lengths_against_the_plain_definition():
    """The table lookup gives the same bits as walking the contexts byte by byte."""
    lines = [g.level(x) for x in SENTENCES["en"]] * 2
    trees = g.Trees(lines, np.zeros(len(lines), int), 1)
    probe = g.level("The spare training report zz")
    counts = {}
    for x in lines:
        for i in range(g.ORDER, len(x)):
            for k in range(g.ORDER + 1):
                counts.setdefault(x[i - k : i], {}).setdefault(x[i], 0)
                counts[x[i - k : i]][x[i]] += 1
    bits = 0.0
    for i in range(g.ORDER, len(probe)):
        for k in range(g.ORDER, -1, -1):
            seen = counts.get(probe[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if probe[i] in seen:
                bits -= np.log2(seen[probe[i]] / total)
                break
            bits -= np.log2(len(seen) / total)
        else:
            bits += 8
    assert abs(bits - trees.cost([probe])[0, 0]) < 1e-3


def test_lines_and_labels(spark):
    texts, labels = training()
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "id bigint, text string, label string")
    trees = g.fit(df, "id", "text", "label", languages=list(SENTENCES))
    probes = [
        (1, "We need the keys.", "EN_x"), (2, "Wir schicken den Bericht.", "en"), (3, "Nous avons terminé le rapport.", None), (4, "کلیدهای ساختمان", "fa"), (5, "We need the keys for the training.\n\nWir brauchen den Bericht. (Safety Course)", "en"),
        (6, "", "en"), (7, None, None), (8, "123 45\n--", "de"), (9, "THE REPORT BEFORE THE END", "??"), (10, "We need the keys. " * 5000, "en"), (11, "We need the keys.", "en"),
    ]
    df = spark.createDataFrame(probes, "id bigint, text string, label string")
    got = {(r["id"], r["line_no"]): r["lang"] for r in g.find_mislabelled(df, "id", "text", "label", trees, list(SENTENCES)).collect()}
    assert got == {(2, 0): "de", (3, 0): "fr", (5, 0): got.get((5, 0)), (5, 1): "en", (5, 3): "de", (9, 0): "en"}
    every = g.label_lines(df, "id", "text", trees, list(SENTENCES)).collect()
    assert all(0 <= r["confidence"] <= 1 for r in every) and not [r for r in every if r["id"] in (6, 7, 8)]
    assert g.label_lines(df.limit(0), "id", "text", trees, list(SENTENCES)).count() == 0


def test_held_out_accuracy(spark, data):
    from vitalake.llm import queries

    d = data.replace("sf0.001", "sf0.01")
    rows = {r["post_id"]: r["lang"] for r in queries.p2_languages(spark, d).where("line_no = 0").collect()}
    said = {r["post_id"]: r["y"] for r in queries._posts(spark, d).select("post_id", g.label_code("label").alias("y")).collect()}
    good = [rows[k] == y for k, y in said.items() if k in rows and y in g.LANGUAGES]
    assert sum(good) / len(good) > 0.8  # the labels themselves are wrong at times


def test_texts_in_no_known_language(spark, data):
    from vitalake.llm import queries

    posts = queries._posts(spark, data.replace("sf0.001", "sf0.01"))
    trees = g.fit(posts, "post_id", "text", "label")
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "すべての人間は、生まれながらにして自由である。"]
    assert [x[1] for x in g.judge(trees, foreign)] == ["und"] * 4
    texts = [r["text"] for r in posts.where("text <> ''").select("text").collect()]
    assert "und" not in {x[1] for x in g.judge(trees, texts)}
