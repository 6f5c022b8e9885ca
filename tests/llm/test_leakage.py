import base64
import quopri
import random

import pytest

from vitalake.llm import leakage

rng = random.Random(3)
NOUNS = [f"{a}{b}" for a in ("lan", "bri", "cop", "wil", "tim", "gra") for b in ("tern", "stle", "per", "low", "ber", "nite")]


def item(seed):
    r = random.Random(seed)
    return " ".join(r.choice(NOUNS) if k % 3 else str(r.randrange(1000)) for k in range(60))


ITEMS = [(k, item(k)) for k in range(1, 13)]
W = {k: t.split() for k, t in ITEMS}
FILL = " ".join(f"filler{k}" for k in range(40))


def wrap(text, mark="> "):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + 7]) for i in range(0, len(w), 7))


def misspell(words, every):
    return [w[:2] + w[3:] if i % every == 0 and len(w) > 4 and not w.isdigit() else w for i, w in enumerate(words)]


CASES = {
    1: (f"{FILL} {ITEMS[0][1]} {FILL}", {1}),
    2: (f"{FILL}\n{wrap(ITEMS[1][1])}\n{FILL}", {2}),
    3: (f"{FILL} {' '.join(W[3][10:42])} {FILL}", {3}),
    4: (f"{FILL} {' '.join(W[4][:24])} {FILL}", set()),
    5: (f"{FILL} {' '.join(misspell(W[5], 9))} {FILL}", {5}),
    6: (f"<p>{FILL}</p><p>{', '.join(W[6]).upper()}</p>", {6}),
    7: ("Content-Transfer-Encoding: base64\n\n" + base64.encodebytes((FILL + " " + ITEMS[6][1]).encode()).decode(), {7}),
    8: ("Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring((FILL + " é " + ITEMS[7][1]).encode()).decode(), {8}),
    9: (" ".join(w if i % 2 else "other" for i, w in enumerate(W[9])), set()),
    10: (f"{ITEMS[9][1]} {FILL} {ITEMS[10][1]} {ITEMS[9][1]}", {10, 11}),
    11: (" ".join(str(int(w) + 1) if w.isdigit() else w for w in W[12]), set()),
    12: ("", set()), 13: (None, set()), 14: (FILL * 2000, set()),
}


def test_cases(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in CASES.items()], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, " ... ")], "item_id bigint, text string")
    found = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text")
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert got == {k: v for k, (_, v) in CASES.items() if v}
    assert {r["doc_id"] for r in leakage.remove_leaked(docs, "doc_id", found).collect()} == {k for k, (_, v) in CASES.items() if not v}


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, CASES[1][0]), (10, CASES[10][0])], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK", 5)
    got = {tuple(r)[:2] for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 1), (10, 10), (10, 11)}
    assert leakage.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("seed,size", [(0, 3), (1, 6), (2, 12), (3, 25), (4, 40), (5, 1), (6, 2)])
def test_matches_against_brute_force(seed, size):
    """The suffix arrays give the longest verbatim matches of all pairs with enough seeds."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(9)]
    texts = [" ".join(r.choice([*vocabulary, "zz"]) for _ in range(60)) for _ in range(6)] + ["", None]
    words = [[r.choice(vocabulary).encode() for _ in range(size + k)] for k in range(5)]
    texts += [b" ".join(words[3]).decode() * 3, b" ".join(words[4] + words[4]).decode()]
    items = leakage.Items(list(range(5)), words)
    got = set(zip(*(x.tolist() for x in leakage.Shard(items, texts).matches())))
    want, start = set(), 0
    for k, t in enumerate(texts):
        w = leakage.words(t) if t else []
        for j, it in enumerate(words):
            n, needed = leakage.seed_of(len(it))
            met = [(a, b) for a in range(len(w) - n + 1) for b in range(len(it) - n + 1) if w[a : a + n] == it[b : b + n]]
            if len({b for _, b in met}) < needed:
                continue
            for a, b in met:
                if a == 0 or b == 0 or w[a - 1] != it[b - 1]:
                    m = n
                    while a + m < len(w) and b + m < len(it) and w[a + m] == it[b + m]:
                        m += 1
                    want.add((k, j, start + a, b, m))
        start += len(w) + 1
    assert got == want


def test_no_passage_is_without_seeds():
    """However the broken words lie, a passage of half of an item holds the seeds that are asked for."""
    r = random.Random(2)
    for size in [*range(1, 40), 63, 100, 101]:
        n, needed = leakage.seed_of(size)
        for _ in range(200):
            m = r.randint(-(-size // 2), size)
            broken = set(r.sample(range(m), int(m * leakage.MISSPELT)))
            whole = [a for a in range(m - n + 1) if not broken & set(range(a, a + n))]
            assert len(whole) >= needed, (size, m, broken)


def test_short_items_large_vocabularies_and_long_items():
    one = lambda item, text: [x[2] for x in leakage.leaks(leakage.Items([1], [[w.encode() for w in item]]), [text])]
    assert one(["red", "oak", "tree"], f"{FILL} Red, oak tree. {FILL}") == [3]
    assert one(["the", "red", "oak", "tree", "is", "old"], f"{FILL} red oak tree {FILL}") == [3]
    assert one(["the", "red", "oak", "tree", "is", "old"], f"{FILL} red oak {FILL}") == []
    many = [[f"v{k * 60 + i}".encode() for i in range(60)] for k in range(700)]
    items = leakage.Items(list(range(700)), many)
    assert len(items.of) > 32_767
    assert [x[:3] for x in leakage.leaks(items, [FILL, b" ".join(many[650]).decode()])] == [(1, 650, 60)]
    long = [f"q{i % 9973}".encode() for i in range(50_000)]
    items = leakage.Items([1, 2], [long, many[0]])
    text = b" ".join(long[9_000:40_000]).decode()
    assert [x[:3] for x in leakage.leaks(items, [text, FILL, b" ".join(long[:9_000] + many[0]).decode()])] == [(0, 0, 31_000), (2, 1, 60)]


ITEM = "The red oak tree behind the old mill was felled in spring because its roots had raised the paving stones of the yard"


@pytest.mark.parametrize("text", [
    "CONTENT-TRANSFER-ENCODING: Base64\n\n" + base64.encodebytes(ITEM.encode()).decode(),
    "Subject: =?UTF-8?B?" + base64.b64encode(ITEM.encode()).decode() + "?=\n\nhello",
    "Subject: =?utf-8?q?" + ITEM[:60].replace(" ", "_") + "?=\n =?utf-8?q?" + ITEM[60:].replace(" ", "_") + "?=\n\nhello",
    "--x\nContent-Type: text/plain; charset=utf-16\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(ITEM.encode("utf-16")).decode() + "\n--x--\n",
    "<div class='" + "a" * 900 + "'>" + ITEM.replace(" ", " <span title='" + "b" * 500 + "'>", 1) + "</span></div>",
    "> Content-Transfer-Encoding: quoted-printable\n> \n> " + ITEM[:30] + "=\n> " + ITEM[30:],
])
def test_mail_encodings(text):
    items = leakage.Items([1], [leakage.words(ITEM)])
    assert [x[2] for x in leakage.leaks(items, [text])] == [len(ITEM.split())]


def test_only_the_part_named_is_decoded():
    text = "--x\nContent-Transfer-Encoding: quoted-printable\nContent-Type: text/plain; charset=iso-8859-1\n\nM=FCller =\ngeht\n--x\nContent-Type: text/plain\n\nsize=20 = 3\n--x--"
    assert leakage.readable(text).split("\n\n")[1:] == ["Müller geht\n--x\nContent-Type: text/plain", "size=20 = 3\n--x--"]


def test_passages_over_neighbouring_diagonals():
    w = [x.encode() for x in W[1]]
    test = leakage.Items([1], [w])
    split = lambda x: x[:2] + " " + x[2:]
    k = [i for i, x in enumerate(W[1]) if not x.isdigit()]
    carried = {
        "put in": [*W[1][:22], "â", *W[1][22:35], "â", *W[1][35:]],
        "dropped": [x for i, x in enumerate(W[1]) if i not in (20, 40)],
        "split": [split(x) if i in (k[9], k[20], k[30]) else x for i, x in enumerate(W[1])],
        "run together": [x + W[1][i + 1] if i in (20, 40) else x for i, x in enumerate(W[1]) if i not in (21, 41)],
        "close together": [*W[1][:20], "â", *W[1][20:22], "â", *W[1][22:40], "â", *W[1][40:42], "â", *W[1][42:]],
    }
    for name, x in carried.items():
        got = list(leakage.leaks(test, [f"{FILL} {' '.join(x)} {FILL}"]))
        assert len(got) == 1 and got[0][2] >= 56 and got[0][3] == 40, (name, got)
    apart = {
        "far apart": [*W[1][:20], *["other"] * 9, *W[1][20:40], *["other"] * 9, *W[1][40:]],
        "wrong order": [*W[1][40:], "other", *W[1][20:40], "other", *W[1][:20]],
        "too little": [*W[1][:10], "â", *W[1][10:28]],
    }
    for name, x in apart.items():
        assert not list(leakage.leaks(test, [f"{FILL} {' '.join(x)} {FILL}"])), name
