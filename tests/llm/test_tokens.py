import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from vitalake.llm import tokens  # noqa: E402

TEXTS = [
    "", "hello world", "<|endoftext|> plain", " a  b\n\n c\t d \n e", " ", "  \n x ", "I'll don't   x y  z", "a" * 3000, "　 x y z \x1f w", "😀😀 x‍", "ال متن فارسی", "a \u0085 b", " x\r\n y", "\x00\x01", "naïve café — “x”",
    "tail   ", "\n\nhead", "12 345 6789", "x" * 50 + " " * 70 + "y",
]


@pytest.fixture(scope="module")
def truth():
    t = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_against_the_public_library(truth):
    rng = random.Random(5)
    alphabet = "abcdeABC 012,.'-\n\tüßéöñ你好ا🙂"
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    enc = tokens.encoder("byte_bpe_50k")
    assert [enc.encode(t) for t in TEXTS + more] == truth(TEXTS + more)


def test_small_memo_changes_nothing(truth):
    v = tokens.encoder("byte_bpe_50k").v
    small = tokens.Encoder(v, public.PATTERN, memo=3)
    assert [small.encode(t) for t in TEXTS] == truth(TEXTS)


def test_appends_and_edits():
    v = tokens.encoder("byte_bpe_50k").v
    word = b" internationalisation"
    e = tokens.PrefixEncoder(v)
    for i in range(0, len(word), 3):
        e.append(word[i : i + 3])
    whole = tokens.PrefixEncoder(v, word)
    assert e.ids() == whole.ids() and e.last == whole.last
    assert b"".join(v.bytes_of[t] for t in e.ids(8)) == word[:8] and e.ids(8) == tokens.PrefixEncoder(v, word[:8]).ids()
    e.edit(6, 14, b"Z9")
    assert e.ids() == tokens.PrefixEncoder(v, word[:6] + b"Z9" + word[14:]).ids()


def test_column(spark, truth):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(100, None, None), (100, "again", None)]
    df = spark.createDataFrame(rows, "key bigint, text string, ids string")
    got = sorted((r["key"], list(r["ids"])) for r in tokens.encode_column(df, "key", "text").collect())
    assert got == sorted([(i, x) for i, x in enumerate(truth(TEXTS))] + [(100, []), (100, truth(["again"])[0])])
    assert tokens.encode_column(df.limit(0), "key", "text").count() == 0
