"""Secrets in long texts, entropy against SQL, and pieces of texts with marks, against plain restatements."""

import hashlib
import random
import time
from array import array

import duckdb
import pytest

from gridloom.llm import oracle
from gridloom.llm.secrets import find_secrets, redact
from gridloom.llm.tokens import PieceEncoder, load

DOCS = "doc_id bigint, text string"
RNG = random.Random(21)
KEY = "".join(RNG.choice("ABCDEFGHJKMNPQRSTabcdefghijkmnopqrst23456789+/") for _ in range(44))
HASHES = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(16_000)]
LONG = {
    "segments": "ab1/" * 250_000,
    "hashes": "\n".join(HASHES),
    "assignments": "".join(f'token = "{h[:20]}.{h[20:40].upper()}" ' for h in HASHES[:8_000]),
    "fillers": "xxxx_0000-1234567890=" * 30_000 + "!",
    "capitals": "Q" * 1_000_000,
    "one key": "word " * 100_000 + KEY + " word" * 100_000,
    "humps": "QaQa" * 200_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_secrets_in_a_long_text(spark, kind):
    """Neither the stack nor a second power of the length stands in the way of a text of a megabyte."""
    text = LONG[kind]
    docs = spark.createDataFrame([(1, text)], DOCS)
    find_secrets(spark.createDataFrame([(1, "warm up " + KEY)], DOCS)).collect()
    began = time.time()
    row = find_secrets(docs).collect()[0]
    assert time.time() - began < 30
    spans = [s for s in row["spans"].split(",") if s]
    if kind == "hashes":
        assert row["n_hex"] == 16_000 and spans == [f"hex:{65 * i}:{65 * i + 64}" for i in range(16_000)]
    elif kind == "assignments":
        assert row["n_assign"] == 8_000 and sum(s.startswith("assign") for s in spans) == 8_000
    elif kind == "one key":
        assert spans == [f"entropy:{text.index(KEY)}:{text.index(KEY) + len(KEY)}"]
    elif kind in ("segments", "fillers", "capitals"):
        assert spans == []
    clean = redact(docs).collect()[0]["text"]
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    assert clean == "".join(out) + text[at:]


def planted(n=300):
    """Documents with keys outside, inside and across pattern spans, and what the allow list lets pass."""
    rng, rows = random.Random(31), []
    alphabets = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            key = "".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.1 else alphabets[i % 3]) for _ in range(rng.choice([19, 20, 21, 32, 64, 200])))
            kind = rng.randrange(7)
            parts.append(
                [key, f"token={key}", f'x-api_key: "{key[:15]}.{key[15:]}"', f"secret = {key[:8]} {key}", "path/of/words12/and-names_7/" * 3, "aKIAxAKIA" + key.upper(), "1234567890xxxx0000" * 2][kind]
            )
            parts.append(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(5))))
        rows.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    return [*rows, (900, None), (901, ""), (902, KEY), (903, "é" * 30 + KEY + "\U0001f600" + KEY)]


def test_entropy_decides_as_in_sql(spark):
    """On the tables at hand all keys lie inside pattern spans; here most do not, and windows are counted anew in SQL."""
    rows = planted()
    documents = duckdb.connect()
    documents.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    documents.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = "doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans"
    expected = documents.sql(f"SELECT {names} FROM ({oracle.SQL['op2_secret_scan']})").fetchall()
    found = [tuple(r) for r in find_secrets(spark.createDataFrame(rows, DOCS)).selectExpr(*names.split(", ")).collect()]
    assert sorted(found) == sorted(expected)
    assert sum(r[4] for r in found) > 200 and len({(r[0], r[1]) for r in found}) == len(rows)


LETTERS = "abcxyzABCXYZ019İıIiŞşÇçĞğÖöÜüßẞÉéñÑΣσςДдЖжÅǅﬁ中文字あ한글אבعربी"
MARKS = "̸゙̧̇́̈ٓͅ"
PUNCTUATION = ".,;:!?&%#*$|)]}\"'(-[{<>/…—“”¿¡"
WORDS = ["the", "DEKİ", "TÜRKİYE'DEKİ", "don't", "x<|endoftext|>", "İİ", "aİ!", "Straße"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_marks_case_and_punctuation(name):
    """Letters whose small form is two code points, marks after them, and punctuation after those."""
    rng = random.Random(5)

    def text():
        out = []
        for _ in range(rng.randrange(1, 14)):
            word = rng.choice(WORDS) if rng.random() < 0.3 else "".join(rng.choice(LETTERS) + (rng.choice(MARKS) if rng.random() < 0.12 else "") for _ in range(rng.randrange(1, 6)))
            out.append(word + "".join(rng.choice(PUNCTUATION) for _ in range(rng.choice([0, 0, 1, 2, 3]))) + rng.choice([" ", " ", " ", "", "\n", "  ", " ", "　"]))
        return "".join(out)

    encoder, (tokenizer, _) = PieceEncoder(name), load(name)
    fixed = ["İ.", "DEKİ, ve", "TÜRKİYE'DEKİ.", "i̇.", "İ, x", "aİ!? İ", "Σ. ΑΣ, ς"]
    for batch in [fixed, *([text() for _ in range(500)] for _ in range(20))]:
        assert encoder.encode(batch) == [array("I", e.ids).tobytes() for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
