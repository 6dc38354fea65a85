import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    """Nulls, empty and white texts, ties, repeated rows, shared passages, one very long text, odd characters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(120)
    base = [say(rng.randint(5, 90)) for _ in range(25)]
    texts = [*base, base[0], base[0], base[1] + " more", say(30) + " " + passage, passage + "\n" + say(25), say(9) + "\n" + passage]
    texts += [None, "", " ", "\n\n \t", "be " * 60, "x" * 900, "one", "one two", "Mail a.b@c.example.org or 10.0.0.300, 10.1.2.3; +49 (30) 1234-567!", "card 4111 1111 1111 1111 and 4111111111111112"]
    texts += [say(9000), "don't <|endoftext|> 'sit  12 ½   \n\n x", "日本語 テキスト 🙂 é", "LINE\nLINE\n \nline\nLINE " + "# " * 30]
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(k * 3 % 101, t, "en", None if k % 5 == 0 else f"src{k % 4}", None if t is None else len(t)) for k, t in enumerate(odd_texts())]
    return [*rows, rows[4], rows[4], (None, "nameless text of no id", None, None, 1), (None, None, None, "", None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    clash = ["key", "size", "shard", "slot", "fp", "ids", "bucket", "chunk", "t1", "kept", "n_words", "label", "score", "hash", "taken", "law", "h", "term", "count", "value", "_k1", "text_crc32"]
    return docs.withColumns({c: F.lit(f"clash-{c}") for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def same(found, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)
