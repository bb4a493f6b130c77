import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, size string, kept string, row string, copies string"
WORDS = "the river bends under old stone bridges while small boats carry salt and grain toward distant harbour towns each spring morning".split()
SATZ = "der alte fluss trägt kleine boote unter steinernen brücken zu den fernen städten und jeden morgen kommt das salz über die grenze".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))


def texts() -> list[str | None]:
    """Null, empty, blank, one word, copies, near copies, a long text, odd characters, repeats, junk."""
    near = prose(1, 200).split()
    near[100] = "changed"
    return [
        None, "", " \t\n", "word", "word", prose(1, 200), prose(1, 200), " ".join(near), prose(2, 120), prose(3, 9000), "ÀÉ ß 你好 <|endoftext|> it's İstanbul ﬁ 1½",
        "was " * 60, "a\nsame line here\nsame line here\n" * 9, "nt*** re### ou$$$ " * 40, prose(4, 90, SATZ), prose(5, 150, SATZ), "12345 !!!",
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """Also a null id, a null language, a null source, repeated rows and extra columns with names that operators use inside."""
    rows = []
    for i, t in enumerate(texts()):
        lang = None if i == 8 else "de" if i in (14, 15) else "en"
        source = None if i == 9 else ("a", "b", "ü")[i % 3]
        rows.append((i, t, lang, source, len(t or ""), "n", "k", "s", "x", "r", "c"))
    rows += [rows[8], (None, prose(7, 40), "en", "a", 1, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
