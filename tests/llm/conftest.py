import pytest

DATA = "/root/testdata/sf0.001"

#: Nulls, empty texts, ties, repeated rows, white space of all kinds, a long text, code points beyond the BMP.
ROWS = [
    (1, "Alpha beta gamma delta", "en", "a"),
    (2, "Alpha  beta\tgamma\ndelta", "en", "a"),
    (2, "Alpha  beta\tgamma\ndelta", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n\x0b\x0c\r", "fr", "b"),
    (6, "x\U0001f600y " * 30, "fr", "b"),
    (7, "The same long line of text that many documents share, word for word.\nshort\n" * 3, "en", "a"),
    (8, "the same long line of text that many documents share, word for word.\r\nother", "en", "a"),
    (9, "  THE SAME LONG LINE of text that many documents share, word for word.\t", "en", "a"),
    (10, "The same long line of text that many documents share, word for word.", "en", "a"),
    (11, "The same long line of text that many documents share, word for word.\n\nend", "en", "a"),
    (12, "a b c a b c a b c " * 40, "de", "c"),
    (13, "word " * 3000 + "tail", "de", "c"),
    (14, "mail bob@example.com, ring +1 (555) 010-9999 or 10.0.0.256 / 10.0.0.255; card 4111 1111 1111 1111.", "en", "a"),
    (None, "Alpha beta gamma delta", "en", "a"),
    (15, "a special name <|endoftext|> in a text<|endoftext|>", "en", "a"),
    (15, "the same id with another text: 3.4.5.6 " + "a" * 70_000, None, None),
]
#: Names that operators might use themselves.
CLASHES = ["slot", "_again", "_gone", "_spans", "_of", "_sha", "_rid", "_text", "_body", "part", "rank", "root", "label", "length", "key"]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with extra columns whose names clash with the operators' own."""
    rows = [(*r, len(r[1] or ""), *range(len(CLASHES))) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", n_chars bigint, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.fixture(scope="session")
def huge(spark):
    """Texts of a megabyte: one word, numbers, line ends, spaces, one line again and again, letters without spaces that are no ASCII."""
    texts = ["x" * 1_000_000, "12345 " * 170_000, "\n" * 1_000_000, " " * 1_000_000, "one line of text that is long enough to count again\n" * 20_000, "日本語テキスト" * 50_000]
    return spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
