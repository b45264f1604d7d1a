import pytest

#: Texts that are unlike prose: none, blank, one long word, odd white space, special strings, letters beyond the basic plane.
ODD = [
    None, "", " ", "\n\n\t", "word", "Word", "a  b c d", "x" * 3000, "don't they'll I'M 12345 ½ …!!", "<|endoftext|>a<|startoftext|> b <|endoftext|>", "naïve café Ünï ΑΣ ΣΑΣ ß İ",
    "😀 👩‍👩‍👧 中文字符 テスト हिन्दी", "a\x1cb\x1fc\x85d", "one two three four five six seven eight", "tab\tand\r\nline", "é combined é", " lead and trail ", "AKIA" + "Z" * 16, "   many    spaces   ",
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key int, label string, size string, `group` int, id int"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated rows, a null id, nulls elsewhere and columns whose names operators use."""
    rows = [(k, t, None, None, None, 1, "x", "y", 2, 3) for k, t in enumerate(ODD)]
    rows += [rows[13], rows[13], (None, "a text without an id", "en", "src", 5, 1, "x", "y", 2, 3), (500, ("lorem ipsum dolor " * 9000).strip(), "en", "src", None, 1, "x", "y", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def pairs(df):
    """(doc_id, text) of all rows, null text as empty."""
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def counted(rows):
    """Rows as a sorted list, so that repeats count and nulls can be compared."""
    return sorted(map(repr, rows))
