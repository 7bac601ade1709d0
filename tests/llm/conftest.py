import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key int, token string, slot int, __h int"


def edge_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    base = " ".join(f"w{i}" for i in range(80))
    near = base.replace("w40", "other")
    rows = [
        (9001, ""),
        (9002, None),
        (9003, " \n\t "),
        (9004, long),
        (9005, base),
        (9005, base),
        (9006, base.upper()),
        (9007, near),
        (9008, "one two"),
        (9009, "One  TWO"),
        (9010, "ÀÉ ñandú İ Σ 你好 😀 <|endoftext|> x\r\ny"),
        (None, base),
        (None, None),
        (9011, "mail a.b@example.com or 10.0.0.1, +1 (212) 555-0100, 4111 1111 1111 1111."),
    ]
    return [(i, t, "en" if n % 3 else None, "s1" if n % 2 else None, None, "x", n, "t", None, 1) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, edge):
    """The documents of the smallest tables and the edge rows."""
    return spark.read.parquet(f"{DATA}/documents.parquet").unionByName(edge.select("doc_id", "text", "lang", "source", "n_chars")).coalesce(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
