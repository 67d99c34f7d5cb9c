import pytest

#: Columns whose names operators use for their own.
CLASHES = ["size", "key", "row", "rows", "ids", "spans", "n", "kept", "component", "shard", "slot", "language", "tokens", "part", "range", "target", "words", "doc", "f1", "s", "p"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang, source]) rows, with extra columns if asked."""

    def make(rows, clashes=False):
        full = [(*r, *("en", "src0")[len(r) - 2 :]) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        df = df.selectExpr("*", "cast(length(text) as bigint) as n_chars")
        return df.selectExpr("*", *[f"doc_id * 0 + {k} as `{c}`" for k, c in enumerate(CLASHES)]) if clashes else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = "the and of that nation after people house water words in time".split()
    prose = " ".join(words[k % 12] + str(k % 7) for k in range(60))
    long = " ".join(words[(k * k) % 12] + ("x" * (k % 3)) for k in range(60_000))
    return [
        (1, prose, "en", "src0"), (2, None, "en", "src0"), (3, "", None, None), (None, prose, "en", "src1"), (5, long, "en", "src1"), (6, prose, "en", None),
        (6, prose, "en", None), (7, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" " + prose, "en", "src2"), (8, "one", None, "src2"), (9, "  \t\n ", "en", "src0"), (None, None, None, None),
    ]
