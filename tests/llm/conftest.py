import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "_id string, _text string, _row string, _keep string, _size string, _gone string, _removed string, _key string, _n string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""
    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) + (("x",) * 9 if clash else ()) for r in rows]
        return spark.createDataFrame(full, DOC + (", " + CLASH if clash else ""))

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} the of" for i in range(40_000))
    lines = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    return [(None, "no id at all, but some text in here"), (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, "one"),
            (7, "two words"), (8, "the same text of a few words"), (8, "the same text of a few words"),
            (9, "the same text of a few words"), (10, lines + "\n" + lines + "\nlast"), (11, "日本語 é ß 🎉 x"),
            (None, None), (12, "a\\b</s>[INST]<|endoftext|>"), (13, lines)]
