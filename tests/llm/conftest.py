from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
LONG = "Long words, again and again. " * 30_000
#: Ids, texts, languages and sources with everything that may go wrong; (9, same text) is there twice.
HARD = [
    (1, "hello world, this is a line\nshared line\n  shared line \nend", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", "en", "b"), (5, LONG, "en", "a"),
    (6, "hello world, this is a line\nshared line\n  shared line \nend", "en", "b"), (None, "text without an id\nshared line", "en", "a"), (None, None, None, None),
    (9, "repeated row\nshared line", "xx", "a"), (9, "repeated row\nshared line", "xx", "a"), (10, "Ünï cödé 日本語\x00\x01 ▁ a  b   c\r\n", None, "c"), (11, "one", "en", "c"),
    (12, "emoji 😀 password: abcdefgh12 and token=short x", "en", "a"),
]
#: Extra columns with the names that operators use inside.
NAMES = (
    "kept n_tokens keep_id component_id spans _key held_out length task names row row_id row_of row_a row_b drop id of line known on host key a b h1 h2 owner base extra s _a _b _id _h1 _h2 _spans _drop blocks places reached gaps last ends "
    "assign access hex generic gap match value at place of_text doc doc_of number component part dim block rank local base_ lines_total lines_dropped t0 t1 k0 k1 n_shingles halves sketch ids chars lang_pred score rejected recipe text_sha256 checks"
).split()
CLASHING = "doc_id LONG, text STRING, lang STRING, source STRING, " + ", ".join(f"{n} INT" for n in NAMES)


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in HARD], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
