"""Queries that work on all rows, on documents made so that a part of them would not do."""

import pytest

from lacuna.plans import catalog
from lacuna.plans.bindings import BASES, LETTERS

#: The base of a C in a text.
C = BASES[LETTERS.index("C")]


@pytest.fixture
def folder(spark, tmp_path):
    """A folder whose only table is ``documents``, of the given texts."""

    def make(texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_fasta_lines_of_every_document(spark, folder):
    texts = ["A" * n for n in (0, 1, 59, 60, 61, 120, 121)] + [" .\n", None]
    got = {r.value for r in catalog.queries()["sk5_fasta_lines"](spark, folder(texts)).collect()}
    letters = [sum(c.isalpha() for c in t or "") for t in texts]
    assert got == {f">doc{i}\n" + "\n".join("A" * min(60, n - at) for at in range(0, n, 60)) for i, n in enumerate(letters)}


def test_base_diff_past_the_first_reads(spark, folder):
    texts = ["A" * 300 + "C" + "A" * 99 + "G", "A" * 150, "A" * 250 + "T"]
    rows = catalog.queries()["sp22_base_diff"](spark, folder(texts)).collect()
    assert [tuple(r) for r in rows] == [(0, 2, 0, "A", C)]


def test_one_mismatch_asks_every_other_read(spark, folder):
    texts = ["A" * 100 + "G" * 100 + "C" + "A" * 99, "A" * 100 + "G" * 100 + "G" * 100 + "A" * 10]
    got = {tuple(r) for r in catalog.queries()["j13_one_mismatch"](spark, folder(texts)).collect()}
    assert got == {(C + "A" * 9, "A" * 10, False), ("A" * 10, "A" * 10, True)}
