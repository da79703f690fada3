from exonloom.llm import formatdup
from tests.conftest import rows

SCHEMA = "record_id long, file_name string, seq string, annot string, rep long, n_raw int"
DATA = [
    (5, "QZ-001.txt", "acgt\nAC", "a=1; B: x-y", 0, 0),
    (3, "qz 001 TXT", "ACG--TAC*", "b = xy | A=1;", 0, 0),
    (9, "qz 001 TXT", "ACG--TAC*", "b = xy | A=1;", 0, 0),  # byte-identical
    (4, "qz 001 TXT", "ACGTAC", "b=xy; a=2", 0, 0),  # another field
    (6, "qz 001 TXT", "ACGTACN", "b=xy; a=1", 0, 0),  # another sequence
    (7, None, "ACGTAC", "b=xy; a=1", 0, 0),
    (8, None, "ACGTAC", "b=xy; a=1", 0, 0),
    (10, "x", "---", "a=1", 0, 0),
    (11, "x", "---", "a=1", 0, 0),
    (12, "x", "A", None, 0, 0),
    (13, "x", "A", "", 0, 0),
    (14, "y .txt", "ACGT" * 20000, "k=v", 0, 0),
    (15, "Y.TXT", "acgt" * 20000, "K:V", 0, 0),
]


def test_copies(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    assert rows(formatdup.copies(df, "record_id").select("a", "b")) == [(14, 15), (3, 5), (3, 9)]


def test_counts(spark):
    classes, _ = formatdup.collapse(spark.createDataFrame(DATA, SCHEMA), "record_id")
    assert {r.class_id: (r.n_copies, r.n_variants) for r in classes.collect()} == {3: (3, 2), 4: (1, 1), 6: (1, 1), 14: (2, 2)}


def test_hot_group(spark):
    df = spark.createDataFrame([(i, "F " * (i % 3), "AC" + " " * (i % 5) + "GT", "a=1") for i in range(1, 301)], "record_id long, file_name string, seq string, annot string")
    got = rows(formatdup.copies(df, "record_id").select("a", "b"))
    by = {}
    for i in range(1, 301):
        if i % 3:
            by.setdefault(i % 3, []).append(i)
    assert got == sorted(((min(v), x) for v in by.values() for x in v[1:]), key=repr)


def test_empty(spark):
    assert rows(formatdup.copies(spark.createDataFrame([], SCHEMA), "record_id")) == []
