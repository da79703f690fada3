import pytest

from exonloom.operators import rowparse as r
from tests.conftest import rows

CASES = [
    (1, 'g,1,PRI,note,"1..3,5..9",ACGTACGTAC', None),
    (2, 'g,1,PRI,note,1..3,ACGT\r', None),
    (3, 'g,1,PRI,"a ""q"" b","1..3",acgtn', None),
    (4, 'g,1,PRI,"open,1..3,ACGT', "quoting"),
    (5, 'g,1,PRI,"x"y,1..3,ACGT', "quoting"),
    (6, 'g,1,PRI,a"b,1..3,ACGT', "quoting"),
    (7, "g,1,PRI,note,1..3", "column_count"),
    (8, "g,1,PRI,note,1..3,ACGT,", "column_count"),
    (9, "g,1,PRI,note,3..1,ACGT", "ranges"),
    (10, "g,1,PRI,note,0..1,ACGT", "ranges"),
    (11, "g,1,PRI,note,1..5,ACGT", "ranges"),
    (12, 'g,1,PRI,note," 1..2 , 3..4 ",AC GT', None),
    (13, "g,1,PRI,note,1..x,ACGT", "ranges"),
    (14, "g,1,PRI,note,,ACGT", "ranges"),
    (15, "g,1,PRI,note,1..2,ACXT", "seq"),
    (16, "g,1,PRI,note,1..2,", "ranges"),
    (17, "gene,file_rank,division,note,ranges,seq", "ranges"),
    (18, "", "column_count"),
    (19, None, "missing"),
    (20, "   ", "column_count"),
    (21, 'g,1,PRI,note,"1..99999999999999999999999",ACGT', "ranges"),
    (22, ',,,,1..1,A', None),
    (23, 'g,1,PRI,note,1..2,"ACGT"', None),
    (24, "g,1,PRI,note,1..2," + "ACGT" * 50_000, None),
    (25, 'g,1,PRI,"' + 'x""' * 50_000 + '",1..2,ACGT', None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in CASES], "line_id long, raw_line string, reason string")
    got = {x.line_id: x.reason for x in r.parse_gene_lines(df).collect()}
    assert got == {i: w for i, _, w in CASES}


def test_broken_field_and_rejects(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in CASES], "line_id long, raw_line string")
    p = r.parse_gene_lines(df)
    at = {x.line_id: x.broken_field for x in p.collect()}
    assert at[4] == 4 and at[5] == 4 and at[6] == 4 and at[7] == 0 and at[9] == 5 and at[15] == 6
    assert {x.line_id for x in r.rejected(p).collect()} == {i for i, _, w in CASES if w and w != "missing"}


def test_loaded(spark):
    df = spark.createDataFrame([(12, CASES[11][1]), (3, CASES[2][1])], "line_id long, raw_line string")
    got = {x.line_id: x for x in r.loaded_gene_records(r.parse_gene_lines(df)).collect()}
    assert got[12].seq == "ACGT" and [tuple(x) for x in got[12].ranges] == [(1, 2), (3, 4)]
    assert got[3].note == 'a "q" b' and got[3].seq == "ACGTN" and got[3].file_rank == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string, batch_id string")
    assert rows(r.reason_counts(r.parse_gene_lines(df))) == []


def test_other_schema(spark):
    fields = (r.FieldSpec("id", quoted=r"\d+", bare=r"\d+", reason="id"), r.FieldSpec("x"))
    df = spark.createDataFrame([("1,a",), ("b,c",), ('"2","x,y"',)], "t string")
    assert [x.reason for x in r.parse_rows(df, "t", fields).collect()] == [None, "id", None]


@pytest.mark.parametrize("k", range(6))
def test_prefix_patterns_grow(k):
    p = r.prefix_patterns(r.GENE_FIELDS, True)
    assert p[k].startswith(r"\A") and len(p) == 6
