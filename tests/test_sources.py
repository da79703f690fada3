from exonloom.sources import records
from tests.conftest import rows

GENBANK = "LOCUS X 12 bp DNA PRI\r\nCDSjoin(1..3,5..9)\r\nacgtnacgt\r\nacrgt\r\nggtt\r\n//\r\n"
FASTA = ">X\n>X(2..4,x..9,7..8..9, 10..12)\nACGT\nNNAC\n"


def test_parse(spark):
    df = spark.createDataFrame([(1, GENBANK), (2, FASTA), (3, "a\nb"), (4, None), (5, ">\n>\nAC"), (6, "x\ny\nAC")], "id long, value string")
    got = {r.id: (r.seq, [tuple(x) for x in r.ranges]) for r in records.parse_records(df).collect()}
    assert got == {1: ("ACGTACGTGGTT", [(1, 3), (5, 9)]), 2: ("ACGTAC", [(2, 4), (10, 12)]), 3: ("", []), 4: ("", []), 5: ("AC", []), 6: ("AC", [])}
    drop = {r.id: r.seq for r in records.parse_records(df, n_policy="drop_line").collect()}
    assert drop[1] == "GGTT" and drop[2] == "ACGT"


def test_fasta(spark):
    df = spark.createDataFrame([(1, ">a\nAC\nGT\n>b\n\n>c\nTT"), (2, None), (3, "AC")], "id long, value string")
    assert rows(records.fasta_records(df, "id").select("id", "seq")) == [(1, "ACGT"), (1, "TT"), (3, "AC")]
    assert records.labelled_fasta(df, df, "id").groupBy("label").count().count() == 2


def test_read_texts(spark, tmp_path):
    for name in ("B.TXT", "a.txt", "sub/c.Txt", "x.dat"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(FASTA)
    (tmp_path / "sub" / "b.txt").write_text("other")
    got = records.read_texts(spark, str(tmp_path))
    assert sorted(r.file_name for r in got.collect()) == ["B.TXT", "a.txt", "c.Txt"]
    assert got.where("file_name = 'B.TXT'").first().value == FASTA
