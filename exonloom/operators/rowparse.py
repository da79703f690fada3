"""Rows that fail to parse (problem 1): load delivered text lines, with every unusable line set apart and its reason.

Method: from the schema one anchored regular expression for whole rows is generated. Lines that match it load at once. Only the
others pass through prefix expressions - fields 1..k, first with any content, then with the fields' own patterns - and the
smallest k whose prefix fails is the first broken field. All of it is Catalyst expressions: no Python, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One field of any content. Possessive quantifiers keep the matcher linear and its stack flat on long fields.
ANY_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
ANY_BARE = r'[^",]*+'
ANY = f"(?:{ANY_QUOTED}|{ANY_BARE})"


@dataclass(frozen=True)
class FieldSpec:
    """A field of a row. `quoted` is the pattern of its content within quotes, `bare` without; None allows anything.
    `check` (fields -> boolean column) tests what a pattern can't."""

    name: str
    quoted: str | None = None
    bare: str | None = None
    reason: str | None = None
    check: object = None

    def pattern(self) -> str:
        q = ANY_QUOTED if self.quoted is None else f'"{self.quoted}"'
        return f"(?:{q}|{ANY_BARE if self.bare is None else self.bare})"


def row_pattern(fields: tuple[FieldSpec, ...]) -> str:
    """The anchored expression of a whole row."""
    return r"\A" + ",".join(f.pattern() for f in fields) + r"\z"


def prefix_patterns(fields: tuple[FieldSpec, ...], typed: bool) -> list[str]:
    """Expressions of the first 1, 2, ... fields, each up to a comma or the end."""
    parts = [f.pattern() if typed else ANY for f in fields]
    return [r"\A" + ",".join(parts[: k + 1]) + r"(?=,|\z)" for k in range(len(parts))]


def _first_failing(line: Column, patterns: list[str]) -> Column:
    """1-based number of the first pattern that fails, null if none does."""
    return F.coalesce(*[F.when(~line.rlike(p), F.lit(k + 1)) for k, p in enumerate(patterns)])


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator of one element keeps the optimizer from copying their expressions into
    each place that uses them, filters above included."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.drop(*cols).select("*", one.alias("_one")).select("*", *[F.col("_one")[n].alias(n) for n in cols]).drop("_one")


def parse_rows(df: DataFrame, line_col: str, fields: tuple[FieldSpec, ...]) -> DataFrame:
    """Add to each line `fields` (array of unquoted contents, null if the quoting is broken), `reason` (null for a valid line) and
    `broken_field` (1-based number of the first broken field, 0 for a wrong number of fields).

    Reasons in order: 'quoting', 'column_count', then each field's own in schema order. One carriage return at the end is ignored. A
    null line has reason 'missing' (there is nothing to test); an empty one has one field, so its count is wrong, unless the schema
    has just one. Other columns pass through; names clashing with the added ones are replaced.

    A line that matches the whole-row expression meets no other pattern: it leaves after one match and the checks."""
    df = df.drop("fields", "reason", "broken_field", "_line", "_ok", "_quote", "_typed", "_v", "_one")
    ln, ok, got = F.col("_line"), F.col("_ok"), F.col("fields")
    df = _once(df, _line=F.regexp_replace(F.col(line_col), r"\r\z", ""))
    df = _once(df, _ok=ln.rlike(row_pattern(fields)))
    broken = F.when(~ok & ~ln.rlike(rf"\A{ANY}(?:,{ANY})*+\z"), F.coalesce(_first_failing(ln, prefix_patterns(fields, False)), F.lit(len(fields) + 1)))
    df = _once(df, _quote=broken)
    raw = F.regexp_extract_all(F.concat(F.lit(","), ln), F.lit(f",({ANY})"), F.lit(1))
    clean = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    df = _once(df, fields=F.when(F.col("_quote").isNull(), clean))
    count_bad = F.size(got) != len(fields)
    df = _once(df, _typed=F.when(~ok & F.col("_quote").isNull() & ~count_bad, _first_failing(ln, prefix_patterns(fields, True))))
    # what patterns can't say: checks in schema order; a field breaks if its pattern or its check fails
    verdict = F.coalesce(
        F.when(ln.isNull(), F.struct(F.lit("missing").alias("reason"), F.lit(0).alias("at"))),
        F.when(F.col("_quote").isNotNull(), F.struct(F.lit("quoting").alias("reason"), F.col("_quote").alias("at"))),
        F.when(count_bad, F.struct(F.lit("column_count").alias("reason"), F.lit(0).alias("at"))),
        *[F.when(_field_bad(f, k, got, F.col("_typed")), F.struct(F.lit(f.reason).alias("reason"), F.lit(k + 1).alias("at"))) for k, f in enumerate(fields) if f.reason is not None],
    )
    df = _once(df, _v=verdict)
    return df.select("*", F.col("_v.reason").alias("reason"), F.col("_v.at").alias("broken_field")).drop("_line", "_ok", "_quote", "_typed", "_v")


def _field_bad(f: FieldSpec, k: int, got: Column, typed: Column) -> Column:
    """The typed prefixes name the first broken field; fields after it are tested on their own content."""
    content = got[k]
    own = ~content.rlike(rf"\A(?:{f.quoted})\z") if f.quoted is not None else F.lit(False)
    bad = F.coalesce(typed == k + 1, F.lit(False)) | F.when(typed < k + 1, own).otherwise(F.lit(False))
    return bad | ~f.check(got) if f.check is not None else bad


def _ranges_inside(got: Column) -> Column:
    """1 <= a <= b <= number of non-blank symbols of the sequence, for every part a..b."""
    size = F.length(F.regexp_replace(got[5], r"\s", ""))
    part = F.split(got[4], ",")
    num = lambda x, i: F.try_element_at(F.split(F.trim(x), r"\.\."), F.lit(i)).try_cast("bigint")
    inside = F.forall(part, lambda x: F.coalesce((num(x, 1) >= 1) & (num(x, 1) <= num(x, 2)) & (num(x, 2) <= size), F.lit(False)))
    return F.coalesce(inside, F.lit(False))


_PART = r"[ \t]*[0-9]+\.\.[0-9]+[ \t]*"
#: The delivered gene lines.
GENE_FIELDS = (
    FieldSpec("gene"),
    FieldSpec("file_rank"),
    FieldSpec("division"),
    FieldSpec("note"),
    FieldSpec("ranges", quoted=f"{_PART}(?:,{_PART})*+", bare=_PART, reason="ranges", check=_ranges_inside),
    FieldSpec("seq", quoted=r"[ACGTNacgtn\s]*+", bare=r"[ACGTNacgtn\s]*+", reason="seq", check=lambda got: F.regexp_replace(got[5], r"\s", "") != ""),
)


def parse_gene_lines(df: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """parse_rows for gene lines."""
    return parse_rows(df, line_col, GENE_FIELDS)


def rejected(parsed: DataFrame, id_col: str = "line_id") -> DataFrame:
    """Invalid lines with their reason; null lines are no cases."""
    return parsed.where(F.col("reason").isNotNull() & (F.col("reason") != "missing")).select(id_col, "reason", "broken_field")


def loaded_gene_records(parsed: DataFrame, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Valid lines as gene records: gene, file_rank, division, note, ranges as array of structs, seq in upper case without blanks."""
    f = F.col("fields")
    part = lambda x, i: F.element_at(F.split(F.trim(x), r"\.\."), i).cast("bigint").cast("int")
    ranges = F.transform(F.split(f[4], ","), lambda x: F.struct(part(x, 1).alias("range_start"), part(x, 2).alias("range_end")))
    return parsed.where(F.col("reason").isNull()).select(
        *keep,
        F.nullif(F.trim(f[0]), F.lit("")).alias("gene"),
        F.trim(f[1]).try_cast("int").alias("file_rank"),
        F.nullif(F.trim(f[2]), F.lit("")).alias("division"),
        F.nullif(F.trim(f[3]), F.lit("")).alias("note"),
        ranges.alias("ranges"),
        F.upper(F.regexp_replace(f[5], r"\s", "")).alias("seq"),
    )


def reason_counts(parsed: DataFrame, by: str = "batch_id") -> DataFrame:
    """Lines per `by` and reason; valid lines count under 'valid'."""
    return parsed.groupBy(by, F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_lines"))
