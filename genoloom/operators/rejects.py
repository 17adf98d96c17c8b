"""Loading delimited lines: conforming ones become typed rows, every other line gets the reason that it failed.

The strict load keeps only lines that conform in every way and marks them by their record offset; these are subtracted
from all offsets with an anti-join, and only the remainder is diagnosed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.storage import cut, salted_join

#: Separators by name, texts that stand for null, the pattern of a number.
SEPARATORS = {"tab": "\t", "comma": ",", "semicolon": ";", "blank": " "}
NULL_TEXTS = ("", "na", "nan", "null", ".")
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
#: Marks (private use area) that stand for a mark and for a separator inside quotes while a line is divided.
MARK, MARKED, INSIDE = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class Check:
    """Rule for one numeric column: its name in column_list, and the interval it must lie in."""

    column: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False


def _unmark(x: Column, sep: Column) -> Column:
    return F.replace(F.replace(x, F.lit(MARK + INSIDE), sep), F.lit(MARK + MARKED), F.lit(MARK))


def _once(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """df with a struct of columns that are computed once for each row.

    The generator keeps the optimizer from putting their expressions into each place that uses them; within a function
    over the parts of a line that would take quadratic time.
    """
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias(name))


def dissect(lines: DataFrame, raw: str = "raw", separator: str = "separator") -> DataFrame:
    """Adds __quoting (a stray quote), __cells (the cells, quotes still around them), __count (their number) and __sep.

    Parts of the line between double quotes alternate: those at even places stand outside. Quotes are sound if an outside
    part touches a quote only by a separator, or is empty between two quotes (a doubled quote), and none is left open.
    """
    named = F.element_at(F.create_map(*[F.lit(x) for kv in SEPARATORS.items() for x in kv]), F.col(separator))
    text = F.coalesce(F.col(raw), F.lit(""))
    line = F.when(text.endswith("\r"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    df = _once(lines, "__l", sep=named, line=F.replace(line, F.lit(MARK), F.lit(MARK + MARKED)))
    sep = F.col("__l.sep")
    df = _once(df, "__q", parts=F.split(F.when(sep == " ", F.trim("__l.line")).otherwise(F.col("__l.line")), '"', -1))
    parts = F.col("__q.parts")
    n = F.size(parts)
    ends = lambda part: part.endswith(sep)
    starts = lambda part: part.startswith(sep)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    inner = F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))  # its even places (from 0) are inside quotes
    fine = F.forall(F.transform(inner, lambda part, i: (i % 2 == 0) | (part == "") | (starts(part) & ends(part))), lambda ok: ok)
    sound = (n % 2 == 1) & ((n == 1) | (((first == "") | ends(first)) & ((last == "") | starts(last)) & fine))
    outside = lambda part: F.when(sep == " ", F.regexp_replace(part, " +", " ")).otherwise(part)
    masked = F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.replace(part, sep, F.lit(MARK + INSIDE))).otherwise(outside(part)))
    whole = F.when(n == 1, outside(first)).otherwise(F.array_join(masked, '"'))
    cells = F.lit(None).cast("array<string>")
    for x in SEPARATORS.values():  # constant patterns of one character are never compiled
        cells = F.when(sep == x, F.split(whole, x, -1)).otherwise(cells)
    df = _once(df, "__c", quoting=F.coalesce(~sound, F.lit(False)), cells=cells)
    return df.select(
        *lines.columns, F.col("__l.sep").alias("__sep"), F.col("__c.quoting").alias("__quoting"), F.col("__c.cells").alias("__cells"), F.coalesce(F.size("__c.cells"), F.lit(-1)).alias("__count")
    )


def unquoted(one: Column, sep: Column) -> Column:
    """The text of a cell without its enclosing quotes and marks."""
    bare = F.when(one.startswith('"') & (F.length(one) >= 2), F.replace(F.substr(one, F.lit(2), F.length(one) - 2), F.lit('""'), F.lit('"'))).otherwise(one)
    return F.when(F.contains(one, F.lit(MARK)), _unmark(bare, sep)).otherwise(bare)


def number(t: Column) -> tuple[Column, Column]:
    """(the number or null, whether the trimmed text is neither a number nor one of the texts for null)."""
    blank = t.isNull() | F.lower(t).isin(*NULL_TEXTS)
    is_number = F.coalesce(t.rlike(NUMBER), F.lit(False))
    return F.when(is_number, t.try_cast("double")), ~blank & ~is_number


@dataclass
class Loaded:
    """rows: typed rows of the lines that conform. rejected: (line id, reason) of the others."""

    rows: DataFrame
    rejected: DataFrame


def load_lines(lines: DataFrame, files: DataFrame, checks: list[Check], line_id: str = "line_id") -> Loaded:
    """Divides the lines of delimited files into typed rows and rejected lines.

    lines: line_id (unique), file_id, line_no, raw; line 1 of a file is its header and is left out of both results.
    files: file_id (unique), separator, column_list. Other columns are ignored. Reasons, first that holds: `quoting`,
    `columns` (another number of cells than the file's list has), `value` (a checked column is no number, or outside its
    interval). A null line is an empty one; a line of an unknown file, or one with an unknown separator or no list, fails
    with `columns`. A line_no of null is no header. Empty tables give empty results.

    Typed rows have line_id, file_id, line_no, a double for each check (named in lower case) and `cells`, a list
    of the file's column names with the cell texts.
    """
    own = lines.select(F.col(line_id).alias("line_id"), "file_id", "line_no", "raw").where(F.coalesce(F.col("line_no") != 1, F.lit(True)))
    layout = files.select("file_id", "separator", F.split("column_list", ",", -1).alias("__names")).where("file_id IS NOT NULL")
    joined = salted_join(own, layout, ["file_id"], "left")
    at = {c.column: F.array_position(F.coalesce("__names", F.array().cast("array<string>")), c.column) for c in checks}

    def judged(df: DataFrame) -> DataFrame:
        df = dissect(df)
        ones = {c.column: F.try_element_at("__cells", F.when(at[c.column] > 0, at[c.column].cast("int"))) for c in checks}
        df = _once(df, "__o", **ones)
        df = _once(df, "__t", **{c.column: F.trim(unquoted(F.col(f"__o.{c.column}"), F.col("__sep"))) for c in checks})
        parsed = {c.column: number(F.col(f"__t.{c.column}")) for c in checks}
        df = _once(df, "__v", **{k: v for k, (v, _) in parsed.items()}, **{f"wrong_{k}": w for k, (_, w) in parsed.items()})
        bad = F.lit(False)
        for c in checks:
            v = F.col(f"__v.{c.column}")
            low = F.lit(False) if c.low is None else ((v <= c.low) if c.low_open else (v < c.low))
            high = F.lit(False) if c.high is None else v > c.high
            bad = bad | F.col(f"__v.wrong_{c.column}") | F.coalesce(low | high, F.lit(False))
        df = df.withColumn("__bad", bad)
        return df.withColumn("__misfit", (F.col("__count") != F.coalesce(F.size("__names"), F.lit(-2))) | F.col("__sep").isNull())

    strict = judged(joined).where("NOT __quoting AND NOT __misfit AND NOT __bad")
    plain = F.transform("__cells", lambda x: unquoted(x, F.col("__sep")))
    rows = cut(
        strict.select(
            "line_id", "file_id", "line_no", *[F.col(f"__v.{c.column}").alias(c.column.lower()) for c in checks],
            F.arrays_zip(F.col("__names").alias("name"), plain.alias("text")).alias("cells"),
        ),
        "lines",
    )
    rest = joined.join(rows.select("line_id"), "line_id", "left_anti")
    reason = F.when(F.col("__quoting"), "quoting").when(F.col("__misfit"), "columns").otherwise("value")
    return Loaded(rows, judged(rest).select("line_id", reason.alias("reason")))
