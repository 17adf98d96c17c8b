import csv
import io
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from genoloom.operators.rejects import SEPARATORS, Check, load_lines
from genoloom.plans.lines import CHECKS

FILES = "file_id int, separator string, column_list string, raw string"
LINES = "line_id bigint, file_id int, line_no int, raw string, separator string"


def run(spark, lines, files):
    out = load_lines(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES), CHECKS)
    return {r.line_id: r.reason for r in out.rejected.collect()}, {r.line_id: r for r in out.rows.collect()}


COLS = "SNP,BETA,SE,PVAL,NOTE"


def test_reasons_and_rows(spark):
    raw = ["a,1,2,.5,x", 'a,1,2,0.5,"x, ""y"""\r', 'a,1,2,0.5,"x', "a,1,2,0.5", "a,1,2,0.5,x,y", "a,x,2,0.5,", "a,NaN,na,.,", "a,1,0,0.5,", "a,1,1,1.5,", 'a,"1e-3"," 2 ",+.5E-2,"l1\nl2"', 'a"b,1,1,1,', '"a"b,1,1,1,', "a,1.2.3,1,1,", "a,,,,", None, "", "a,٣,1,1,x"]
    bad, good = run(spark, [(k, 1, k + 2, r, "s") for k, r in enumerate(raw)], [(1, "comma", COLS, None)])
    assert bad == {2: "quoting", 3: "columns", 4: "columns", 5: "value", 7: "value", 8: "value", 10: "quoting", 11: "quoting", 12: "value", 14: "columns", 15: "columns", 16: "value"}
    assert set(good) == {0, 1, 6, 9, 13}
    assert good[9].beta == 1e-3 and good[9].se == 2.0 and good[9].pval == 0.005
    assert {c.name: c.text for c in good[1].cells}["NOTE"] == 'x, "y"'


def test_blank_headers_unknown_files_and_empty(spark):
    lines = [(1, 1, 1, "SNP BETA SE PVAL", None), (2, 1, 2, "  a   1 2  0.5 \r", None), (3, 1, 3, 'a "1" 2 0.5 9', None), (4, 9, 2, "a", None), (5, None, 2, "a", None), (6, 1, None, "a 1 2 0.5", None)]
    bad, good = run(spark, lines, [(1, "blank", "SNP,BETA,SE,PVAL", None), (None, "comma", "A", None)])
    assert bad == {3: "columns", 4: "columns", 5: "columns"} and set(good) == {2, 6}
    assert run(spark, [], []) == ({}, {})


def test_very_long_line(spark):
    bad, good = run(spark, [(1, 1, 2, 'a,1,2,0.5,"' + '""x,' * 60_000 + '"', None), (2, 1, 3, "," * 100_000, None)], [(1, "comma", COLS, None)])
    assert set(good) == {1} and bad == {2: "columns"}


def reference(raw, sep, names):
    """A plain reader, one character at a time."""
    raw = raw[:-1] if raw.endswith("\r") else raw
    raw = raw.strip(" ") if sep == " " else raw
    cells, k = [], 0
    while True:
        if k < len(raw) and raw[k] == '"':
            k, text = k + 1, ""
            while True:
                if k >= len(raw):
                    return "quoting"
                if raw[k] == '"':
                    if raw[k + 1 : k + 2] != '"':
                        break
                    k += 1
                text += raw[k]
                k += 1
            k += 1
            if k < len(raw) and raw[k] != sep:
                return "quoting"
            cells.append(text)
        else:
            end = raw.find(sep, k)
            end = len(raw) if end < 0 else end
            if '"' in raw[k:end]:
                return "quoting"
            cells.append(raw[k:end])
            k = end
        if k >= len(raw):
            break
        k += 1
        while sep == " " and raw[k] == " ":
            k += 1
    if len(cells) != len(names):
        return "columns"
    for c in CHECKS:
        t = cells[names.index(c.column)].strip(" ")
        if t.lower() in ("", "na", "nan", "null", "."):
            continue
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t):
            return "value"
        x = float(t)
        if (c.column == "SE" and x <= 0) or (c.column == "PVAL" and not 0 <= x <= 1):
            return "value"
    return None


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='",; \ta1.5\r\n', max_size=14), min_size=60, max_size=60))
@pytest.mark.parametrize("separator", sorted(SEPARATORS))
def test_equals_a_plain_reader(spark, separator, raws):
    names = ["BETA", "SE", "PVAL"]
    bad, good = run(spark, [(k, 1, 2, r, None) for k, r in enumerate(raws)], [(1, separator, ",".join(names), None)])
    want = {k: w for k, r in enumerate(raws) if (w := reference(r, SEPARATORS[separator], names))}
    assert bad == want and set(good) == set(range(len(raws))) - set(want)


def test_round_trip_of_quoted_cells(spark):
    texts = ["plain", "a,b", 'say "x"', "two\nlines", "", " lead", '"', ""]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\x1e")
    for t in texts:
        w.writerow([t, "1"])
    lines = [(k, 1, 2, r, None) for k, r in enumerate(out.getvalue().split("\x1e")[:-1])]
    got = load_lines(spark.createDataFrame(lines, LINES), spark.createDataFrame([(1, "comma", "T,V", None)], FILES), [Check("V")])
    assert {r.line_id: r.cells[0].text for r in got.rows.collect()} == dict(enumerate(texts))
