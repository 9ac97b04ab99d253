"""Packed fields: every delimiter, quoting, missing markers, and a brute-force splitter on plain cells."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.operators.packed import explode_packed, split_cells


def split(*cells):
    parents, positions, values = split_cells(pa.array(cells, pa.string()))
    out = [[] for _ in cells]
    for p, n, v in zip(parents, positions, values.to_pylist()):
        assert n == len(out[p]) + 1
        out[p].append(v)
    return out


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        (None, []), ("", []), ("-", []), ("n/a", []), ("Unknown", []), (" \t ", []),
        ("Ada Li, Bo Xu and Cy Do et al.", ["Ada Li", "Bo Xu", "Cy Do"]),
        ("Li, Ada", ["Li, Ada"]), ("Li, A., Xu, B.", ["Li, A.", "Xu, B."]), ("de la Li, Ada K., van Xu, Bo", ["de la Li, Ada K.", "van Xu, Bo"]),
        ("Li, Ada; Xu, Bo", ["Li, Ada", "Xu, Bo"]), ("Ada Li; Bo Xu,Cy Do | Di Ek & Ed Fo", ["Ada Li", "Bo Xu", "Cy Do", "Di Ek", "Ed Fo"]),
        ('"Li, Ada","Eva ""Evi"" Xu"', ["Li, Ada", 'Eva "Evi" Xu']), ('["Li, Ada", "Eva \\"Evi\\" Xu"]', ["Li, Ada", 'Eva "Evi" Xu']),
        ("'O'Li, Ada'; 'Xu, B.'", ["O'Li, Ada", "Xu, B."]), ("[1] Ada Li [2] Bo Xu", ["Ada Li", "Bo Xu"]), ("1) Ada Li; 2) Bo Xu", ["Ada Li", "Bo Xu"]),
        ("Ada Li,, Bo Xu,", ["Ada Li", "Bo Xu"]), ("Ada Li\r\nBo Xu\tCy Do", ["Ada Li", "Bo Xu", "Cy Do"]), ("Ada Li，Bo Xu；Cy Do、Di Ek", ["Ada Li", "Bo Xu", "Cy Do", "Di Ek"]),
        ("Ada Li · Bo Xu", ["Ada Li", "Bo Xu"]), ("曦文北, Ada Li", ["曦文北", "Ada Li"]), ("Ada O'Li, Bo Xu", ["Ada O'Li", "Bo Xu"]), ("Ada Li/Bo Xu", ["Ada Li", "Bo Xu"]),
    ],
)
def test_cells(cell, want):
    assert split("Zed Qu", cell, "Yo Wu; Xi Vo") == [["Zed Qu"], want, ["Yo Wu", "Xi Vo"]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Ada Li", "Élan Ök", "曦文北", "Jo van Xu", "M. de la Fo"]), max_size=6), max_size=5), st.sampled_from([";", " | ", "\n", " & ", "；", "\t"]))
def test_against_brute_force(rows, sep):
    assert split(*[sep.join(r) for r in rows]) == rows


def test_long_cell_and_spark(spark):
    assert len(split("; ".join(["Ada Li"] * 50_000))[0]) == 50_000
    df = spark.createDataFrame([(1, "A Li; B Xu", "x"), (1, "A Li; B Xu", "x"), (2, None, "y")], "id long, authors string, value string")
    rows = sorted((r.id, r.pos, r.value) for r in explode_packed(df, "authors").collect())
    assert rows == [(1, 1, "A Li"), (1, 1, "A Li"), (1, 2, "B Xu"), (1, 2, "B Xu")]
    assert explode_packed(df.limit(0), "authors").count() == 0
