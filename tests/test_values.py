import pytest
from hypothesis import given
from hypothesis import strategies as st

from epochal.functions.values import decode, encode
from epochal.plans.statements import parse_literal
from epochal.functions.expressions import literal_text
from epochal.plans.wire import Result, parse_line

VALUES = st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False), st.text())


@given(VALUES)
def test_codec_round_trip(v):
    got = decode(encode(v))
    assert got == v and (type(got) is type(v) or isinstance(v, float))


@given(st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.text()))
def test_literal_round_trip(v):
    assert parse_literal(literal_text(v)) == v


@given(st.lists(st.tuples(st.integers(), st.integers(), st.one_of(st.none(), st.booleans(), st.integers(), st.text(st.characters(exclude_characters=";"))))))
def test_line_round_trip(rows):
    assert parse_line(Result("segments", data=rows).wire()).data == rows


def test_text():
    assert [encode(v) for v in (42, 3.14, "a b:%", True, None, 20.0)] == ["i42", "f3.14", "sa%20b%3A%25", "b1", "n", "f20"]
    with pytest.raises(ValueError):
        parse_line("RANGE 2; 1:2:i3")
