import math
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from mapweave.functions import exact
from mapweave.functions.exact import BuiltinError, evaluate, merged


@pytest.mark.parametrize(
    "name, args, want",
    [
        ("concat", ["x-", 7, False], "x-7false"), ("concat", [], ""), ("concat", [None, "z"], "z"),
        ("uppercase", ["oslo"], "OSLO"), ("uppercase", [None], ""), ("uppercase", ["ß", "ignored"], "SS"), ("lowercase", ["ÅB"], "åb"),
        ("trim", ["\x00\t q  "], "q"), ("trim", [" a b "], "a b"),
        ("pad_left", ["7", 4, "-"], "---7"), ("pad_left", ["oslo", 2], "oslo"), ("pad_left", [None, 6, "xy"], "xxnull"), ("pad_right", ["q", "4"], "q   "),
        ("lookup", ["no", {"se": "Sweden"}, "elsewhere"], "elsewhere"), ("lookup", ["se", {"se": None}, "d"], "d"), ("lookup", ["n", {"n": 47}], 47), ("lookup", [1, {"1": "x"}], None), ("lookup", ["n"], None),
        ("add", [20, Decimal("0.75"), "2"], 22.75), ("add", [8, -3], 5), ("subtract", [20, 4, 9], 7), ("multiply", ["2e2", 3], 600), ("divide", [3, 16], 0.1875), ("divide", [90, 5, 6], 3),
        ("min", [8, "-4", 0], -4), ("max", [Decimal("7.50")], 7.5), ("abs", [-11, "x"], 11), ("add", [2**63, 0], float(2**63)), ("add", [2**63 - 1, 0], 2**63 - 1),
    ],
)
def test_values(name, args, want):
    got = evaluate(name, args)
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize(
    "name, args",
    [
        ("divide", [9, 0]), ("divide", [2, 7]), ("divide", [5]), ("add", [8]), ("add", [8, "q"]), ("add", [8, None]), ("add", [8, False]), ("add", [8, " 2"]), ("min", []), ("min", [8, None]),
        ("lookup", ["se", "Sweden"]), ("lookup", []), ("uppercase", []), ("pad_left", ["q"]), ("pad_left", ["q", 3, ""]), ("pad_left", ["q", "x"]), ("abs", [None]),
    ],
)
def test_errors(name, args):
    with pytest.raises(BuiltinError):
        evaluate(name, args)


def test_argument_merge():
    assert evaluate("concat", merged(("call ",), ("own", 1))) == "call own1"
    assert merged((), ("own",)) == ["own"]


@given(st.lists(st.integers(-(10**12), 10**12), min_size=2, max_size=5))
def test_whole_arithmetic(xs):
    assert evaluate("add", xs) == sum(xs)
    assert evaluate("subtract", xs) == xs[0] - sum(xs[1:])
    assert evaluate("min", xs) == min(xs) and evaluate("max", xs) == max(xs)


@given(st.text(max_size=20), st.integers(-3, 30))
def test_padding_never_cuts(text, n):
    left, right = evaluate("pad_left", [text, n, "*"]), evaluate("pad_right", [text, n, "*"])
    assert len(left) == len(right) == max(n, len(text)) and left.endswith(text) and right.startswith(text)


def test_reduction_and_text():
    assert exact.reduced(Decimal("42.000")) == 42 and math.isclose(exact.reduced(Decimal("0.1")), 0.1)
    assert exact.text_of({"a": [1, None, True]}) == "{a=[1, null, true]}"
