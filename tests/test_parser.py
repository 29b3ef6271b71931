import pytest

from tideline.plans.compiler import kind
from tideline.plans.parser import duration, parse
from tideline.plans.tree import Aggregate, Binary, Call, Matcher, Matching, Number, QueryError, Selector, Subquery, Unary


def test_selectors():
    assert parse('up{job="a",x!~"b|c",} offset 5m') == Selector("up", (Matcher("job", "=", "a"), Matcher("x", "!~", "b|c")), None, 300_000)
    assert parse("up[1h] offset 1d") == Selector("up", (), 3_600_000, 86_400_000)
    assert parse("rate(a:b[5m:10s])") == Call("rate", (Subquery(Selector("a:b"), 300_000, 10_000),))


def test_precedence():
    a, b, c = Selector("a"), Selector("b"), Selector("c")
    assert parse("a - b + c") == Binary("+", Binary("-", a, b), c)
    assert parse("a ^ b ^ c") == Binary("^", a, Binary("^", b, c))
    assert parse("a or b and c") == Binary("or", a, Binary("and", b, c))
    assert parse("a + b * c == a") == Binary("==", Binary("+", a, Binary("*", b, c)), a)
    assert parse("-a ^ b") == Unary("-", Binary("^", a, b))


def test_modifiers():
    assert parse("a == bool on (x) group_left (y) b").matching == Matching(("x",), (), "left", ("y",))
    assert parse("a * ignoring (x) group_right b").matching == Matching(None, ("x",), "right", ())
    assert parse("a * on (x) group_left (b)").right == Selector("b")
    assert parse("sum by (x) (a)") == parse("sum(a) by (x)") == Aggregate("sum", Selector("a"), None, ("x",), None)
    assert parse("topk without (x) (3, a)") == Aggregate("topk", Selector("a"), Number(3.0), None, ("x",))


@pytest.mark.parametrize("text, value", [("1e3", 1000), (".5", 0.5), ("2.", 2), ("-1", -1), ("+Inf", float("inf")), ("0x1f", 31), ("iNf", float("inf"))])
def test_numbers(text, value):
    assert parse(text) == Number(value)


@pytest.mark.parametrize("text", ["", "a b", "a{", "a[5m", "a[5]", "--a", "a{x}", "sum(a, b)", "topk(a)", "(a", "a offset", "a + ", "1 offset 5m", "a{x=1}", "$"])
def test_syntax_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["rate(a)", "abs(a[5m])", "nope(a)", "a and 1", "a + bool b", "1 > 2", "{}", '{x=~".*"}', '{x!~"foo"}', '{x=~"a|"}', '{x!="a"}', "sum(1)", "count_values(1, a)", "topk('a', b)", "a and on(x) group_left b", "1 + on(x) a", "a * on(x) group_left(x) b", "label_replace(a)", '"text" + 1', "time(1)"])
def test_type_errors(text):
    with pytest.raises(QueryError):
        kind(parse(text))


def test_durations():
    assert [duration(x) for x in ("5ms", "1.5s", "2m", "1h", "1d", "1w", "1y")] == [5, 1500, 120_000, 3_600_000, 86_400_000, 604_800_000, 31_536_000_000]
