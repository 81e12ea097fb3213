from hypothesis import given
from hypothesis import strategies as st
import pytest

from sondage.plans.parser import build_pattern, parse_date, parse_query
from sondage.plans.syntax import And, Boosted, Empty, Literal, Near, Not, Or, Phrase, Regex


@pytest.mark.parametrize(
    ("text", "root"),
    [
        ("foo", Literal("foo")),
        ("foo bar", And((Literal("foo"), Literal("bar")))),
        ("a | b c", Or((Literal("a"), And((Literal("b"), Literal("c")))))),
        ("foo -bar", And((Literal("foo"), Not(Literal("bar"))))),
        ("test-project", And((Literal("test"), Not(Literal("project"))))),
        ("a->b", And((Literal("a"), Not(Literal(">b"))))),
        ("(a | b) c", And((Or((Literal("a"), Literal("b"))), Literal("c")))),
        ("(a", Literal("a")),
        ("a) b", Literal("a")),
        ('"static void"', Phrase("static void")),
        ('"open', Phrase("open")),
        ('""', Phrase("")),
        (r"re:/fn\s+\w+/", Regex(r"fn\s+\w+")),
        ("re:/a/b", And((Regex("a"), Literal("b")))),
        ("^foo", Boosted("foo", 2.0)),
        ("^3:foo", Boosted("foo", 3.0)),
        ('^1.5:"a b"', Boosted("a b", 1.5)),
        ("^1.2.3:x", Boosted("x", 2.0)),
        ("^3", Empty()),
        ("^3x", Boosted("3x", 2.0)),
        ("^re:/x/", Regex("x")),
        ("near:a,b", Near(("a", "b"), 10)),
        ("near:a,b,5", Near(("a", "b"), 5)),
        ("near:a,5", Literal("a")),
        ("near:a", Empty()),
        ("std::vector", Literal("std::vector")),
        ("note:x", Literal("note:x")),
        ("1.0.0", And((Literal("1"), Literal(".0.0")))),
        ("größe", Literal("größe")),
        ("", Empty()),
        ("| a", Or((Empty(), Literal("a")))),
    ],
)
def test_roots(text, root):
    assert parse_query(text).root == root


def test_filters_are_global_and_the_last_wins():
    q = parse_query("foo | -(bar EXT:py ext:rs) lang:go path:src/** name:Main.RS size:>10 size:<20 line:3-")
    f = q.filters
    assert (f.ext, f.lang, f.path, f.filename, f.size_min, f.size_max, f.line_start, f.line_end) == ("rs", "go", "src/**", "Main.RS", 10, 20, 3, None)


@pytest.mark.parametrize(
    ("value", "low", "high"),
    [
        (">100", 100, None),
        ("<100", None, 100),
        ("100", 100, 86500),
        ("2024-02-29", 1709164800, 1709251200),
        (">2024-03-01", 1709251200, None),
        ("soon", None, None),
        ("2024-13-01", None, None),
    ],
)
def test_mtime(value, low, high):
    f = parse_query(f"mtime:{value}").filters
    assert (f.mtime_min, f.mtime_max) == (low, high)


def test_dates_spill_over():
    assert parse_date("2023-02-31") == parse_date("2023-03-03")
    assert parse_date("1969-01-01") is None


def test_options():
    q = parse_query("x sort:Recent top:0")
    assert (q.sort, q.limit) == ("recency", 0)
    assert parse_query("x sort:nonsense top:many").sort == "score"
    assert parse_query("x top:many").limit == 100


def test_emptiness():
    assert parse_query("").is_empty() and parse_query("near:a").is_empty()
    assert not parse_query("ext:rs").is_empty()
    assert not parse_query("top:5 sort:path").is_empty()


def test_command_line_patterns():
    assert build_pattern(["a b"]) == "a b"
    assert build_pattern(["a.b", "c"]) == r"re:/a\.b|c/"
    assert build_pattern(["x"], word=True) == r"re:/\bx\b/"
    assert build_pattern([]) == ""


@given(st.text(alphabet='ab ()|-^"re:/near,ext.5<>\n\té', max_size=40) | st.text(max_size=30))
def test_never_fails(text):
    parse_query(text)
