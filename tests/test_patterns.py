import re

import pytest

from sondage.functions.patterns import escape, glob_to_regex, java_regex, query_tokens, query_trigrams, regex_prefix


def globbed(glob, path):
    return re.match(glob_to_regex(glob).replace(r"\z", r"\Z"), path) is not None


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("src/*.rs", "src/a.rs", True),
        ("src/*.rs", "src/x/a.rs", False),
        ("src/**/*.rs", "src/x/y/a.rs", True),
        ("src/**/*.rs", "src/a.rs", True),
        ("**/*.rs", "a.rs", True),
        ("src/**", "src/x/y", True),
        ("a?c", "abc", True),
        ("a?c", "a/c", False),
        ("[ab].rs", "a.rs", True),
        ("[!ab].rs", "a.rs", False),
        ("*.{rs,py}", "x.py", True),
        ("a.rs", "xa.rs", False),
        ("a+b", "a+b", True),
    ],
)
def test_globs(glob, path, hit):
    assert globbed(glob, path) is hit


def test_malformed_globs():
    assert glob_to_regex("[ab") is None and glob_to_regex("{a,b") is None and glob_to_regex("a\\") is None


@pytest.mark.parametrize(
    ("pattern", "prefix"),
    [
        ("foobar", "foobar"),
        ("^foobar", "foobar"),
        ("foo.*", "foo"),
        ("foob*", "foo"),
        ("foo*", None),
        ("gamma|other", None),
        (r"gam\|ma", "gam|ma"),
        (r"fn\s+", None),
        (r"abc\.d", "abc.d"),
        (r"\w+", None),
        ("ab", None),
        ("abcd{2}", "abc"),
        ("(abc)", None),
    ],
)
def test_prefixes(pattern, prefix):
    assert regex_prefix(pattern) == prefix


def test_dialect():
    assert java_regex(r"a(?=b)") is None and java_regex(r"(a)\1") is None and java_regex("(?<!x)y") is None and java_regex("[a") is None
    assert java_regex(r"(?P<n>x)") == "(?Ud)(?<n>x)"
    assert java_regex("a$", whole_text=True) == r"(?Ud)a\z" and java_regex(r"a\$", whole_text=True) == r"(?Ud)a\$"
    assert java_regex("[[:alpha:]$]") == r"(?Ud)[\p{Alpha}$]"
    assert re.fullmatch(escape("a.b*c[1]|(x)-{2}^$#&~+?"), "a.b*c[1]|(x)-{2}^$#&~+?")


def test_query_tokens():
    assert query_tokens("handleError a fooBar_baz") == [("handle", 0), ("error", 1), ("foo", 3), ("bar", 4), ("baz", 5)]
    assert query_trigrams("ab") == [] and query_trigrams("aaaa") == [0x616161]
