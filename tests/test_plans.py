"""Filters, structured queries, analyzers and stemming without Spark rows."""

import random

import pytest

from cairn.errors import CairnError
from cairn.functions.analysis import Analyzer
from cairn.functions.stemming import english
from cairn.plans import filters, query_string
from cairn.plans.query_string import osa_within


@pytest.mark.parametrize("text", ["", "a ==", "a == 1 and", "a in [1", "(a == 1", "a like 5", "a not == 1", "a ~ 1", "a == 1e5", "a == 1.2.3", "1 == a"])
def test_bad_filters_are_refused(text):
    with pytest.raises(CairnError):
        filters.parse(text)


def test_filter_precedence():
    tree = filters.parse("not a == 1 and b == 2 or c == 3")
    assert isinstance(tree, filters.Any_) and isinstance(tree.parts[0], filters.All) and isinstance(tree.parts[0].parts[0], filters.Not)


@pytest.mark.parametrize("text", ["", "-a", "a AND", "(a", "[a TO b", "a && b", '"a', "a~3", "a^0", "(-a -b)", "other:x", "+a NOT +a", "*x~1"])
def test_bad_queries_are_refused(text):
    with pytest.raises(CairnError):
        query_string.parse(text, Analyzer(), "body")


def test_query_trees():
    tree = query_string.parse('a +b -c "d e"~2 f*^2 [x TO *]', Analyzer(), "body")
    assert [(p.kind, p.sign) for p in tree.parts] == [("term", ""), ("term", "+"), ("term", "-"), ("phrase", ""), ("match", ""), ("match", "")]
    assert query_string.parse("(-a) b", Analyzer(), "body").parts[0].sign == ""
    assert query_string.parse("* ", Analyzer(), "body").kind == "all"


def brute_osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_fuzzy_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        for most in (1, 2):
            assert osa_within(a, b, most) == (brute_osa(a, b) <= most)


def test_analyzers():
    assert Analyzer().tokens("Don't  STOP_me, 3rd") == ["don", "t", "stop", "me", "3rd"]
    assert Analyzer("standard", (), {"max_token_length": 2}).tokens("abcde") == ["ab", "cd", "e"]
    assert Analyzer("ngram", (), {"ngram_min": 2, "ngram_max": 3, "token_chars": ["letter"]}).tokens("ab1cde") == ["ab", "cd", "cde", "de"]
    assert Analyzer("standard", ("lowercase", "ascii_folding")).tokens("Ærø Straße Ñandú") == ["aero", "strasse", "nandu"]
    for bad in (("jieba",), ("none",), ("standard", ("stop",)), ("ngram", (), {"ngram_min": 1, "ngram_max": 3}), ("standard", ("stemmer",), {"stemmer_lang": "french"})):
        with pytest.raises(CairnError):
            Analyzer(*bad)


def test_english_stems():
    # Pairs from the algorithm's published sample vocabulary.
    pairs = "consign consign consigned consign consigning consign consignment consign consistency consist knightly knight knots knot generally general national nation hopping hop hoping hope relational relat flies fli dying die skies sky happiness happi conditional condit"
    words = pairs.split()
    assert [english(w) for w in words[::2]] == words[1::2]
