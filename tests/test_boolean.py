"""The query language: tokens, checks, trees and what they match."""

import itertools
from datetime import date

import pytest

from corpusloom.plans import boolean as b


def test_tokens():
    values = lambda q: [t.value for t in b.tokenize(q)]
    assert values('(virus AND bacteria)') == ["(", "virus", "AND", "bacteria", ")"]
    assert values('"""deep  water""" or l\'eau') == ['"deep  water"', "or", "leau"]
    assert values('foo"bar"') == ['"bar"', "foo"]
    assert values('a "open') == ["a", '"open'] and values('a "open b') == ["a", '"open b']
    assert [t.kind for t in b.tokenize("a and B Or not (c)")] == ["word", "and", "word", "or", "not", "open", "word", "close"]


@pytest.mark.parametrize(
    ("query", "kind", "text"),
    [
        ("", b.EmptyQueryError, "Empty query provided."),
        ('a AND "b', b.UnmatchedQuotesError, "Unmatched quotes found. Please, make sure all quotes are matched."),
        ("a AND ()", b.EmptyParenthesisError, "Empty parenthesis '()' not allowed."),
        ("(a AND b", b.UnmatchedParenthesesError, "Unmatched opening parenthesis found. Please, make sure all parenthesis are matched."),
        ("a)", b.UnmatchedParenthesesError, "Unmatched closing parenthesis found."),
        ("AND a", b.LogicalOperatorError, "Connector 'AND' can't start a query"),
        ("a OR", b.LogicalOperatorError, "Connector 'OR' can't end a query"),
        ("a AND NOT b", b.LogicalOperatorError, "Connector 'AND' can't precede NOT"),
        ("a NOT", b.LogicalOperatorError, "Invalid operator sequence: 'NOT' can't end a query"),
        ("a b", b.ExpressionValidationError, "Subject can't precede another subject"),
        ("a (b)", b.LogicalOperatorError, "Invalid operator sequence: search subject 'a' precede ("),
        ("(a) b", b.LogicalOperatorError, "Invalid operator sequence: ')' can't precede 'b'"),
        ("(AND a)", b.LogicalOperatorError, "Invalid operator sequence: '(' can't precede AND"),
    ],
)
def test_errors(query, kind, text):
    wrong = b.validate(b.tokenize(query))
    assert type(wrong) is kind and str(wrong) == text
    with pytest.raises(kind):
        b.process(query)


def test_canonical():
    assert b.process("virus AND (a OR b)") == "virus+AND+(a+OR+b)+"
    assert b.normalized("virus AND (a OR b)") == "virus AND (a OR b)"


W = b.Word


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("a", W("a")),
        ("a OR b AND c", b.And((b.Or((W("a"), W("b"))), W("c")))),
        ("a AND b OR c", b.Or((b.And((W("a"), W("b"))), W("c")))),
        ("a NOT b", b.And((W("a"), b.Not(W("b"))))),
        ("a OR b NOT c", b.And((b.Or((W("a"), W("b"))), b.Not(W("c"))))),
        ("NOT a OR b", b.And((W("b"), b.Not(W("a"))))),
        ("(a OR b) AND (c OR d) NOT e", b.And((b.Or((W("a"), W("b"))), b.Or((W("c"), W("d"))), b.Not(W("e"))))),
        ("(a AND b) OR (c AND d) NOT e", b.And((b.Or((b.And((W("a"), W("b"))), b.And((W("c"), W("d"))))), b.Not(W("e"))))),
        ("NOT a NOT b", b.And((b.Not(W("a")), b.Not(W("b"))))),
        ("a OR b NOT c NOT d", b.And((b.Or((W("a"), W("b"))), b.Not(W("c")), b.Not(W("d"))))),
    ],
)
def test_trees(query, tree):
    assert b.build(query) == tree


def test_legacy_faults():
    assert b.build("NOT a NOT b", legacy=True) == b.Not(W("a"))
    assert b.build("a OR b NOT c NOT d", legacy=True) == b.And((b.Or((W("a"), W("b"), b.Not(W("d")))), b.Not(W("c"))))
    assert b.build("a OR b NOT c NOT d NOT e", legacy=True) == b.And((b.Or((W("a"), W("b"), b.Not(W("d")))), b.Not(W("e"))))


def holds(node, words):
    if isinstance(node, b.Word):
        return node.value in words
    if isinstance(node, b.Not):
        return not holds(node.child, words)
    return (all if isinstance(node, b.And) else any)(holds(x, words) for x in node.children)


def test_compiled_predicate_agrees_with_the_tree(spark):
    from corpusloom.operators import search

    words = "abcd"
    texts = [" ".join(x) for n in range(5) for x in itertools.combinations(words, n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for q in ("a OR b AND c", "a AND b OR c NOT d", "NOT a OR b", "(a OR b) AND (c OR d)", "NOT a NOT b", "NOT (a OR b) AND c"):
        want = {k for k, t in enumerate(texts) if t and holds(b.build(q), t.split())}
        assert {r["doc_id"] for r in search.matching(df, q).collect()} == want, q


def test_search_details(spark):
    from corpusloom.operators import search

    df = spark.createDataFrame([(1, "Foo bar, foo-baz", date(2020, 1, 1)), (2, "bar foo", None), (3, "", date(2020, 1, 1)), (4, None, None)], "doc_id int, text string, day date")
    ids = lambda q, **k: [r["doc_id"] for r in search.matching(df, q, **k).orderBy("doc_id").collect()]
    assert ids('"foo bar"') == [1] and ids("foo") == [1, 2] and ids("foo-zzz") == [1, 2] and ids("!!!") == []
    assert ids("foo", begin=date(2020, 1, 1), end=date(2020, 1, 1), day="day") == [1]
    assert ids(b.EVERYTHING) == [1, 2]
    top = search.top(search.scored(df, "foo OR baz"), 5).collect()
    assert [r["doc_id"] for r in top] == [1, 2] and top[0]["score"] > top[1]["score"] > 0
    assert search.preview(df, "foo", least=2).first().asDict() == {"total": 2, "can_cluster": True, "can_continue": True}


def test_keywords_sources_ranges():
    assert set(b.keywords("europe and paris not (trainer or pitbull)")) == {"europe", "paris", "trainer", "pitbull"}
    assert b.keywords('"Big Dog" OR cat') == ["big dog", "cat"]
    assert b.checked_sources([" a", "b", "", "a"], ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        b.checked_sources(["x"], ["a"])
    with pytest.raises(ValueError):
        b.checked_range(date(2020, 1, 2), date(2020, 1, 1))
