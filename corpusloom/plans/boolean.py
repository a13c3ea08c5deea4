"""The boolean text-query language: tokens, checks, tree, rewriting, and compilation to a Column.

Queries are short, so all of this runs on the driver; the compiled predicate is plain Catalyst.
Operators have one rank and bind from left to right: `a OR b AND c` is `(a OR b) AND c`.
`legacy=True` keeps two known faults of that language: an operand lost after a leading NOT, and
alternatives that are skipped or overwritten while several NOTs leave an OR.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS = {"AND": "and", "OR": "or", "NOT": "not", "(": "open", ")": "close"}
#: The query that stands for the whole corpus.
EVERYTHING = "__ALL__"


class QueryError(ValueError):
    """A query that breaks a rule of the language."""


class LogicalOperatorError(QueryError):
    pass


class UnmatchedParenthesesError(QueryError):
    pass


class UnmatchedQuotesError(QueryError):
    pass


class EmptyParenthesisError(QueryError):
    pass


class EmptyQueryError(QueryError):
    pass


class ExpressionValidationError(QueryError):
    pass


@dataclass(frozen=True)
class Token:
    value: str
    kind: str

    @classmethod
    def of(cls, value: str) -> Token:
        return cls(value, KEYWORDS.get(value.upper(), "word"))


def tokenize(query: str) -> list[Token]:
    """Tokens of a query. Quotes keep their phrase together, parentheses stand alone, apostrophes go.

    A word glued to a phrase's opening quote comes after the phrase; an unfinished phrase is a
    token only if no word is unfinished too.
    """
    found: list[Token] = []
    word, phrase = "", None

    def end_word() -> None:
        nonlocal word
        if word:
            found.append(Token.of(word))
        word = ""

    for c in re.sub('"+', '"', query):
        if phrase is not None:
            phrase += c
            if c == '"':
                found.append(Token.of(phrase))
                phrase = None
        elif c == '"':
            phrase = c
        elif c in "()":
            end_word()
            found.append(Token.of(c))
        elif c.isspace():
            end_word()
        elif c != "'":
            word += c
    if word:
        end_word()
    elif phrase:
        found.append(Token.of(phrase))
    return found


#: Kinds that may follow each kind.
FOLLOWERS = {
    "open": {"open", "word", "not"},
    "close": {"close", "and", "or", "not"},
    "and": {"word", "open"},
    "or": {"word", "open"},
    "not": {"word", "open"},
    "word": {"and", "or", "not", "close"},
}


def _pair_error(a: Token, b: Token) -> QueryError | None:
    """What is wrong with `b` behind `a`. The wordings are fixed values."""
    if b.kind in FOLLOWERS[a.kind]:
        return None
    if a.kind == "open":
        return EmptyParenthesisError("Empty parenthesis '()' not allowed.") if b.kind == "close" else LogicalOperatorError(f"Invalid operator sequence: '{a.value}' can't precede {b.value}")
    if a.kind == "close":
        return LogicalOperatorError(f"Invalid operator sequence: '{a.value}' can't precede '{b.value}'")
    if a.kind == "not":
        return LogicalOperatorError(f"Invalid operator sequence: '{a.value}' can't precede {b.value}")
    if a.kind == "word":
        if b.kind == "word":
            return ExpressionValidationError("Subject can't precede another subject")
        return LogicalOperatorError(f"Invalid operator sequence: search subject '{a.value}' precede {b.value}")
    return LogicalOperatorError(f"Connector '{a.value}' can't precede {b.value}")


def validate(tokens: list[Token]) -> QueryError | None:
    """The first rule that the tokens break, if any."""
    if not tokens:
        return EmptyQueryError("Empty query provided.")
    if sum(t.value.count('"') for t in tokens) % 2:
        return UnmatchedQuotesError("Unmatched quotes found. Please, make sure all quotes are matched.")
    depth, last = 0, len(tokens) - 1
    for i, t in enumerate(tokens):
        depth += {"open": 1, "close": -1}.get(t.kind, 0)
        if depth < 0:
            return UnmatchedParenthesesError("Unmatched closing parenthesis found.")
        if t.kind in ("and", "or") and i in (0, last):
            return LogicalOperatorError(f"Connector '{t.value}' can't {'start' if i == 0 else 'end'} a query")
        if t.kind == "not" and i == last:
            return LogicalOperatorError(f"Invalid operator sequence: '{t.value}' can't end a query")
        if i < last and (wrong := _pair_error(t, tokens[i + 1])):
            return wrong
    if depth:
        return UnmatchedParenthesesError("Unmatched opening parenthesis found. Please, make sure all parenthesis are matched.")
    return None


def canonical(tokens: list[Token]) -> str:
    """The query as one string in which `+` stands for blanks."""
    text = "".join(t.value + ("" if t.kind == "open" or (i + 1 < len(tokens) and tokens[i + 1].kind == "close") else "+") for i, t in enumerate(tokens))
    return text if not text or text.endswith("+") else text + "+"


def process(query: str) -> str:
    """Tokens, checks and the canonical string; raises what the checks find."""
    tokens = tokenize(query)
    if wrong := validate(tokens):
        raise wrong
    return canonical(tokens)


def normalized(query: str) -> str:
    """The canonical string with blanks again; a literal `+` becomes one too."""
    return process(query).replace("+", " ").strip()


@dataclass(frozen=True)
class Word:
    value: str


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


Node = Word | Not | And | Or


def _joined(kind: type, a: Node, b: Node) -> Node:
    """An n-ary node; nodes of the same kind merge."""
    parts = [x.children if isinstance(x, kind) else (x,) for x in (a, b)]
    return kind(parts[0] + parts[1])


def parse(tokens: list[Token], legacy: bool = False) -> Node:
    """The tree of checked tokens, read from left to right."""
    rest = iter(tokens)

    def operand(t: Token) -> Node:
        return expression() if t.kind == "open" else Word(t.value)

    def expression() -> Node:
        node: Node | None = None
        kind: type | None = None
        spent = False
        for t in rest:
            if t.kind == "close":
                break
            if t.kind in ("and", "or"):
                kind = And if t.kind == "and" else Or
                continue
            new = Not(operand(next(rest))) if t.kind == "not" else operand(t)
            if node is None:
                node = new
            elif kind is None and legacy and isinstance(node, Not) and not spent:
                spent = True
            else:
                node = _joined(kind or (Or if isinstance(node, Or) else And), node, new)
            kind = None
        return node

    return expression()


def hoist(node: Node, legacy: bool = False) -> Node:
    """NOT among alternatives applies to all of them: `a OR b NOT c` is `(a OR b) AND NOT c`."""
    if isinstance(node, Word):
        return node
    if isinstance(node, Not):
        return Not(hoist(node.child, legacy))
    if isinstance(node, And):
        return And(tuple(hoist(x, legacy) for x in node.children))
    stay, gone, i = list(node.children), [], 0
    while i < len(stay):
        if isinstance(stay[i], Not):
            gone = ([] if legacy else gone) + [stay.pop(i)]
            i += legacy
        else:
            i += 1
    stay = [hoist(x, legacy) for x in stay]
    kept: tuple[Node, ...] = (stay[0] if len(stay) == 1 else Or(tuple(stay)),) if stay else ()
    parts = kept + tuple(hoist(x, legacy) for x in gone)
    return parts[0] if len(parts) == 1 else And(parts)


def build(query: str, legacy: bool = False) -> Node:
    tokens = tokenize(query)
    if wrong := validate(tokens):
        raise wrong
    return hoist(parse(tokens, legacy), legacy)


#: Tokens of the search index: runs of letters, digits and underscores.
ANALYZED = re.compile(r"\w+")


def analyzed(value: str) -> list[str]:
    return ANALYZED.findall(value.strip('"').lower())


def compiled(node: Node, padded: Column) -> Column:
    """The predicate on `padded`: a text's tokens, each with a blank on either side."""
    if isinstance(node, Word):
        words = analyzed(node.value)
        if not words:
            return F.lit(False)
        if '"' in node.value:
            return padded.contains(" " + " ".join(words) + " ")
        return _fold([padded.contains(f" {w} ") for w in words], Column.__or__)
    if isinstance(node, Not):
        return ~compiled(node.child, padded)
    return _fold([compiled(x, padded) for x in node.children], Column.__and__ if isinstance(node, And) else Column.__or__)


def _fold(parts: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = join(out, p)
    return out


def scoring_terms(node: Node) -> list[list[str]]:
    """Words and phrases that add to a hit's score: all outside of NOT."""
    if isinstance(node, Word):
        words = analyzed(node.value)
        return [words] if '"' in node.value else [[w] for w in words]
    if isinstance(node, Not):
        return []
    return [t for x in node.children for t in scoring_terms(x)]


def keywords(query: str) -> list[str]:
    """Quoted phrases and words of a query in lower case, without its operators."""
    found = [a or b for a, b in re.findall(r'"([^"]+)"|([\w\-]+)', query.lower())]
    return [w for w in found if w not in ("and", "or", "not")]


def checked_sources(sources: Iterable[str], known: Iterable[str]) -> list[str]:
    """Trimmed, without blanks and repeats, in order; a source that is not known is an error."""
    out = list(dict.fromkeys(s.strip() for s in sources if s.strip()))
    if unknown := [s for s in out if s not in set(known)]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return out


def checked_range(begin: date, end: date) -> tuple[date, date]:
    if end < begin:
        raise ValueError("the range ends before it begins")
    return begin, end


def from_text(text: str, model: Callable[[str], str]) -> str:
    """A model's query for a text, checked; a query with NOT is refused, as models are told to use AND and OR."""
    tokens = tokenize(model(text))
    if wrong := validate(tokens):
        raise wrong
    if any(t.kind == "not" for t in tokens):
        raise LogicalOperatorError("NOT is not asked for")
    return canonical(tokens).replace("+", " ").strip()
