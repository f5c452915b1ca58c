"""Boolean search in two dialects, compiled to one flag per term and one condition over the flags.

A query is lexed, its operands tokenized, put in postfix order and run on a stack, as set machines do. Here the stack
holds Columns: a document is in an operand's set if its flag for the term is up, so union, intersection and complement are
|, & and ~ of flags. The same machine run on False tells whether documents without any term can match; only then are
documents without postings joined in. Odd queries give what a set machine gives: too few operands, no document; operands
left over, the last one's documents; an unmatched opening parenthesis is an operand that no document has.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.index import Index
from lexispark.operators.search import query_tokens

RANK = {"NOT": 3, "AND": 2, "OR": 1}
TOP, PAGE = 10, 50

#: (kind, value): kind is "op", "(", ")" or "term".
Token = tuple[str, str]


def lex_keywords(query: str) -> list[Token]:
    """Words and, or, not are operators, in any case; blanks and parentheses part the rest."""
    out: list[Token] = []
    for piece in re.findall(r"[()]|[^\s()]+", query):
        word = piece.lower()
        if word in "()":
            out.append((word, word))
        elif word in ("and", "or", "not"):
            out.append(("op", word.upper()))
        else:
            out += [("term", t) for t in query_tokens(piece)]
    return out


def lex_symbols(query: str) -> list[Token]:
    """&&, || and ! are operators; neighbours without one are joined by AND."""
    out: list[Token] = []
    names = {"&&": "AND", "||": "OR", "!": "NOT"}
    for piece in re.findall(r"&&|\|\||[!()]|(?:(?!&&|\|\|)[^\s!()])+", query):
        if piece in names:
            out.append(("op", names[piece]))
        elif piece in "()":
            out.append((piece, piece))
        else:
            out += [("term", t) for t in query_tokens(piece)]
    joined: list[Token] = []
    for t in out:
        opens = t[0] in ("term", "(") or t == ("op", "NOT")
        if joined and joined[-1][0] in ("term", ")") and opens:
            joined.append(("op", "AND"))
        joined.append(t)
    return joined


DIALECTS: dict[str, Callable[[str], list[Token]]] = {"keyword": lex_keywords, "symbol": lex_symbols}


def postfix(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    held: list[Token] = []
    for t in tokens:
        kind, value = t
        if kind == "term":
            out.append(t)
        elif kind == "(":
            held.append(t)
        elif kind == ")":
            while held and held[-1][0] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        else:
            while held and held[-1][0] == "op" and RANK[held[-1][1]] >= RANK[value]:
                out.append(held.pop())
            held.append(t)
    return out + held[::-1]


def evaluate(program: list[Token], of_term: Callable, false, both: Callable, either: Callable, without: Callable):
    """Run a postfix program on any kind of set."""
    stack: list = []
    for kind, value in program:
        if kind == "term":
            stack.append(of_term(value))
        elif kind == "(":
            stack.append(false)
        elif value == "NOT":
            if not stack:
                return false
            stack.append(without(stack.pop()))
        else:
            if len(stack) < 2:
                return false
            right, left = stack.pop(), stack.pop()
            stack.append(both(left, right) if value == "AND" else either(left, right))
    return stack[-1] if stack else false


def matches(index: Index, query: str, dialect: str = "symbol") -> DataFrame:
    """doc_id of every match."""
    program = postfix(DIALECTS[dialect](query))
    terms = list(dict.fromkeys(v for k, v in program if k == "term"))
    flags = {t: f"f{i}" for i, t in enumerate(terms)}
    logic = (lambda a, b: a & b, lambda a, b: a | b)
    condition: Column = evaluate(program, lambda t: F.col(flags[t]), F.lit(False), *logic, lambda a: ~a)
    from_none = evaluate(program, lambda t: False, False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)
    if not terms:
        return index.docs.select("doc_id").where(F.lit(bool(from_none)))
    found = index.postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == t).alias(f) for t, f in flags.items()])
    if from_none:
        found = index.docs.select("doc_id").join(found, "doc_id", "left").na.fill(False, list(flags.values()))
    return found.where(condition).select("doc_id")


def search(index: Index, query: str, dialect: str = "symbol", k: int | None = TOP) -> DataFrame:
    """doc_id, title, path of the first k matches by doc_id; all for k = None."""
    found = matches(index, query, dialect)
    if k is not None:
        found = F.broadcast(found.orderBy("doc_id").limit(k))
    return index.docs.select("doc_id", "title", "path").join(found, "doc_id")


def page_number(page) -> int:
    try:
        return max(1, int(page))
    except (TypeError, ValueError):
        return 1


def search_page(index: Index, query: str, page=1, per_page: int = PAGE, dialect: str = "symbol") -> tuple[DataFrame, int, bool]:
    """(rows of the page, number of matches, whether another page follows)."""
    found = matches(index, query, dialect)
    total, first = found.count(), per_page * (page_number(page) - 1)
    rows = found.orderBy("doc_id").offset(first).limit(per_page)
    return index.docs.select("doc_id", "title", "path").join(F.broadcast(rows), "doc_id"), total, first + per_page < total
