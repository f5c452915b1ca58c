"""Cleaning, tokenizing and naming of documents, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four separators U+001C to U+001F.
BLANK = r"(?U)[\s\x1c-\x1f]+"

#: A token: ASCII letters and digits, joined by one hyphen or apostrophe, or by one point between digits. Possessive
#: throughout: a token of any length is matched without recursion and without going back.
TOKEN = r"[A-Za-z0-9]++(?:(?:[-']|(?<=[0-9])\.(?=[0-9]))[A-Za-z0-9]++)*+"

#: The same tokens for an engine without look-around (RE2), as a SQL string literal's content.
TOKEN_RE2 = r"(?:[A-Za-z]+|[0-9]+(?:\.[0-9]+)*)(?:[-'']?(?:[A-Za-z]+|[0-9]+(?:\.[0-9]+)*))*"

TITLE = r"Title:[ \t\n\x0B\f\r]*([^\n]*)"


#: The same with letters and digits of all scripts, for text in other languages; index terms are ASCII.
UNICODE_TOKEN = r"[\p{L}\p{N}]++(?:(?:[-']|(?<=\p{Nd})\.(?=\p{Nd}))[\p{L}\p{N}]++)*+"


def clean_text(c: Column) -> Column:
    """Null is empty, and so is NaN of a number (not the text NaN); runs of white space become one space; none at the ends."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    text = F.when(F.typeof(c).isin("double", "float") & (text == "NaN"), "").otherwise(text)
    return F.trim(F.regexp_replace(text, BLANK, " "))


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned text."""
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " "))).cast("long")


def tokenize(c: Column, unicode: bool = False) -> Column:
    """Lower-case tokens in order, of ASCII or of all scripts. Each token is lowered by itself: lowering a whole text first turns some non-ASCII
    letters into ASCII ones."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(UNICODE_TOKEN if unicode else TOKEN), F.lit(0)), F.lower)


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")


def may_stem(term: Column) -> Column:
    return term.rlike("^[a-z]{3,}$")


def extract_title(c: Column) -> Column:
    """What follows the first `Title:`, blanks and line ends skipped, up to the line's end; empty without one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), TITLE, 1)


def document_text(title: Column, abstract: Column, full_text: Column) -> Column:
    """The three labelled sections of a corpus document."""
    return F.concat(F.lit("Title: "), title, F.lit("\n\nAbstract: "), abstract, F.lit("\n\nFull text:\n"), full_text, F.lit("\n"))


def file_name(doc_id: Column) -> Column:
    return F.format_string("doc_%06d.txt", doc_id)


def preview(c: Column, n: int = 300) -> Column:
    """The first n characters (code points; a cut never falls inside one)."""
    return F.substring(c, 1, n)


def escape_html(c: Column) -> Column:
    """Text as it goes into a page or an attribute."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c
