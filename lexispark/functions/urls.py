"""URLs, links and headers, as Column expressions and one Arrow UDF."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.session import ready

MOST_BYTES = 180
# What makes a page not worth a visit, by path.
USELESS_PREFIXES = ("join", "login", "logout", "signup", "settings", "notifications", "tasks", "spaces", "models", "docs", "api")
USELESS_PARTS = ("/discussions/", "/blob/", "/tree/", "/resolve/", "/commits/", "/oauth")

_ENDS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
_URL = r"(?is)^(https?)://([^/]*)(.*)$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def host(url: Column) -> Column:
    """Between :// and the next slash, lowered, with its port; empty for other schemes."""
    return F.lower(F.regexp_extract(url, r"(?is)^(https?)://([^/]*)", 2))


def path(url: Column) -> Column:
    """What follows the host, query and all; / if nothing does."""
    rest = F.regexp_extract(url, _URL, 3)
    return F.when(rest == "", "/").otherwise(rest)


def normalize_url(url: Column) -> Column:
    """Fragment and query cut, scheme and host lowered, an empty path made /, one slash at the end of a longer path
    dropped; empty if it isn't http(s) with a host."""
    bare = F.regexp_replace(trimmed(F.coalesce(url, F.lit(""))), r"(?s)[#?].*$", "")
    scheme, at, rest = (F.regexp_extract(bare, _URL, i) for i in (1, 2, 3))
    tail = F.when(rest == "", "/").otherwise(F.regexp_replace(rest, r"(?s)(?<=.)/$", ""))
    return F.when(at == "", "").otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(at), tail))


def is_allowed_domain(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one."""
    h = host(url)
    found = F.lit(False)
    for d in domains:
        found = found | (h == d.lower()) | h.endswith("." + d.lower())
    return (h != "") & found


def is_useful_url(url: Column) -> Column:
    """Not too long, not a PDF, and no path that leads to accounts, code or interfaces."""
    p = F.lower(path(url))
    bad = p.endswith(".pdf") | p.rlike("^/(" + "|".join(USELESS_PREFIXES) + ")")
    for part in USELESS_PARTS:
        bad = bad | p.contains(part)
    return (url != "") & (F.octet_length(url) <= MOST_BYTES) & ~bad


def header(block: Column, name: str) -> Column:
    """A header's value out of raw header lines, by its name in any case, trimmed; the last line of that name counts."""
    lines = F.split(block, r"\r?\n")
    of_name = F.filter(lines, lambda x: F.lower(x).startswith(name.lower() + ":"))
    last = F.get(of_name, F.size(of_name) - 1)
    return F.coalesce(trimmed(F.substring(last, F.lit(len(name) + 2), F.length(last))), F.lit(""))


def content_hash(html: Column) -> Column:
    """Only ever compared for equality."""
    return F.md5(html)


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v][:1]


def hrefs(base: str, html: str) -> list[str]:
    """The page's links, resolved against its address."""
    parser = _Anchors()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):  # the tolerant parser's own limits
        pass
    out = []
    for href in parser.found:
        try:
            out.append(urljoin(base, href.strip()))
        except ValueError:
            continue
    return out


def join_url(spark, base: Column, href: Column) -> Column:
    """RFC 3986 resolution, then normalize_url; empty if there is no href."""
    ready(spark)

    @F.pandas_udf("string")
    def joined(bases: pd.Series, found: pd.Series) -> pd.Series:
        def one(b: str, h: str) -> str:
            try:
                return urljoin(b, h.strip()) if h else ""
            except ValueError:
                return ""

        return pd.Series([one(b or "", h or "") for b, h in zip(bases, found)])

    return normalize_url(joined(base, href))


def extract_links(spark, base: Column, html: Column, domains: Sequence[str]) -> Column:
    """Sorted distinct normalized links of a page that are allowed and useful. Parsing is the only part in Python."""
    ready(spark)

    @F.pandas_udf("array<string>")
    def parsed(bases: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([hrefs(b or "", h or "") for b, h in zip(bases, pages)])

    urls = F.transform(parsed(base, html), normalize_url)
    return F.array_sort(F.array_distinct(F.filter(urls, lambda u: is_allowed_domain(u, domains) & is_useful_url(u))))
