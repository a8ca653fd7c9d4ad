"""Text and URL functions over Columns."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the rules mean it: Unicode white space and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Characters of markup that a description is made from, and its length.
MARKUP_CHARS, DESCRIPTION_CHARS = 2048, 512
_ENDED = re.compile(r"&#?\w+;", re.ASCII)


def let(value: Column, body) -> Column:
    """body of value, where value is computed once however often body uses it (SQL expressions have no names of their own)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ustrip(c: Column) -> Column:
    """c without white space at both ends (Unicode, not spaces alone)."""
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    return let(c, lambda t: F.when(ends(t).rlike(SPACE), F.regexp_replace(t, rf"^{SPACE}++|{SPACE}++$", "")).otherwise(t))


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def nonempty(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*map(nonempty, columns))


def is_http_url(c: Column) -> Column:
    """Whether c starts with http:// or https:// (as written; false for null)."""
    return F.coalesce(c.startswith("http://") | c.startswith("https://"), F.lit(False))


def lenient_int(c: Column) -> Column:
    """An integer, or null for anything else."""
    return ustrip(c).try_cast("bigint")


def local_name(tag: Column) -> Column:
    """The lower-cased name after a namespace in braces or the first colon."""
    return F.lower(F.regexp_replace(tag, r"^(?:.*\}|[^:{}]*:)", ""))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Character references resolved. Only strings that hold an ampersand go to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


@F.pandas_udf(StringType())
def _unescape_ended(values: pd.Series) -> pd.Series:
    return values.map(lambda t: _ENDED.sub(lambda m: html.unescape(m[0]), t), na_action="ignore")


def html_to_text(c: Column, ended: bool = False) -> Column:
    """A short description from markup or text.

    With both angle brackets: of the first characters, tags become spaces and references are resolved. White space is
    collapsed and cut off at the ends; the result is cut to its length. Text without tags is not unescaped.

    ended: references without their semicolon, as the cut to the first characters leaves some, stay as they stand. Else they
    are resolved, too, where their names allow it (HTML's own rule).
    """
    unescape = _unescape_ended if ended else _unescape
    tagged = lambda t: t.contains("<") & t.contains(">")
    # references stand only where tags stood: what goes to Python is null for all other strings
    bare = let(c, lambda t: F.when(tagged(t), F.regexp_replace(F.left(t, F.lit(MARKUP_CHARS)), "<[^>]+>", " ")))
    text = F.coalesce(unescape(let(bare, lambda t: F.when(t.contains("&"), t))), bare, c)
    # single spaces are their own collapse
    return let(text, lambda t: F.left(ustrip(collapse(t)), F.lit(DESCRIPTION_CHARS)))


@F.pandas_udf(StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    """link seen from base."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)], dtype=object)


def url_key(url: Column) -> Column:
    """The name under which a URL's document is kept: 16 hexadecimal digits of its hash."""
    return F.substring(F.sha2(url, 256), 1, 16)
