"""Text functions that Spark lacks: full case folding, Unicode digits, mentions in wikitext, CSV values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_TAGS = "b|i|u|s|small|big|sub|sup|span|div|center|em|strong"
_COMMENT, _URL, _TAG = re.compile(r"<!--.*?-->", re.S), re.compile(r"https?://\S+"), re.compile(rf"</?(?:{_TAGS})\b[^>]*>", re.I)
_PAIRS = {"{{": "}}", "[[": "]]", "{|": "|}"}


@pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s.casefold())


@pandas_udf(T.LongType())
def decimal_number(text: pd.Series) -> pd.Series:
    """Digits of any script as a number, null otherwise."""

    def one(s):
        if not s or not all(unicodedata.category(c) == "Nd" for c in s):
            return None
        return int("".join(str(unicodedata.decimal(c)) for c in s))

    return text.map(one).astype("Int64")


def plain_text(wikitext: str) -> str:
    """Without comments, addresses, simple tags, and whatever stands in templates, links and tables, nested or never closed."""
    text = _TAG.sub(" ", _URL.sub(" ", _COMMENT.sub(" ", wikitext)))
    out, ends, at = [], [], 0
    while at < len(text):
        two = text[at : at + 2]
        if ends and two == ends[-1]:
            ends.pop()
            at += 2
        elif two in _PAIRS:
            ends.append(_PAIRS[two])
            at += 2
        elif not ends and text[at] == "[" and (close := text.find("]", at)) > 0:
            at = close + 1
        else:
            if not ends:
                out.append(text[at])
            at += 1
    return "".join(out).lower()


def mentions(wikitext: str, title: str) -> bool:
    """Whether the title stands in the plain text between characters that are no letters or digits."""
    return bool(title) and re.search(rf"(?<![^\W_]){re.escape(title.lower())}(?![^\W_])", plain_text(wikitext)) is not None


@pandas_udf(T.BooleanType())
def mentioned(wikitext: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([None if w is None or t is None else mentions(w, t) for w, t in zip(wikitext, title, strict=True)])


def csv_value(v) -> str:
    """null as nothing, booleans and lists as Python writes them."""
    if v is None:
        return ""
    text = repr(list(v)) if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, float) else str(v)
    return '"' + text.replace('"', '""') + '"' if re.search(r'[,"\r\n]', text) else text


def csv_row(values) -> str:
    return ",".join(map(csv_value, values)) + "\r\n"
