"""Functions that built-in expressions can't give: Arrow-batched, never row by row.

Numeric character references, transliteration, chunking by paragraphs and words,
language guesses and masking of optional sections.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent short words by language.
STOP = {
    "en": "the of and to in is for with that on are this as by from or an be",
    "de": "der die das und ist mit für von zu den nicht ein eine auf im sich des",
    "fr": "le la les et des de du un une est pour dans que qui avec sur pas",
    "es": "el la los las de y que en un una para con por es se del al",
}
_STOP = {k: frozenset(v.split()) for k, v in STOP.items()}


@F.pandas_udf(T.StringType())
def entities(s: pd.Series) -> pd.Series:
    """All character references decoded, numeric ones too."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


@F.pandas_udf(T.StringType())
def transliterated(s: pd.Series) -> pd.Series:
    """ASCII letters for accented Latin ones; what has no ASCII form goes."""

    def one(x):
        if not isinstance(x, str) or x.isascii():
            return x
        return unicodedata.normalize("NFKD", x.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae")).encode("ascii", "ignore").decode()

    return s.map(one)


def _chunks(text: str, size: int) -> list[str]:
    out, now = [], ""
    for part in re.split(r"(?<=\n)\n+|(?<=\n)", text):
        while len(part) > size:
            if now:
                out.append(now)
                now = ""
            cut = part.rfind(" ", 1, size + 1)
            cut = cut if cut > 0 else size
            out.append(part[:cut])
            part = part[cut:].lstrip(" ")
        if len(now) + len(part) > size:
            out.append(now)
            now = ""
        now += part
    if now:
        out.append(now)
    return [c.strip() for c in out if c.strip()]


def chunks(text: Column, size: int = 2000) -> Column:
    """Pieces of at most size characters, cut at paragraph ends, else at spaces, else anywhere."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _chunks(x, size) if isinstance(x, str) else [])

    return cut(text)


@F.pandas_udf(T.StringType())
def language(s: pd.Series) -> pd.Series:
    """The language whose frequent words a text has most of; "" for fewer than 40 characters or no such word; ASCII texts without one are English."""

    def one(x):
        if not isinstance(x, str):
            return ""
        x = re.sub(r"<[^>]*>", " ", x)
        if len(x.strip()) < 40:
            return ""
        found = re.findall(r"[^\W\d_]+", x.lower())
        score = {k: sum(w in v for w in found) for k, v in _STOP.items()}
        best = max(score, key=lambda k: (score[k], k))
        if score[best]:
            return best
        letters = [c for c in x if c.isalpha()]
        return "en" if letters and sum(c.isascii() for c in letters) >= 0.9 * len(letters) else ""

    return s.map(one)


#: Headings of sections that name wishes, not needs; a section ends at the next heading.
OPTIONAL = re.compile(r"(?im)^\s*(?:nice to have|preferred(?: qualifications)?|bonus(?: points)?|optional|would be a plus)\s*:?\s*$")
HEADING = re.compile(r"(?m)^\s*[A-Z][^\n.]{2,40}:\s*$")


@F.pandas_udf(T.StringType())
def without_optional(s: pd.Series) -> pd.Series:
    """The text with optional sections blanked by spaces: places stay."""

    def one(x):
        if not isinstance(x, str):
            return x
        out, at = [], 0
        for m in OPTIONAL.finditer(x):
            if m.start() < at:
                continue
            nxt = HEADING.search(x, m.end())
            end = nxt.start() if nxt else len(x)
            out += [x[at : m.start()], re.sub(r"[^\n]", " ", x[m.start() : end])]
            at = end
        return "".join(out) + x[at:]

    return s.map(one)


def json_ld(df: DataFrame, html_column: str = "html") -> DataFrame:
    """df with column postings: the JobPosting objects (as JSON text) of the page's JSON-LD blocks."""
    blocks = F.regexp_extract_all(html_column, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return df.withColumn("postings", F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "JobPosting"))
