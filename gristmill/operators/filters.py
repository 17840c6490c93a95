"""Search filters: conjunctions of alternatives as one Column, for Catalyst to push down.

A clause names an attribute and is a Column that is never null.  Absent, null,
empty and present attributes are told apart where the frame can: arrays are
absent when null and empty when of size 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word that stands for "no value" in a facet's values.
NONE = "none"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equals(attribute: str, value, array: bool = False) -> Column:
    return _sure(F.array_contains(attribute, value) if array else F.col(attribute) == F.lit(value))


def excludes(attribute: str, value, array: bool = False) -> Column:
    """Rows without the attribute pass."""
    return ~equals(attribute, value, array)


def at_least(attribute: str, bound, array: bool = False) -> Column:
    return _sure(F.exists(attribute, lambda x: x >= bound) if array else F.col(attribute) >= bound)


def at_most(attribute: str, bound, array: bool = False) -> Column:
    return _sure(F.exists(attribute, lambda x: x <= bound) if array else F.col(attribute) <= bound)


def exists(attribute: str) -> Column:
    return F.col(attribute).isNotNull()


def is_empty(attribute: str) -> Column:
    return _sure(F.size(attribute) == 0)


def any_of(clauses: list[Column]) -> Column | None:
    return reduce(or_, clauses) if clauses else None


def all_of(groups: list[list[Column]]) -> Column | None:
    """AND of ORs; empty groups are dropped; None when nothing is left."""
    made = [g for g in map(any_of, groups) if g is not None]
    return reduce(and_, made) if made else None


def ids_in(attribute: str, ids: list) -> list[Column]:
    """An empty list is no filter at all."""
    return [_sure(F.col(attribute).isin(*ids))] if ids else []


def ids_not_in(attribute: str, ids: list) -> list[Column]:
    return [~_sure(F.col(attribute).isin(*ids))] if ids else []


def facet_group(attribute: str, values: list[str], array: bool = False, empty_word: bool = False) -> list[Column]:
    """Alternatives of one facet; with empty_word, "none" means the empty value."""
    return [is_empty(attribute) if empty_word and v == NONE else equals(attribute, v, array) for v in values]


def facet_exclusions(attribute: str, values: list[str], array: bool = False, empty_word: bool = False) -> list[list[Column]]:
    return [[~is_empty(attribute)] if empty_word and v == NONE else [excludes(attribute, v, array)] for v in values]


def bounded(attribute: str, text: str | None, upper: bool = True, include_unspecified: bool = False, unless: str | None = None) -> list[Column]:
    """Alternatives of a numeric bound given as text.

    A negative or non-integer bound gives none, 0 is valid.  include_unspecified
    lets rows without the attribute pass; unless names an attribute whose
    presence lifts the bound.
    """
    if text is None or not re.fullmatch(r"\d+", text.strip()):
        return []
    n = int(text)
    out = [at_most(attribute, n) if upper else at_least(attribute, n)]
    if include_unspecified:
        out.append(F.col(attribute).isNull())
    if unless:
        out.append(exists(unless))
    return out


def open_only(groups: list[list[Column]], closed: str = "is_closed", duplicate: str = "is_duplicate") -> list[list[Column]]:
    """The groups and the guard for open documents; documents without the markers pass."""
    return [*groups, [~_sure(F.col(closed))], [~_sure(F.col(duplicate))]]


def family(source: Column, families: tuple[str, ...]) -> Column:
    """A source folded to its family: name-xx counts as name, whatever its case and outer spaces."""
    plain = F.lower(F.trim(source))
    for f in families:
        plain = F.when((plain == f) | plain.startswith(f"{f}-"), F.lit(f)).otherwise(plain)
    return plain


def domain_matches(host: Column, domain: Column) -> Column:
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def suffixes(host: str) -> Column:
    """All dotted suffixes of a host: turns a suffix join into an equi-join."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


@dataclass
class Alternative:
    text: str
    fields: tuple[str, ...] = ()


def parse_query(query: str, limit: int = 5) -> list[Alternative]:
    """OR outside quotes splits a query into at most `limit` alternatives; a leading title: narrows one to the title."""
    parts, depth, at, start = [], False, 0, 0
    while at < len(query):
        if query[at] == '"':
            depth = not depth
        if not depth and query[at : at + 4] == " OR ":
            parts.append(query[start:at])
            start = at + 4
            at += 3
        at += 1
    parts.append(query[start:])
    if len(parts) == 1 and not query.lower().startswith("title:"):
        return [Alternative(query)]
    out = []
    for p in (x.strip() for x in parts):
        title = p.lower().startswith("title:")
        text = p[6:].strip() if title else p
        if text:
            out.append(Alternative(text, ("title",) if title else ()))
    return out[:limit] if out else [Alternative(query)]


_BOX = re.compile(r'(\w+):(?:"([^"]*)"|(\S+))')


def parse_box(query: str, keys: tuple[str, ...] = ("company", "source", "title")) -> tuple[dict[str, list[str]], str]:
    """Box operators key:value or key:"a value"; unknown keys stay text."""
    facets: dict[str, list[str]] = {}

    def take(m: re.Match) -> str:
        key = m[1].lower()
        if key not in keys:
            return m[0]
        facets.setdefault(key, []).append(m[2] if m[2] is not None else m[3])
        return ""

    return facets, " ".join(_BOX.sub(take, query).split())


def text_matches(alternatives: list[Alternative], columns: dict[str, Column]) -> Column:
    """Rows that hold all words of one alternative, in its fields or any field."""
    made = []
    for a in alternatives:
        where = [columns[f] for f in a.fields] or list(columns.values())
        words = [w.lower() for w in re.findall(r'"([^"]*)"|(\S+)', a.text) for w in w if w]
        made.append(reduce(and_, [reduce(or_, [_sure(F.lower(c).contains(w)) for c in where]) for w in words]) if words else F.lit(True))
    return reduce(or_, made)


def canonical_query(params: dict[str, list[str]]) -> dict[str, list[str]]:
    """Comma-joined and repeated values alike, sorted and distinct; sort order is not part of a saved query."""
    out = {}
    for key, values in params.items():
        flat = sorted({v.strip() for x in values for v in x.split(",") if v.strip()})
        if flat and key != "sort":
            out[key] = flat
    return out


@dataclass
class SearchSpec:
    """A whole search: facet -> wanted values, facet -> unwanted values, alternatives of text, extra groups."""

    include: dict[str, list] = field(default_factory=dict)
    exclude: dict[str, list] = field(default_factory=dict)
    arrays: frozenset[str] = frozenset()
    groups: list[list[Column]] = field(default_factory=list)

    def clause(self, facet: str) -> Column | None:
        """Everything that the spec says about one facet."""
        a = facet in self.arrays
        return all_of([facet_group(facet, self.include.get(facet, []), a), *facet_exclusions(facet, self.exclude.get(facet, []), a)])

    def column(self) -> Column:
        facets = dict.fromkeys([*self.include, *self.exclude])
        made = [c for c in (self.clause(f) for f in facets) if c is not None]
        rest = all_of(self.groups)
        return reduce(and_, [*made, *([rest] if rest is not None else [])], F.lit(True))


def search(df: DataFrame, spec: SearchSpec) -> DataFrame:
    return df.where(spec.column())


def ignored_params(params: dict[str, list[str]], known: dict[str, set[str] | None]) -> list[str]:
    """Unknown parameters, and unknown values of parameters with a closed vocabulary, as name or name=value."""
    out = []
    for key, values in params.items():
        if key not in known:
            out.append(key)
        elif known[key] is not None:
            out += [f"{key}={v}" for v in values if v not in known[key]]
    return out


def bounded_int(text: str | None, low: int, high: int, default: int) -> tuple[int, bool]:
    """A parameter as an integer within bounds, or the default; and whether it had to be replaced."""
    try:
        n = int(text) if text is not None else default
    except ValueError:
        return default, True
    return (n, False) if low <= n <= high else (default, True)


def comma_terms(text: str | None, cap: int) -> list[str]:
    return [t for t in (x.strip() for x in (text or "").split(",")) if t][:cap]
