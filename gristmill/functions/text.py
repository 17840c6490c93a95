"""Scalar text functions as Column expressions.

Regular expressions are Java's; letters and digits are Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Record and unit separators of hashed fields.
RS, US = "\u001e", "\u001f"
#: The named character references that postings use; numeric ones are decoded by entities() in arrow.py.
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&middot;": "·", "&copy;": "©", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}
SPACE = r"[\s   -     　]+"


def chain(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def named_entities(c: Column) -> Column:
    """The named references decoded, the ampersand last."""
    for name, char in NAMED.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def role_text(c: Column) -> Column:
    """Tags to spaces, then references decoded, lower case, white space collapsed."""
    return collapse(F.lower(named_entities(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "))))


def strip_clause(c: Column) -> Column:
    """One trailing clause after ",", " - ", " | " or " @ " goes, unless fewer than two words would stay."""
    cut = F.regexp_replace(c, r"(?s)^(.*)(?:, | - | \| | @ ).*$", "$1")
    return F.when(F.size(F.split(F.trim(cut), r"\s+")) >= 2, F.trim(cut)).otherwise(c)


def fingerprint(*fields: Column) -> Column:
    """sha256 of the fields joined by the record separator; null counts as empty."""
    return F.sha2(F.concat_ws(RS, *(F.coalesce(f, F.lit("")) for f in fields)).cast("binary"), 256)


def content_hash(*fields: Column) -> Column:
    """sha256 over all fields, each followed by the record separator; arrays are joined by the unit separator."""
    return F.sha2(F.concat(*(F.concat(F.coalesce(f, F.lit("")), F.lit(RS)) for f in fields)).cast("binary"), 256)


def joined(array: Column) -> Column:
    return F.array_join(array, US)


def role_key(company: Column, title: Column) -> Column:
    """Folded company and title: parentheses unwrapped, everything but letters, digits and marks to one space."""
    fold = lambda c: F.trim(chain(F.lower(F.coalesce(c, F.lit(""))), (r"[()\[\]]", " "), (r"[^\p{L}\p{Nd}\p{M}]+", " ")))
    return F.concat_ws("|", fold(company), fold(title))


def title_keys(title: Column) -> Column:
    """Keys of a title: the whole and without its parentheses."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}\p{M}]+", " "))
    return F.array_sort(F.array_distinct(F.filter(F.array(fold(title), fold(F.regexp_replace(title, r"\([^)]*\)", " "))), lambda k: k != "")))


def signature(c: Column) -> Column:
    """The set of ASCII words of four letters or digits at least."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 3))


def jaccard(a: Column, b: Column) -> Column:
    """0 when either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def suggestion_title(c: Column) -> Column:
    """A title as offered to searchers: lower case, cut at the first separator, dashes in front trimmed, spaces collapsed."""
    cut = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?s)( - | – | — |, | at | @ |[|(),\[\]/]).*$", "")
    return collapse(F.regexp_replace(cut, r"^[\s\-–—]+", ""))


def recordable(c: Column, chars: int = 60, words: int = 8) -> Column:
    return (F.length(c) > 0) & (F.length(c) <= chars) & (F.size(F.split(c, " ")) <= words) & ~c.contains("@")


def offerable(c: Column, generic: list[str]) -> Column:
    """Not made of grade and generic words alone."""
    return ~F.forall(F.split(c, " "), lambda w: w.isin(*generic))


def document_id(kind: str, c: Column) -> Column:
    return F.concat(F.lit(kind + "_"), F.sha2(c.cast("binary"), 256))


def capitalise(c: Column) -> Column:
    """Upper case for each word's first letter; the rest stays as it is."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2_000_000_000))), " ")


def slug(c: Column) -> Column:
    """ASCII letters and digits of the lower-cased text, other runs one hyphen; accented Latin letters lose their marks."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), accents, plain)
    return F.regexp_replace(F.regexp_replace(F.replace(low, F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", "-"), "^-|-$", "")


def fold_term(c: Column, most: int = 80) -> Column:
    """Dictionary term: lower case, ё as е, & as and, hyphen and space runs one space; null beyond most characters."""
    t = collapse(chain(F.lower(c), ("ё", "е"), ("&", " and "), ("[-‐‑–—_]+", " ")))
    return F.when(F.length(t).between(1, most), t)


def skill_phrase(c: Column) -> Column:
    """Lower case; trailing punctuation but + and # trimmed; hyphens and underscores to spaces."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}+#]+$", ""), "[-_ ]+", " "))


def has_word(c: Column, term: str, tech: bool = False) -> Column:
    """Whole-word match by Unicode boundaries; a technical term also refuses "." and "-" in front."""
    import re

    before = r"(?<![\p{L}\p{N}.\-])" if tech else r"(?<![\p{L}\p{N}])"
    return F.coalesce(F.lower(c).rlike(before + re.escape(term.lower()) + r"(?![\p{L}\p{N}])"), F.lit(False))


def plain_text(c: Column) -> Column:
    """Markup to text: scripts and styles out, tags to spaces, named references decoded, spaces collapsed."""
    return collapse(named_entities(chain(F.coalesce(c, F.lit("")), (r"(?is)<(script|style)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), ("<[^>]*>", " "))))


#: Sections of wishes, from their heading to the next heading or the end.
WISHES = r"(?ms)^\s*(?i:nice to have|preferred(?: qualifications)?|bonus(?: points)?|optional|would be a plus)\s*:?\s*$.*?(?=^\s*[A-Z][^\n.]{2,40}:\s*$|\z)"


def required_text(c: Column) -> Column:
    """The text without its sections of wishes."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), WISHES, " ")


def experience_years(c: Column, cap: int = 50) -> Column:
    """Least number of years that the required text asks for, up to cap; 0 if it says that none is needed; null if unsaid.

    "3-5 years", "3 to 5 yrs" and "3+ years" ask for 3; an age ("25 years old") is
    no experience.  "No experience needed" is about the work only if no tool
    follows it by with, in or using.
    """
    text = F.regexp_replace(F.lower(required_text(c)), r"\d{1,2}\s*years?\s*(?:old|of age)", " ")
    years = r"\b(\d{1,2})(?:\s*(?:-|–|to)\s*(\d{1,2}))?\s*\+?\s*(?:years?|yrs?)"
    stated = F.concat(*(F.regexp_extract_all(text, F.lit(years), F.lit(i)) for i in (1, 2)))
    least = F.array_min(F.filter(F.transform(stated, lambda x: x.try_cast("int")), lambda n: n <= cap))
    waived = r"\bno (?:prior |previous )?experience (?:is )?(?:needed|required|necessary)\b(?!\s*(?:with|in|using)\b)"
    return F.when(F.regexp_replace(text, r"\s+", " ").rlike(waived), F.lit(0)).otherwise(least)


#: What an intermediary's posting says, in lower case, one space between words; "our client" alone is no sign.
INTERMEDIARY = (
    r"\bon behalf of (?:our|a|one of our) (?:valued |esteemed |reputed )?client\b",
    r"\bour (?:valued |esteemed |reputed )?client is (?:a|an|looking|seeking|hiring|currently|expanding|interested|recruiting)\b",
    r"\bour (?:valued |esteemed |reputed )?client, (?:a|an|one)\b",
    r"\babout our client\b",
    r"\brecruiting (?:\w+ ){0,3}on behalf of\b",
    r"\b(?:a|one) (?:[\w-]+ ){0,4}client of ours\b",
    r"\bjoin our client['’]s team\b",
    r"\bour customer is hiring for\b",
)


def via_recruiter(c: Column) -> Column:
    """True if a posting's text, markup aside, says that an intermediary wrote it, else null."""
    plain = F.lower(collapse(F.replace(plain_text(c), F.lit("*"), F.lit(""))))
    return F.when(plain.rlike("|".join(INTERMEDIARY)), F.lit(True))


def has_any(c: Column, phrases: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


#: Degrees by precedence as a posting's requirements name them, and as a candidate's own field does.
REQUIRED_LEVELS = (
    ("phd", r"\b(?:ph\.?\s?d|phd|doctorate|doctoral)\b"),
    ("master", r"\b(?:master['’]?s|master degree|m\.?sc|mba|graduate degree)\b"),
    ("bachelor", r"\b(?:bachelor['’]?s|bachelor degree|b\.?sc|undergraduate degree)\b"),
    ("none", r"\b(?:no (?:degree|diploma)|degree not required|without a degree|no degree required)\b"),
)
OWN_LEVELS = (
    ("phd", r"\b(?:ph\.?\s?d\.?|phd|doctorate|doctoral)\b"),
    ("master", r"\b(?:m\.?sc\.?|m\.?s\.?|mba|master(?:['’]s)?)\b"),
    ("bachelor", r"\b(?:b\.?sc\.?|b\.?s\.?|bachelor(?:['’]s)?)\b"),
)


def education_level(c: Column, own: bool = False) -> Column:
    """phd, master, bachelor or none that the required text names (own: a candidate's degree field, never none); null if it names no degree."""
    low, out = F.lower(F.coalesce(c, F.lit("")) if own else required_text(c)), None
    for level, pattern in OWN_LEVELS if own else REQUIRED_LEVELS:
        out = F.when(low.rlike(pattern), level) if out is None else out.when(low.rlike(pattern), level)
    return out


def canonicalised(values: Column, aliases: dict[str, str]) -> Column:
    """Sorted distinct canonical names of the values that the alias table knows."""
    known = F.create_map(*(F.lit(x) for kv in sorted(aliases.items()) for x in kv))
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.try_element_at(known, F.lower(F.trim(v)))), lambda v: v.isNotNull())))


def unshadowed(regions: Column, line: Column) -> Column:
    """Without "global" beside a place, unless the line offers a choice."""
    return F.when((F.size(regions) > 1) & ~F.lower(line).contains(" or "), F.array_remove(regions, "global")).otherwise(regions)


def domain(url: Column) -> Column:
    """Host without www., port and root dot; null without a dot."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = chain(host, (r"\.$", ""), (r"^www\.", ""))
    return F.when(host.contains("."), host)


def tagged_url(url: Column, source: str) -> Column:
    """The URL with utm_source, before a fragment."""
    base, fragment = F.regexp_extract(url, "^([^#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(f"utm_source={source}"), fragment)


def untagged_url(url: Column) -> Column:
    """The URL without its utm parameters."""
    return chain(url, (r"([?&])utm_[a-z]+=[^&#]*(&(?=[^#]))?", "$1"), (r"[?&](?=#|$)", ""))


def normalised_job_url(url: Column) -> Column:
    """Lower case, without scheme, www., query, fragment and trailing slashes."""
    return chain(F.lower(F.trim(url)), (r"^[a-z]+://", ""), (r"^www\.", ""), (r"[?#].*$", ""), (r"/+$", ""))


#: Tracking parameters.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "src")


def normalised_application_url(url: Column) -> Column:
    """Host in lower case, path as it is, tracking parameters out, the others by key and then position."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    raw = F.regexp_extract(url, r"\?([^#]*)", 1)
    params = F.transform(F.split(raw, "&"), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    kept = F.array_sort(F.filter(params, lambda p: (p["p"] != "") & ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: p["p"]), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def clean_title(c: Column) -> Column:
    """Zero-width spaces to spaces, other format characters out, spaces collapsed."""
    return collapse(chain(c, ("​", " "), (r"\p{Cf}", "")))


def clean_location(c: Column) -> Column:
    """Without a label in front and coordinates behind."""
    return collapse(chain(c, (r"(?i)^\s*locations?\s*:\s*", ""), (r"[\s,(]*-?\d{1,3}\.\d+\s*,\s*-?\d{1,3}\.\d+\)?\s*$", "")))


def job_code(source: Column, external: Column) -> Column:
    """Short stable code of a posting: 13 hex digits of sha256 over source, NUL and id."""
    return F.substring(F.sha2(F.concat(source, F.lit("\u0000"), external).cast("binary"), 256), 1, 13)


def job_slug(title: Column, company: Column, source: Column, external: Column) -> Column:
    return F.concat_ws("-", F.nullif(slug(title), F.lit("")), F.nullif(slug(company), F.lit("")), job_code(source, external))


def code_of_slug(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?:^|-)([0-9a-f]{13})$", 1), F.lit(""))


def namespaced(board: Column, external: Column) -> Column:
    return F.concat(board, F.lit(":"), external)


def like_prefix(c: Column) -> Column:
    """A literal prefix escaped for LIKE: backslash, percent, underscore in that order."""
    return F.concat(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")), F.lit("%"))


def repaired_json(c: Column) -> Column:
    """Raw control characters to spaces, so that strict decoders read it."""
    return F.regexp_replace(c, r"[\u0000-\u001f]", " ")


def listing_fingerprint(ids: Column) -> Column:
    """sha256 of the sorted distinct ids, each ended by NUL."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.concat(i, F.lit("\u0000"))), "").cast("binary"), 256)


def literal_query(c: Column) -> Column:
    """Search text without operators: quotes out, leading minus signs out, spaces collapsed."""
    return collapse(F.regexp_replace(F.replace(c, F.lit('"'), F.lit(" ")), r"(?<!\S)-+", ""))


def bound(c: Column) -> Column:
    """A salary bound: rounded; null unless positive."""
    n = F.round(c.try_cast("double")).cast("long")
    return F.when(n > 0, n)


def lakh(label: Column) -> Column:
    """"12 lakh" or "1.5 crore" as a number."""
    n = F.regexp_extract(F.lower(label), r"([\d.]+)\s*(?:lakhs?|lacs?|l\b|crores?|cr\b)", 1).try_cast("double")
    return F.round(F.when(F.lower(label).rlike(r"[\d.]\s*(?:crores?|cr\b)"), n * 10_000_000).otherwise(n * 100_000)).cast("long")


def strings(c: Column) -> Column:
    """A JSON string or array of strings as an array."""
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).when(F.ltrim(c).startswith('"'), F.array(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"))).otherwise(F.array(c))


def number(c: Column) -> Column:
    """A JSON number or a string that holds one."""
    return F.regexp_replace(c, '"', "").try_cast("double")


def truthy(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), '"', "")).isin("true", "1", "yes", "y")


#: Hosts of posting systems, and where a URL names the board: in the path or as the first host label.
PROVIDERS = (("greenhouse", "boards.greenhouse.io", "path"), ("lever", "jobs.lever.co", "path"), ("ashby", "jobs.ashbyhq.com", "path"), ("workable", "apply.workable.com", "path"), ("recruitee", ".recruitee.com", "host"), ("personio", ".jobs.personio.de", "host"))


def provider(url: Column, rules: tuple[tuple[str, str, str], ...] = PROVIDERS) -> Column:
    """Struct (provider, board) by host and path; null for other hosts and for URLs that name no board."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    first = F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([^/?#]+)", 1), F.lit(""))
    out = F.lit(None).cast("struct<provider:string,board:string>")
    for name, suffix, where in reversed(rules):
        board = F.lower(first) if where == "path" else F.nullif(F.substring_index(host, ".", 1), F.lit(""))
        hit = (host == suffix) if where == "path" else host.endswith(suffix)
        out = F.when(hit & board.isNotNull(), F.struct(F.lit(name).alias("provider"), board.alias("board"))).otherwise(out)
    return out


def site_host(info: Column) -> Column:
    """Host of the website in a JSON object, white space trimmed; null without one."""
    return domain(F.trim(F.get_json_object(info, "$.website")))
