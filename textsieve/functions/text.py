"""Column expressions for normalising text and cutting it into tokens. All run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, patterns and replacements that the results depend on. Characters that can't be seen or
# are easily taken for others are written as escapes, which Java's patterns read.
SPECIAL_SPACES = r"[\u00A0\u00AD\u200B\uFEFF]"
SPACES_AND_DASHES = "\u00A0\u00AD\u200B\uFEFF|\u2014\u2013\u2011"
TAGS = "<[^>]+>"
VERSE_REFERENCES = r"(?iU)(?=\d)\b\d+[:.]\d+[a-z]?\b"  # the look-ahead only spares the costly boundary test
BREAKS = r"[\u0387\u2058\u00B7;:]"
DASHES = r"[|\u2014\u2013\u2011]"
QUOTES = r"[\u201C\u201D\u00AB\u00BB]"
OUTER_SPACE = r"(?U)^\s+|\s+$"
SENTENCE_ENDS = r"[\n.!?]+"
TOKEN_CLASS = r"0-9A-Za-z\u0400-\u052F\u2DE0-\u2DFF\uA640-\uA69F"
MARKS = r"[\u0483-\u0486\u0488\u0489]"
MARK_CHARACTERS = "\u0483\u0484\u0485\u0486\u0488\u0489"
#: Frequent characters that stand between tokens and end no sentence, and a pattern of all beyond ASCII.
BETWEEN = "".join(c for c in map(chr, (*range(0x400), *range(0x2000, 0x2070))) if not (c.isascii() and c.isalnum()) and c not in "\n.!? ")
BETWEEN_BEYOND_ASCII = r"[^\x00-\x7F[\u0400-\u052F\u2DE0-\u2DFF\uA640-\uA69F]]"


def _where(x: Column, test, change) -> Column:
    """change(x) where test(x) holds, else x, which is worked out once."""
    return F.transform(F.array(x), lambda v: F.when(test(v), change(v)).otherwise(v))[0]


def _beyond_ascii(x: Column) -> Column:
    return F.octet_length(x) > F.length(x)


def normalize_raw(text: Column, drop_tags: bool = True, drop_verse_refs: bool = True) -> Column:
    """Special spaces, tags and verse references to spaces; breaks to full stops; quotes and white space made plain."""
    x = F.regexp_replace(text, SPECIAL_SPACES, " ")
    if drop_tags:
        x = F.regexp_replace(x, TAGS, " ")
    if drop_verse_refs:
        x = F.regexp_replace(x, VERSE_REFERENCES, " ")
    x = F.regexp_replace(F.regexp_replace(x, BREAKS, " . "), DASHES, " ")
    x = F.regexp_replace(F.regexp_replace(x, QUOTES, '"'), r"[\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), OUTER_SPACE, "")


def normalize_token(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, MARKS, ""))


def tokenize(part: Column, token_class: str = TOKEN_CLASS, drop_numeric: bool = True) -> Column:
    """Runs of the token class, marks dropped and lower-cased, without empty ones and (by default) such with digits."""
    found = F.transform(F.regexp_extract_all(part, F.lit(f"([{token_class}]+)"), F.lit(1)), normalize_token)
    return F.filter(found, lambda t: (t != "") & ~t.rlike("[0-9]") if drop_numeric else t != "")


def sentence_tokens(text: Column, token_class: str = TOKEN_CLASS, drop_tags: bool = True, drop_verse_refs: bool = True, drop_numeric: bool = True) -> Column:
    """The tokens of each sentence of a raw text, an array of arrays, as tokenize gives them for the parts of normalize_raw.

    With the default class the whole text is rid of what stands between tokens and single characters cut it, as a pattern
    that tries the class at every character takes most of a query's time. A pattern runs only over texts in which it may
    find something, and steps of normalize_raw that only change what stands between tokens are left out. Another class
    goes by single tokens.
    """
    if token_class != TOKEN_CLASS:
        parts = F.split(normalize_raw(text, drop_tags, drop_verse_refs), SENTENCE_ENDS)
        return F.transform(parts, lambda part: tokenize(part, token_class, drop_numeric))
    x = F.translate(text, SPACES_AND_DASHES, " " * len(SPACES_AND_DASHES))
    if drop_tags:
        x = _where(x, lambda v: v.contains("<"), lambda v: F.regexp_replace(v, TAGS, " "))
    if drop_verse_refs:
        x = F.regexp_replace(x, VERSE_REFERENCES, " ")
    x = _where(x, lambda v: _beyond_ascii(v) | v.contains(";") | v.contains(":"), lambda v: F.regexp_replace(v, BREAKS, " . "))
    x = _where(x, lambda v: F.concat(F.substring(v, 1, 1), F.substring(v, -1, 1)).rlike(r"(?U)\s"), lambda v: F.regexp_replace(v, OUTER_SPACE, ""))
    x = F.translate(x, BETWEEN, " " * len(BETWEEN))
    x = F.lower(_where(x, _beyond_ascii, lambda v: F.regexp_replace(v, BETWEEN_BEYOND_ASCII, " ")))

    def words(part: Column) -> Column:
        plain = F.when(_beyond_ascii(part), F.translate(part, MARK_CHARACTERS, "")).otherwise(part)
        found = F.array_remove(F.split(plain, " "), "")
        return F.when(part.rlike("[0-9]"), F.filter(found, lambda t: ~t.rlike("[0-9]"))).otherwise(found) if drop_numeric else found

    return F.transform(F.split(x, SENTENCE_ENDS), words)


def levenshtein_limit(a: Column, b: Column, limit: int) -> Column:
    """Edit distance, or null beyond the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d >= 0, d)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts' text."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def render_sentence(tokens: Column, highlight: Column | None = None) -> Column:
    shown = tokens if highlight is None else F.transform(tokens, lambda t, i: F.when(i == highlight, F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t))
    return F.array_join(shown, " ")


def render_gap(tokens: Column, gap: Column) -> Column:
    """The sentence with a mark after token `gap`; as it is if no gap lies there."""
    n = F.size(tokens)
    inside = (gap >= 0) & (gap < n - 1)
    marked = F.concat(F.slice(tokens, F.lit(1), gap + 1), F.array(F.lit("**[?]**")), F.slice(tokens, gap + 2, n))
    return F.when(inside, F.array_join(marked, " ")).otherwise(F.array_join(tokens, " "))
