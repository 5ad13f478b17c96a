"""Text column expressions: whitespace, lines, tokens, identifiers, normalisation.

All of them are native expressions, so they run in the JVM inside whatever stage uses them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip or whitespace split treats as blank.
WS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
))
# Three blanks that become a space, then four characters without width.
ODD_BLANKS = "\u00a0\u2007\u202f\u200b\u200c\u200d\ufeff"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
DEV = "\u0900-\u097f"

# Identifier patterns (standards are case-sensitive, gazette numbers are not).
STANDARD_PATTERN = (
    r"(?U)\bIS(?:\s*/\s*(?:IEC|ISO|EN))?\s*:?\s*\d{3,5}"
    r"(?:\s*-\s*\d{1,2}(?!\d))?"
    r"(?:\s*\(?\s*(?:Part|Pt\.?)\s*\d+\s*\)?)?"
    r"(?:\s*[:\-]\s*(?:19|20)\d{2})?"
)
GAZETTE_PATTERN = r"(?iU)\b(?:S\.?\s?O\.?|G\.?S\.?R\.?)\s*\.?\s*\d{1,5}\s*\(\s*E\s*\)"
GAZETTE_END = r"(?iU)\(\s*E\s*\)"
# Blanks of a query, where they stand for the search syntax characters.
QUERY_SYNTAX = '":^*(){}[]~/\\+,-'


def _accent_table() -> tuple[str, str]:
    """Latin letters up to U+024F and their base letter, derived from Unicode decomposition."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii():
            accented.append(chr(code))
            plain.append(parts[0])
    # Combining marks have no counterpart, so translate() deletes them.
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(accented) + marks, "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly value once for an expression that reads it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_ws(col: Column) -> Column:
    """Trim every kind of Unicode blank, not only spaces; no regular expression."""
    return F.trim(col, F.lit(WS_CHARS))


def strip_begin(col: Column) -> Column:
    return F.ltrim(col, F.lit(WS_CHARS))


def strip_held(col: Column) -> Column:
    """``strip_ws`` of a value that is already bound: the end, whose cut lists all characters first, is cut only where it is blank."""
    begun = strip_begin(col)
    return F.when(F.contains(F.lit(WS_CHARS), F.substring(col, -1, 1)), F.rtrim(begun, F.lit(WS_CHARS))).otherwise(begun)


def squeeze(col: Column) -> Column:
    """Collapse blank runs to one space and trim."""
    return F.trim(F.regexp_replace(col, f"[{WS}]+", " "))


def split_words(col: Column) -> Column:
    """Split on blank runs, without empty parts."""
    return F.filter(F.split(col, f"[{WS}]+"), lambda w: w != "")


def split_lines(col: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    return let(F.split(col, LINE_BREAK), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def fold(col: Column) -> Column:
    """Lower-case and remove Latin diacritics; plain ASCII skips the character table."""
    low = F.lower(col)
    return F.when(F.octet_length(col) == F.length(col), low).otherwise(F.translate(low, _ACCENTED, _PLAIN))


def search_tokens(col: Column) -> Column:
    """Tokens of the keyword index: letter and digit runs, lower-cased and folded."""
    return F.regexp_extract_all(fold(col), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def has_devanagari(col: Column) -> Column:
    return col.rlike(f"[{DEV}]")


def normalise(col: Column) -> Column:
    """Drop zero-width characters, unify blanks, keep at most one empty line.

    Each step runs only on texts that hold what it changes; looking for that is much cheaper.
    """

    def where(value: Column, held: list[str], change: Callable[[Column], Column]) -> Column:
        return let(value, lambda v: F.when(reduce(Column.__or__, [v.contains(h) for h in held]), change(v)).otherwise(v))

    joined = where(col, list(ODD_BLANKS), lambda v: F.translate(v, ODD_BLANKS, "   "))
    single = where(joined, ["  ", "\t"], lambda v: F.regexp_replace(v, "[ \t]+", " "))
    return let(where(single, ["\n\n\n"], lambda v: F.regexp_replace(v, "\n{3,}", "\n\n")), strip_held)


def _none() -> Column:
    return F.array().cast("array<string>")


def standard_numbers(col: Column) -> Column:
    """Standard numbers in order of appearance, blanks unified, upper-cased, distinct."""
    found = F.regexp_extract_all(col, F.lit(STANDARD_PATTERN), F.lit(0))
    named = F.array_distinct(
        F.transform(found, lambda m: F.trim(F.regexp_replace(F.upper(squeeze(m)), "[:-]+\\z", "")))
    )
    return F.when(~col.contains("IS"), _none()).otherwise(named)


def gazette_numbers(col: Column) -> Column:
    """Gazette numbers in order of appearance, blanks unified, upper-cased, distinct."""
    found = F.regexp_extract_all(col, F.lit(GAZETTE_PATTERN), F.lit(0))
    named = F.array_distinct(F.transform(found, lambda m: F.upper(squeeze(m))))
    return F.when(~col.contains("("), _none()).when(~col.rlike(GAZETTE_END), _none()).otherwise(named)


def identifiers(col: Column) -> Column:
    """Standards first, then gazette numbers."""
    return F.concat(standard_numbers(col), gazette_numbers(col))


def joined(ids: Column) -> Column:
    """Identifier list as stored beside a chunk."""
    return F.array_join(ids, " | ")


def title_of(filename: Column) -> Column:
    """Readable title: no extension, duplicate markers and separators become blanks."""
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*\z", "")
    stem = F.regexp_replace(stem, r"__dup\d*__?", " ")
    return squeeze(F.regexp_replace(stem, r"[_\-]+", " "))


# Code page 1252 characters at bytes 0x80-0x9f that Latin-1 lacks.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def fix_mojibake(col: Column) -> Column:
    """Undo UTF-8 text that was read as code page 1252.

    The repaired text is taken only if the telltale character was there and is gone.
    """
    return let(col, lambda text: F.when(text.contains("â"), _repaired(text)).otherwise(text))


def _repaired(text: Column) -> Column:
    as_latin1 = F.translate(
        F.translate(text, "\u0081\u008d\u008f\u0090\u009d", "\uffff" * 5),
        _CP1252, "".join(chr(c.encode("cp1252")[0]) for c in _CP1252),
    )
    c1 = F.translate(text, "".join(chr(c) for c in range(0x80, 0xA0)), "\uffff" * 32)
    encodable = ~as_latin1.rlike("[^\\x{0}-\\x{ff}]") & ~c1.contains("\uffff")
    decoded = F.when(encodable, F.try_validate_utf8(F.encode(as_latin1, "ISO-8859-1").cast("string")))
    return F.when(~decoded.contains("â"), decoded).otherwise(text)
