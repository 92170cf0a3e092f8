"""Text expressions: dialogue text, tags, names, versions. All built-in, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def visible_text(x: Column | str) -> Column:
    r"""Text as shown: override tags {...} out, \N, \n and \h to a space, white space collapsed and trimmed."""
    out = F.regexp_replace(_c(x), r"\{[^}]*\}", "")
    out = F.regexp_replace(out, r"\\[Nnh]", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")


def normalised(x: Column | str) -> Column:
    """Lower case, only word characters and white space, collapsed and trimmed."""
    out = F.regexp_replace(F.lower(_c(x)), r"(?U)[^\w\s]", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")


def undoubled(x: Column | str) -> Column:
    """The first half of a text of four or more characters whose halves are equal; else the text."""
    c = _c(x)
    half = (F.length(c) / 2).cast("int")
    same = (F.length(c) >= 4) & (F.length(c) % 2 == 0) & (F.substr(c, F.lit(1), half) == F.substr(c, half + 1, half))
    return F.when(same, F.substr(c, F.lit(1), half)).otherwise(c)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty texts."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def near_reading(a: Column | str, b: Column | str) -> Column:
    """Whether three times the distance is no more than the longer length."""
    a, b = _c(a), _c(b)
    return 3 * F.levenshtein(a, b) <= F.greatest(F.length(a), F.length(b))


def is_subsequence(short: Column | str, long: Column | str) -> Column:
    """Whether a text is left when characters of another are dropped."""
    a, b = _c(short), _c(long)
    found = F.aggregate(F.split(b, ""), F.lit(0), lambda s, x: s + F.when(F.substr(a, s + 1, F.lit(1)) == x, 1).otherwise(0))
    return found == F.length(a)


def supports(a: Column | str, b: Column | str) -> Column:
    """Near readings, or one of two and more characters that is the other with characters dropped."""
    a, b = _c(a), _c(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return near_reading(a, b) | ((F.length(short) >= 2) & is_subsequence(short, long))


def anagram(a: Column | str, b: Column | str) -> Column:
    """Same letters, for texts whose lengths differ by no more than a tenth of the longer."""
    a, b = _c(a), _c(b)
    close = 10 * F.abs(F.length(a) - F.length(b)) <= F.greatest(F.length(a), F.length(b))
    letters = lambda c: F.array_sort(F.split(c, ""))
    return close & (letters(a) == letters(b))


def count_or_zero(x: Column | str) -> Column:
    """A text that is a whole number of 0 or more, of any length, without leading zeros; else '0'."""
    c = F.trim(_c(x))
    return F.when(c.rlike("^[0-9]+$"), F.regexp_replace(c, "^0+(?=[0-9])", "")).otherwise(F.lit("0"))


def safe_tag(x: Column | str, default: str = "zh") -> Column:
    """A name for files: runs of other characters to _, no _ or - at the ends; a default when nothing is left."""
    out = F.regexp_replace(F.regexp_replace(_c(x), "[^A-Za-z0-9_-]+", "_"), "^[_-]+|[_-]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def stem(x: Column | str) -> Column:
    """The last part of a path without its extension."""
    last = F.element_at(F.split(_c(x), "/"), -1)
    return F.regexp_replace(last, r"(.)\.[^.]*$", "$1")


def extension(x: Column | str) -> Column:
    """The extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(_c(x), "/"), -1), r".(\.[^.]*)$", 1))


def version_parts(x: Column | str) -> Column:
    """The numbers of a dotted version; parts that begin with no digit count as 0."""
    return F.transform(F.split(_c(x), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "^[0-9]{1,9}", 0), F.lit("")).cast("int"), F.lit(0)))


def is_noise(x: Column | str) -> Column:
    """Texts that cannot be speech: rules, digits or marks only, a lone letter other than I, underscores."""
    c = F.trim(_c(x))
    return c.rlike(r"^(-{2,}|`+|[0-9]+|_+|[!-/:-@\[-`{-~]|[A-HJ-Za-z])$") | (c == "")


#: The column list that a header line names.
HEADER_FIELDS = "layer,start,end,style,name,marginl,marginr,marginv,effect,text"


def is_header_echo(x: Column | str) -> Column:
    """Texts that repeat the header line of the columns."""
    flat = F.regexp_replace(F.lower(_c(x)), " ", "")
    return F.contains(flat, F.lit(HEADER_FIELDS)) | F.trim(_c(x)).rlike(r"(?i)^format:$")


def _known(word: Column, words: Sequence[str] | None) -> Column:
    """Whether a word is in the dictionary; without one every word is."""
    return F.lit(True) if words is None else F.lower(word).isin([w.lower() for w in words])


def is_fake(x: Column | str, words: Sequence[str] | None = None) -> Column:
    """All rules for texts that cannot be speech; an empty text is none of them.

    Besides is_noise: header lines, dashes with blanks between, the box of a missing character, one letter
    other than I and two letters that are no word, also with dots, dashes and blanks behind them.
    """
    c = F.trim(_c(x))
    lone = F.regexp_extract(c, r"^([A-Za-z])[\s.\-]*$", 1)
    pair = F.regexp_extract(c, r"^([A-Za-z]{2})[\s.\-]*$", 1)
    return (c != "") & (
        is_header_echo(c)
        | c.rlike(r"^(-[\s-]*-+|`+|[0-9]+|_+|[^\w\s])$")
        | F.contains(c, F.lit("\u25a1"))
        | ((lone != "") & (lone != "I"))
        | ((pair != "") & ~_known(pair, words))
    )


def is_break_garbage(segment: Column | str, conservative: bool = False, words: Sequence[str] | None = None) -> Column:
    """Whether what stands between two breaks is nothing, a number, one mark, backticks or underscores; unless
    conservative, also a lone letter or ideograph, or two letters that are no word."""
    c = F.trim(_c(segment))
    out = (c == "") | c.rlike(r"^([0-9]+|[^\w\s]|`+|_+)$")
    if conservative:
        return out
    return out | c.rlike("^([A-Za-z]|[\u4e00-\u9fff])$") | (c.rlike("^[A-Za-z]{2}$") & ~_known(c, words))


def clean_breaks(x: Column | str, conservative: bool = False, words: Sequence[str] | None = None) -> Column:
    """A text without the garbage between its \\N breaks; {...} marks do not count, and stay with what is kept."""
    parts = F.split(_c(x), r"\\N", -1)
    kept = F.filter(parts, lambda p: ~is_break_garbage(F.regexp_replace(p, r"\{[^}]*\}", ""), conservative, words))
    return F.when(F.size(parts) > 1, F.array_join(kept, "\\N")).otherwise(_c(x))


def escape_breaks(x: Column | str) -> Column:
    """Line breaks as the two characters \\N."""
    return F.replace(F.replace(_c(x), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\N"))
