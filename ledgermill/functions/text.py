"""Text expressions: trimming, identity fields, flags and message templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as whitespace at the ends of a field, and the words
# that stand for a missing value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MISSING_WORDS = ("", "none", "null", "nan", "n/a")
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")
NO_CHANGE_PHRASES = ("no change", "not changed", "no changes")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trim spaces only; empty text becomes NULL (the SQL cleaning rule)."""
    return F.nullif(F.trim(column(c)), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace at both ends.

    Text that starts and ends with a printable ASCII character, the usual case, is left alone
    without searching the list of whitespace characters.
    """
    text = column(c)
    plain = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def strip_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def known_or_null(c: Column | str) -> Column:
    """Text, or NULL when it is one of the words for a missing value. Takes ``strip`` text."""
    text = column(c)
    return F.when(~F.lower(text).isin(*MISSING_WORDS), text)


def company_name(c: Column | str) -> Column:
    """Upper case with single spaces. Takes ``strip`` text."""
    return F.upper(F.regexp_replace(column(c), r"(?U)\s+", " "))


def company_number(c: Column | str) -> Column:
    """Upper case; short all-digit numbers get leading zeros up to 8 places. Takes ``strip`` text."""
    text = column(c)
    return F.when(text.rlike("^[0-9]{1,7}$"), F.lpad(text, 8, "0")).otherwise(F.upper(text))


def registry_key(c: Column | str) -> Column:
    """Registry id as whole-number text, zero-padded to 10 places and never cut."""
    text = strip(c)
    whole = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("decimal(38,0)").cast("string"))
    text = F.coalesce(whole, text)
    sign = F.when(text.rlike("^[+-]"), F.substring(text, 1, 1)).otherwise(F.lit(""))
    body = F.when(text.rlike("^[+-]"), text.substr(F.lit(2), F.length(text))).otherwise(text)
    room = F.lit(10) - F.length(sign)
    return F.concat(sign, F.when(F.length(body) < room, F.lpad(body, room, F.lit("0"))).otherwise(body))


def yes_no_text(c: Column | str) -> Column:
    """'True' / 'False' for the known words, any other text unchanged.

    Takes ``known_or_null`` text.
    """
    text = column(c)
    word = F.lower(text)
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit("True"))
        .when(word.isin(*FALSE_WORDS), F.lit("False"))
        .otherwise(text)
    )


def terms_changed_flag(c: Column | str) -> Column:
    """Unknown / Yes / No from a field that holds either a flag or prose.

    Takes ``known_or_null`` text.
    """
    word = F.lower(column(c))
    says_no = F.lit(False)
    for phrase in NO_CHANGE_PHRASES:
        says_no = says_no | word.contains(phrase)
    return (
        F.when(word.isNull(), F.lit("Unknown"))
        .when(word.isin(*TRUE_WORDS), F.lit("Yes"))
        .when(word.isin(*FALSE_WORDS) | says_no, F.lit("No"))
        .otherwise(F.lit("Yes"))
    )


def mentions_any(c: Column | str, words: Sequence[str]) -> Column:
    """1 when any word occurs anywhere in the text (inside longer words too), else 0."""
    text = F.lower(column(c))
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return F.coalesce(hit, F.lit(False)).cast("int")


def fill(template: str, values: Mapping[str, Column | str | int | float]) -> Column:
    """A message column from a ``{name}`` template; plain Python values are folded into the text."""
    parts: list[Column] = []
    literal = ""
    for text, name, _, _ in Formatter().parse(template):
        literal += text
        if name is None:
            continue
        value = values[name]
        if isinstance(value, Column):
            if literal:
                parts.append(F.lit(literal))
                literal = ""
            parts.append(value)
        else:
            literal += str(value)
    if literal:
        parts.append(F.lit(literal))
    return parts[0] if len(parts) == 1 else F.concat(*parts)
