"""Text expressions. All stay inside the JVM; patterns are literals compiled once per task."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from re import _parser as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode word characters and white space, spelled out so that Java and RE2 agree.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# White space is listed, not classed, which lets the matcher test it with a table.
_SPACES = r"\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[ {_SPACES}]"
# The same with and without the blank, behind a few ranges that rule most characters out at once. Java only.
_NEAR = r"\x{7f}-\x{a0}\x{1680}-\x{3000}"
_FAST_SPACE = rf"[\x{{0}}- {_NEAR}&&[ {_SPACES}]]"
_FAST_OTHER = rf"[\x{{0}}-\x{{1f}}{_NEAR}&&[{_SPACES}]]"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any Unicode kind (``trim`` knows only blanks)."""
    return F.btrim(col, F.lit(SPACE_CHARACTERS))


def squeeze(col: Column) -> Column:
    """Every run of white space becomes one blank; single blanks are left alone."""
    return strip(F.regexp_replace(col, f" {_FAST_SPACE}+|{_FAST_OTHER}{_FAST_SPACE}*", " "))


def quote(literal: str) -> str:
    """Escape a literal for a pattern, in a spelling Java and RE2 both read."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def word_pattern(words: Sequence[str]) -> str:
    """A pattern for whole words or phrases, matched against lower-cased text."""
    inner = "|".join(quote(w.strip().lower()) for w in words if w.strip())
    return f"(^|{NOT_WORD})({inner})({NOT_WORD}|$)"


def has_word(col: Column, words: Sequence[str], case_sensitive: bool = False) -> Column:
    """Whole-word match of any of ``words``; false for NULL or empty text."""
    if not any(w.strip() for w in words):
        return F.lit(False)
    inner = "|".join(quote(w.strip()) for w in words if w.strip())
    flags = "" if case_sensitive else "(?iu)"
    pattern = f"{flags}(?<!{WORD})(?:{inner})(?!{WORD})"
    return F.coalesce(col.rlike(pattern), F.lit(False))


def has_any(col: Column, parts: Sequence[str]) -> Column:
    """True if any of the literal substrings occurs; false for NULL."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(col, F.lit(part))
    return F.coalesce(found, F.lit(False))


def unicode_pattern(pattern: str) -> str:
    """Give a pattern case-insensitive Unicode semantics for ``\\b``, ``\\w`` and ``\\s``."""
    return f"(?iuU){pattern}"


def clean_text(col: Column, brand: str) -> Column:
    """Drop the leading run of @mentions and every mention of ``brand``, and squeeze white space.

    Text that is nothing but mentions comes back trimmed instead of empty; NULL becomes "". That
    case is told by a pattern of its own, so that the long way is taken once per text.
    """
    lead, own = f"(?:@{WORD}+{SPACE}*)", f"@{quote(brand)}(?!{WORD})"
    body = F.regexp_replace(col, f"^{lead}+", "")
    if brand:
        body = F.regexp_replace(body, f"(?iu){own}", "")
    nothing_else = col.rlike(f"(?iu)\\A{lead}*+(?:{own}|{SPACE})*+\\z") if brand else col.rlike(f"\\A{lead}*+{SPACE}*+\\z")
    return F.when(col.isNull(), F.lit("")).when(nothing_else, strip(col)).otherwise(squeeze(body))


def strip_mentions(col: Column) -> Column:
    return strip(F.regexp_replace(col, f"@{WORD}+", ""))


def is_blank(col: Column) -> Column:
    """True for NULL and for text without any character but white space."""
    return ~F.coalesce(col.rlike(f"[^ {_SPACES}]"), F.lit(False))


def ascii_only(col: Column) -> Column:
    """Drop non-ASCII characters, unless nothing would remain."""
    some = col.rlike(r"[\x00-\x08\x0e-\x1b\x21-\x7f]")
    return strip(F.when(some, F.regexp_replace(col, r"[^\x00-\x7F]", "")).otherwise(col))


def left(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def precedent_document(message: Column, action: Column) -> Column:
    """The text that is embedded for a precedent."""
    return F.concat(F.lit("Customer: "), message, F.lit(" | Action: "), action)


def query_document(message: Column) -> Column:
    return F.concat(F.lit("Customer: "), message)


def display_document(message: Column, action: Column) -> Column:
    """The text that is shown for a precedent."""
    return F.concat(message, F.lit("\nAction: "), action)


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


# Letters that parts of patterns may have besides ASCII, and the characters that case-insensitive patterns take for one of these or an
# ASCII letter, although their lower case is another one.
_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_ODD_CASE = {"\u0130": "i", "\u0131": "i", "\u017f": "s"}
_PLAIN = frozenset(map(chr, range(32, 127))) | frozenset(_LATIN + "¿¡")


def _needed(parsed) -> set[str] | None:
    """Parts, in lower case, of which a match of a parsed pattern holds at least one; None if there are no such parts."""
    best, run = None, ""
    for kind, value in [*parsed, (None, None)]:
        letter = chr(value).lower() if kind is sre.LITERAL else ""
        if letter in _PLAIN:
            run += letter
            continue
        found, inner = {run} if run else None, None
        run = ""
        if kind is sre.SUBPATTERN:
            inner = _needed(value[-1])
        elif kind is sre.BRANCH:
            parts = [_needed(p) for p in value[1]]
            inner = None if None in parts else set().union(*parts)
        elif kind is sre.IN:
            parts = [_needed([one]) for one in value]
            inner = None if None in parts else set().union(*parts)
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            inner = _needed(value[-1])
        for some in (found, inner):
            if some and (best is None or min(map(len, some)) > min(map(len, best))):
                best = some
    return best


def needed_parts(pattern: str) -> list[str] | None:
    """Parts in lower case, one of which is in every folded text that a case-insensitive match of ``pattern`` is in.

    None if that can't be told, as the pattern has a syntax that Java's and Python's patterns do not share, or if some part is of one
    or two letters, which most texts hold.
    """
    if re.search(r"\(\?(?!:)|\[[^\]]*\[|&&|\\[^bBdDsSwW.$?*+|(){}\\^-]|[*+?}]\+", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            found = _needed(sre.parse(pattern))
    except (re.error, Warning):
        return None
    if not found or any(len(p) < 3 and p.isalnum() for p in found):
        return None
    # A part that holds another one adds nothing.
    return sorted(p for p in found if not any(q != p and q in p for q in found))


def first_match(rules: Sequence[tuple[str, str]], col: Column, only_if: Sequence[Column] | None = None) -> Column:
    """Label of the first rule whose pattern occurs in ``col``, else NULL. Order matters.

    ``only_if`` has a cheap condition for each rule, without which its pattern occurs nowhere and is not tried.
    """
    tried = [col.rlike(pattern) for _, pattern in rules]
    if only_if is not None:
        tried = [cheap & match for cheap, match in zip(only_if, tried)]
    return F.coalesce(*[F.when(match, F.lit(label)) for (label, _), match in zip(rules, tried)])


def folded(col: Column) -> Column:
    """The text with the characters in lower case that a case-insensitive pattern takes for an ASCII letter."""
    for odd, plain in _ODD_CASE.items():
        col = F.replace(col, F.lit(odd), F.lit(plain))
    return F.lower(col)


def may_match(pattern: str, folded_text: Column) -> Column:
    """False only if ``unicode_pattern(pattern)`` does not occur in the text that was folded."""
    parts = needed_parts(pattern)
    if parts is None:
        return F.lit(True)
    return has_any(folded_text, parts)
