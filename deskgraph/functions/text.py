"""Text column helpers built only from JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskgraph import defaults as D

# White space as str.isspace sees it; the same class text works in Java and RE2.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
_HANDLE = "[a-zA-Z0-9_]"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A pattern written for Unicode text, given the flags Java needs to read it so.

    ``U`` makes ``\\w \\d \\s \\b`` Unicode-aware and ``d`` lets ``.`` stop at ``\\n`` only.
    """
    return f"(?{'i' if ignore_case else ''}dU){pattern}"


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether ``pattern`` occurs anywhere in ``text``; null text counts as no match."""
    return F.coalesce(text.rlike(java_regex(pattern, ignore_case)), F.lit(False))


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    """Remove white space at both ends only."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def tokens(text: Column) -> Column:
    """White-space tokens; blank or null text gives an empty array."""
    clean = squeeze(F.coalesce(text, F.lit("")))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def word_count(text: Column) -> Column:
    clean = squeeze(F.coalesce(text, F.lit("")))
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " ")))


def words(text: Column, shape: str) -> Column:
    """Every maximal word of ``text`` whose letters all fit ``shape`` (``\\b shape \\b``)."""
    return F.regexp_extract_all(text, F.lit(f"(?<![{WORD}]){shape}(?![{WORD}])"), F.lit(0))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Substring test against a short fixed list."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return F.coalesce(found, F.lit(False))


def is_ascii(text: Column) -> Column:
    """At least one character and none beyond ASCII."""
    return F.coalesce(text.rlike(r"^[\x00-\x7F]+\z"), F.lit(False))


def _mask_handles(text: Column, brand: str | Column, aliases: Sequence[str]) -> Column:
    """Rename every ``@handle``: the brand and its aliases to the brand, all others to ``@customer``."""
    others = "|".join(aliases)
    if isinstance(brand, str):
        name = F.lit(brand)
        kept = F.lit(rf"(?i:\Q{brand}\E|{others})(?!{_HANDLE})")
    else:
        name = brand
        kept = F.concat(F.lit(r"(?i:\Q"), brand, F.lit(rf"\E|{others})(?!{_HANDLE})"))
    masked = F.regexp_replace(text, F.concat(F.lit("@(?!"), kept, F.lit(f"){_HANDLE}+")), F.lit("@customer"))
    safe_name = F.regexp_replace(name, r"([\\$])", r"\\$1")
    return F.regexp_replace(masked, F.concat(F.lit("@"), kept), F.concat(F.lit("@"), safe_name))


def _normalize(text: Column, brand: str | Column, aliases: Sequence[str], any_case_url: bool) -> Column:
    url = ("(?i)" if any_case_url else "") + D.URL_PATTERN.replace(r"\S", f"[^{SPACE}]")
    without_urls = F.regexp_replace(F.coalesce(text, F.lit("")), url, "[URL]")
    return squeeze(_mask_handles(without_urls, brand, aliases))


def normalize_corpus_text(
    text: Column, brand: str | Column, aliases: Sequence[str] = D.CORPUS_ALIASES
) -> Column:
    """Clean a stored message: links to ``[URL]``, handles masked, the brand name kept as given.

    ``brand`` may be a column when one table holds several brands.
    """
    return _normalize(text, brand, aliases, any_case_url=False)


def normalize_message(
    text: Column, brand: str = D.BRAND_HANDLE, aliases: Sequence[str] = D.MESSAGE_ALIASES
) -> Column:
    """Clean an incoming message: like the corpus form, with a lower-cased brand and case-blind links."""
    return _normalize(text, brand.lower(), aliases, any_case_url=True)
