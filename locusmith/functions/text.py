"""Text normalisation as column expressions; Python only for Unicode composition and numeric character references."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the footnote references of two page families, and of one that has none.
FOOTNOTE_NAMED = r'(?is)<a\b[^>]*\bname="JB\d+"[^>]*>.*?</a>'
FOOTNOTE_RAISED = r'(?is)<sup\b[^>]*>\s*<a\b[^>]*\bname\s*=\s*"?-[0-9A-Za-z]+"?[^>]*>.*?</a>\s*</sup>'
FOOTNOTE_NONE = ""
# Tags that separate words, and all others.
BLOCK_TAG = r"(?i)</?(?:p|div|blockquote|br|li|ul|ol|table|tr|td|th|h[1-6]|hr|dl|dt|dd|pre)\b[^>]*>"
ANY_TAG = r"<[^>]+>"
# The named references that are decoded, in order; &amp; comes last of all.
NAMED_REFERENCES = (("nbsp", " "), ("quot", '"'), ("ldquo", "“"), ("lt", "<"), ("gt", ">"))
#: White space as ECMAScript has it, with the figure and narrow no-break spaces.
BLANKS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def without_footnotes(html: Column, pattern: str) -> Column:
    """html without the footnote references of a page family; the pattern must be named, FOOTNOTE_NONE changes nothing."""
    return F.regexp_replace(html, pattern, "") if pattern else html


def blocks_to_spaces(html: Column) -> Column:
    return F.regexp_replace(html, BLOCK_TAG, " ")


def without_tags(html: Column) -> Column:
    """An inline tag is no word boundary, so nothing stays in its place."""
    return F.regexp_replace(html, ANY_TAG, "")


def named_references(text: Column) -> Column:
    for name, meant in NAMED_REFERENCES:
        text = F.regexp_replace(text, f"(?i)&{name};", meant)
    return text


_DECIMAL, _HEX, _AMP = re.compile(r"&#(\d+);"), re.compile(r"&#[xX]([0-9a-fA-F]+);"), re.compile("&amp;", re.I)


def _code_point(digits: str, base: int, whole: str) -> str:
    value = int(digits, base) if len(digits) < 10 else 0x110000
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else whole


def _decode_numeric(text: str) -> str:
    if "&#" not in text:
        return text
    text = _DECIMAL.sub(lambda m: _code_point(m.group(1), 10, m.group()), text)
    return _HEX.sub(lambda m: _code_point(m.group(1), 16, m.group()), text)


def _compose(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def _numeric(texts: pd.Series) -> pd.Series:
    return texts.map(_decode_numeric, na_action="ignore")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(_compose, na_action="ignore")


@F.pandas_udf(StringType())
def _numeric_amp_nfc(texts: pd.Series) -> pd.Series:
    """The steps of normalising that no built-in has, in one crossing to Python."""
    return texts.map(lambda t: _compose(_AMP.sub("&", _decode_numeric(t))), na_action="ignore")


def numeric_references(text: Column) -> Column:
    """Decimal and hexadecimal references decoded; those that name no character stay."""
    return _numeric(text)


def decoded_references(text: Column) -> Column:
    """Named, then numeric references, &amp; last; unknown names stay as they are."""
    return F.regexp_replace(numeric_references(named_references(text)), "(?i)&amp;", "&")


def nfc(text: Column) -> Column:
    """Unicode NFC."""
    return _nfc(text)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def normalised(fragment: Column, footnotes: str) -> Column:
    """The text of a unit: footnote references out, block tags to spaces, other tags out, references decoded, NFC, blanks collapsed."""
    bare = without_tags(blocks_to_spaces(without_footnotes(fragment, footnotes)))
    return collapsed(_numeric_amp_nfc(named_references(bare)))


def without_marker_residue(text: Column) -> Column:
    """Text without the full stop or blank a marker left at its start."""
    return F.regexp_replace(text, r"^[.\s]+", "")


def folded_locator(label: Column) -> Column:
    """One spelling of a printed address: no ordinal sign, IIae as II, no commas, single blanks."""
    plain = F.regexp_replace(F.regexp_replace(label, "(?i)&ordf;|ª", ""), "IIae", "II")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, ",", ""), r"\s+", " "))


def contents_spelling(label: Column) -> Column:
    return F.regexp_replace(label, r"\bad arg\.$", "ad")


def slug(heading: Column) -> Column:
    """The anchor of a heading: link text kept, tags out, lower case, only letters, digits, blanks, _ and -; every blank a hyphen."""
    text = F.regexp_replace(heading, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.lower(F.trim(without_tags(text)))
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", ""), " ", "-")


def source_of(locator: Column) -> Column:
    """The part of a locator before its first colon."""
    return F.split_part(locator, F.lit(":"), F.lit(1))


def article_of(locator: Column) -> Column:
    """A locator up to its last full stop; all of it if there is none."""
    return F.regexp_replace(locator, r"\.[^.]*$", "")


def anchor_of(number: Column) -> Column:
    """K and the number in at least four digits."""
    return F.concat(F.lit("K"), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0")))
