"""Text that looks the same but differs in its characters: one skeleton per look, and the texts that share it.

The look-alike letters are those of Unicode's public table, read at start-up from the ICU library that Spark brings along; signs, and what
that table joins although it looks different (1 and l, 0 and O, æ and ae), follow the short table here.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters and signs of one shape, by prototype (left) and those drawn like it (right), after decomposition.
LOOK_ALIKES = {
    "a": "аɑα",
    "c": "сϲᴄ",
    "d": "ԁ",
    "e": "еҽ",
    "g": "ɡց",
    "h": "һհ",
    "i": "іι",
    "j": "јϳ",
    "k": "κк",
    "l": "ӏ",
    "n": "ո",
    "o": "оοօᴏ",
    "p": "рρ",
    "q": "ԛ",
    "s": "ѕꜱ",
    "u": "υսᴜ",
    "v": "νѵᴠ",
    "w": "ԝᴡ",
    "x": "хχ",
    "y": "уγү",
    "z": "ᴢ",
    "A": "АΑ",
    "B": "ВΒ",
    "C": "СϹ",
    "E": "ЕΕ",
    "F": "Ϝ",
    "G": "Ԍ",
    "H": "НΗ",
    "I": "ІΙӀ",
    "J": "ЈͿ",
    "K": "КΚ",
    "M": "МΜϺ",
    "N": "Ν",
    "O": "ОΟՕ",
    "P": "РΡ",
    "Q": "Ԛ",
    "S": "ЅՏ",
    "T": "ТΤ",
    "U": "Ս",
    "V": "Ѵ",
    "W": "Ԝ",
    "X": "ХΧ",
    "Y": "ҮΥ",
    "Z": "Ζ",
    "æ": "ӕ",
    "Æ": "Ӕ",
    "ə": "ә",
    ";": ";",
    "-": "‐‑−﹣",
    "·": "·∙⋅",
    "'": "ʹʼ",
    ":": "ː։꞉",
    "/": "⁄∕",
    "|": "ǀ∣",
    "!": "ǃ",
    "µ": "μ",
    "Å": "Å",
    "Ω": "Ω",
    "×": "⨯",
}
#: Compatibility forms that keep the look: width, blanks, and ligatures or numerals drawn as their letters.
SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<noBreak>"}
SAME_LOOK_RANGES = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0x00A0, 0x00A0))
#: Characters without a look that Unicode does not class as format characters.
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
PROTOTYPE = {ord(x): prototype for prototype, likes in LOOK_ALIKES.items() for x in likes}


def joined_looks(spark: SparkSession) -> dict[int, str]:
    """Prototype by code point for the letters and numbers that Unicode's table of look-alikes joins with others; some thousand entries, whatever the data.

    ASCII characters stay apart. Where the table joins several of them (1, I, l; 0, O), a letter goes to the one of its case and a number to the
    digit. What the table writes as several letters (æ as ae) stays as it is, and classes that hold a letter of LOOK_ALIKES have its prototype.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    codes = [c for c in range(0x21, 0x110000) if c < 0x7F or c > 0xA0 and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo", "Nd", "Nl", "No")]
    looks: dict[int, str] = {}
    for at in range(0, len(codes), 20_000):
        part = codes[at : at + 20_000]
        looks.update(zip(part, checker.getSkeleton("\n".join(map(chr, part))).split("\n"), strict=True))
    ascii_looks: dict[str, list[str]] = {}
    for code in range(0x21, 0x7F):
        ascii_looks.setdefault(looks[code], []).append(chr(code))
    preferred = {looks[code]: prototype for code, prototype in PROTOTYPE.items() if code in looks and not looks[code].isascii()}
    out = {}
    for code in (c for c in codes if c > 0x7F and c not in PROTOTYPE):
        ch, look = chr(code), looks[code]
        if len(unicodedata.normalize("NFD", ch)) > 1 or look == ch and look not in preferred:
            continue
        if alike := ascii_looks.get(look):
            kind = unicodedata.category(ch)
            wanted = str.isupper if kind in ("Lu", "Lt") else str.isdigit if kind[0] == "N" else str.islower
            out[code] = next(filter(wanted, alike), look if len(look) == 1 else alike[0])
        elif not (look.isascii() and len(look) > 1):
            out[code] = preferred.get(look, look)
    known = {**out, **PROTOTYPE}
    return {code: "".join(known.get(ord(c), c) for c in look) if len(look) > 1 else look for code, look in out.items()}


@cache
def _table(application: str) -> dict[int, str]:
    return joined_looks(SparkSession.getActiveSession())


def drawn(code: int, joined: Mapping[int, str]) -> str:
    """The prototype characters a character of a decomposed text is drawn as; empty if it has no look."""
    ch = chr(code)
    if code < 0x80:
        return ch
    if code in PROTOTYPE:
        return PROTOTYPE[code]
    if code in UNSEEN or unicodedata.category(ch) == "Cf":
        return ""
    tag, _, parts = unicodedata.decomposition(ch).rpartition("> ")
    if parts and (f"{tag}>" in SAME_LOOK_TAGS or any(a <= code <= b for a, b in SAME_LOOK_RANGES)):
        return "".join(drawn(int(p, 16), joined) for p in parts.split())
    if code in joined:
        return joined[code]
    return " " if unicodedata.category(ch) == "Zs" else ch


class Drawing(dict):
    """drawn() as a translation table that fills itself with the characters it meets."""

    def __init__(self, joined: Mapping[int, str]) -> None:
        self.joined = joined

    def __missing__(self, code: int) -> str:
        self[code] = out = drawn(code, self.joined)
        return out


#: The drawing without Unicode's table, for what needs no more than the usual look-alikes.
USUAL = Drawing({})


def skeleton(text: str, drawing: Drawing = USUAL) -> str:
    """The form all texts of one look share: decompose, replace every character by its prototype, decompose again.

    Letter case, accents, raised figures, ligature letters such as æ, signs and words stay apart.
    """
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(drawing))


def one_form(text: str, drawing: Drawing = USUAL) -> str:
    """The skeleton composed again: the text to keep in place of all that look like it."""
    return unicodedata.normalize("NFC", skeleton(text, drawing))


def formed(spark: SparkSession, text: Column, composed: bool = False) -> Column:
    """skeleton of a text column (one_form if composed) by Unicode's whole table, which goes to the executors once. Null stays null."""
    table = spark.sparkContext.broadcast(_table(spark.sparkContext.applicationId))
    form = one_form if composed else skeleton

    @F.pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        drawing = Drawing(table.value)
        return texts.map(lambda t: form(t, drawing), na_action="ignore")

    return apply(text)


def one_formed(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, form): the one form of every row's text. Null stays null, an empty text empty; repeated rows stay repeated, and no text is shuffled."""
    return df.select(key, formed(df.sparkSession, F.col(text), composed=True).alias("form"))


def look(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """df's distinct (key..., skeleton and text as digests); rows whose text is null or has no visible character are left out.

    Digests of 128 bits travel instead of texts, so a very long text costs no more in the shuffle than a short one.
    """
    rows = df.select(*key, F.col(text).alias("_text")).where("_text IS NOT NULL").withColumn("_skeleton", formed(df.sparkSession, F.col("_text")))
    seen = F.regexp_replace("_skeleton", r"[\s\p{Z}\p{C}]+", "") != ""
    return rows.where(seen).select(*key, F.unhex(F.md5("_skeleton")).alias("_look"), F.unhex(F.md5("_text")).alias("_text")).distinct()


def same_look_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, by: list[str]) -> DataFrame:
    """(left_id, right_id), distinct, of rows equal in the by columns whose texts differ but share a skeleton.

    Null in a by column or an id matches nothing. Copies of an id with the same text meet as one row.
    """
    a = look(left, [left_id, *by]).withColumnRenamed("_text", "_left")
    b = look(right, [right_id, *by]).withColumnRenamed("_text", "_right")
    return a.join(b, [*by, "_look"]).where("_left <> _right").select(left_id, right_id).distinct()


def look_classes(df: DataFrame, key: str, by: list[str], text: str = "text") -> DataFrame:
    """One row per key: its look class and the number of keys and of different texts in it.

    The class is the digest of the skeleton with the by columns. Counting is by combination in the map tasks, so a class
    that holds a third of all rows is never gathered.
    """
    rows = look(df, [key, *by], text)
    sizes = rows.groupBy(*by, "_look", "_text").agg(F.count(F.lit(1)).alias("_k")).groupBy(*by, "_look").agg(F.sum("_k").alias("members"), F.count(F.lit(1)).alias("texts"))
    return rows.join(sizes, [*by, "_look"]).select(key, F.lower(F.hex("_look")).alias("look"), "members", "texts")
