"""Text that was decoded with the wrong character encoding: finding it and restoring what was written.

A run is a stretch of non-ASCII characters (or character references) with one neighbour on either side. Candidate runs
and the figures that judge them are gathered in one scan of the pages; every distinct run is then searched once.
"""

from __future__ import annotations

import bisect
import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmith.plans.store import spread, written

#: Encodings in which bytes may have been read.
READ_AS = ("latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "cp1253", "cp1254", "cp1257", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac-roman", "mac-latin2")
#: Multi-byte encodings in which bytes may have been read.
READ_AS_WIDE = ("gbk", "big5", "shift-jis", "euc-kr")
#: (read in, written in): single-byte encodings that differ in some letters only.
SISTERS = (("cp1252", "cp1250"), ("latin-1", "iso8859-2"), ("latin-1", "cp1250"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("iso8859-2", "cp1252"), ("cp1252", "iso8859-2"), ("cp1250", "iso8859-2"), ("cp1254", "cp1250"), ("cp1257", "cp1250"))
#: Letters beyond ASCII of the languages of the corpus; other letters of a page are looked at more closely.
ALPHABET = {"hu": "áéíóöőúüű", "la": "æœāēīōūë", "en": "éèïöôàêçâæœ"}

STEP = 1.5  # bits a search step costs
EVIDENCE = "kind string, page_id bigint, a string, b string, c string, n bigint"
#: References to anything but the characters of markup itself.
REFERENCE = r"&(?!(?:lt|gt|quot|apos|LT|GT|QUOT);|amp;(?![#A-Za-z])|AMP;)(?:amp;)*(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);?"
ALONE = re.compile(r"[\x80-\x9f\ufffd\u2e80-\u9fff\uac00-\ud7a3]")
#: A run: characters beyond ASCII and references side by side, or one that is a C1 character, lost or of a wide script, in any notation (alone tells for a number). Finding and restoring both go by it.
RUN = re.compile(rf"(?:[\x80-\U0010ffff]|{REFERENCE}){{2,}}|{ALONE.pattern}|&(?:amp;)*#(?P<number>[0-9]{{3,}}|[xX][0-9a-fA-F]{{2,}});?")
LOST = re.compile(r"\ufffd|&(?:amp;)*#(?:0*65533(?![0-9])|[xX]0*[fF]{3}[dD](?![0-9a-fA-F]))")
C1_REFERENCE = re.compile(r"&#(?:0*(1(?:2[89]|[345][0-9]))(?![0-9])|[xX]0*([89][0-9a-fA-F])(?![0-9a-fA-F]));?")


def letter(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "L"


@cache
def to_bytes(codec: str) -> dict[str, int]:
    """The byte of each character; bytes the encoding leaves undefined are read as the control character of that number."""
    table = {chr(b): b for b in range(128, 160)} if codec.startswith(("cp125", "latin", "iso")) else {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


@cache
def utf8_shape(codec: str) -> re.Pattern[str]:
    """Matches the characters that a UTF-8 sequence of two to four bytes becomes in the encoding."""

    def of(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in to_bytes(codec).items() if low <= b <= high) + "]"

    tail = of(0x80, 0xBF)
    return re.compile(f"{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}}")


@cache
def sister_letters() -> dict[str, str]:
    """For each letter, the letters it may stand for when one single-byte encoding was read as another."""
    out: dict[str, set[str]] = {}
    for read, meant in SISTERS:
        for ch, b in to_bytes(read).items():
            try:
                other = bytes([b]).decode(meant)
            except UnicodeDecodeError:
                continue
            if other != ch and letter(ch) and letter(other):
                out.setdefault(ch, set()).add(other)
    return {ch: "".join(sorted(others)) for ch, others in out.items()}


def decoded(codec: str, text: str) -> str:
    """text with every stretch that is UTF-8 read in codec put right; the rest stays."""

    def right(m: re.Match[str]) -> str:
        try:
            ch = bytes(map(to_bytes(codec).__getitem__, m.group())).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        return m.group() if unicodedata.category(ch) in ("Cn", "Co", "Cs") else ch  # no such character was written

    return utf8_shape(codec).sub(right, text)


def wide_decoded(codec: str, text: str) -> str:
    """text read as UTF-8 after encoding in a multi-byte encoding; unchanged where that fails."""
    body = text.rstrip("�")
    try:
        raw = body.encode(codec)
        return raw.decode("utf-8") + text[len(body) :] if len(raw) > len(body) else text
    except UnicodeError:
        return text


def alone(number: str) -> bool:
    """Whether the character of a numeric reference proposes a run by itself."""
    hexadecimal = number[0] in "xX"
    digits = number[hexadecimal:].lstrip("0")
    code = int(digits or "0", 16 if hexadecimal else 10) if len(digits) <= 7 else 0x110000
    return code < 0x110000 and ALONE.match(chr(code)) is not None


def runs_of(text: str) -> Iterator[tuple[int, int, tuple[str, str, str]]]:
    """(start, end, (run, character before, character after)) of the runs of a page."""
    for m in RUN.finditer(text):
        if m.group("number") is None or alone(m.group("number")):
            yield m.start(), m.end(), (m.group(), text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1])


def unescaped(text: str) -> str:
    """text with its references resolved once. A reference to a C1 character is that character, not the one that browsers show for it."""
    return html.unescape(C1_REFERENCE.sub(lambda m: chr(int(m.group(1)) if m.group(1) else int(m.group(2), 16)), text))


def plain(text: str) -> str:
    """text with character references resolved, as often as they were applied; for judging only."""
    while "&" in text and (more := unescaped(text)) != text:
        text = more
    return text


def moves(text: str) -> Iterator[tuple[str, bool]]:
    """(next text, whether a decoding was undone) for every operation that changes text."""
    if "&" in text and (more := unescaped(text)) != text:
        yield more, False
    for codec in READ_AS:
        if (more := decoded(codec, text)) != text:
            yield more, True
    if any("⺀" <= c <= "힣" for c in text):
        for codec in READ_AS_WIDE:
            if (more := wide_decoded(codec, text)) != text:
                yield more, True
    if any("\x80" <= c <= "\x9f" for c in text):
        more = "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c if "\x80" <= c <= "\x9f" else c for c in text)
        if more != text:
            yield more, True


#: Code points of the scripts and signs that texts are usually made of; others are a surprise of their own.
USUAL = ((0x20, 0x7E), (0xA0, 0x17F), (0x218, 0x21B), (0x370, 0x45F), (0x1E00, 0x1FFF), (0x2010, 0x2044), (0x2070, 0x209C), (0x20AC, 0x20AC), (0x2100, 0x22FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF))


@cache
def unusual(ch: str) -> bool:
    return not any(low <= ord(ch) <= high for low, high in USUAL)


OPENING, CLOSING = "“„‘«‹¿¡", "”’»›"


def implausibility(text: str, left: str, right: str, bits: Callable[[str], float]) -> float:
    """Bits of surprise of a text between its neighbours: rare characters, and characters in places where writers do not put them."""
    total, before = 0.0, left
    for i, ch in enumerate(text):
        after = text[i + 1] if i + 1 < len(text) else right
        kind = unicodedata.category(ch)
        total += 1.0 if ch == "﻿" else bits(ch) + 8 * unusual(ch)
        if kind in ("Cc", "Cn", "Co", "Cs", "Cf") and ch != "﻿" or ch == "�":
            total += 6
        beside = letter(before) if before else False
        ahead = letter(after) if after else False
        if kind[0] in "SN" or kind in ("Po", "Zs", "Lm", "Mn", "Sk"):
            total += 4 * (beside or kind[0] == "S" and ahead and ch not in "§¶†‡©")
        elif kind == "Pd" or ch in "–—":
            total += 4 * (beside and ahead)
        elif ch in OPENING:
            total += 5 * beside
        elif ch in CLOSING and ch != "’":
            total += 5 * (beside and ahead)
        elif kind == "Lu" and before and before.islower():
            total += 3
        before = ch
    return total


def best_first(start: str, moves: Callable[[str], Iterable[tuple[str, bool]]], cost: Callable[[str], float], step: float, stands: float) -> tuple[str, bool]:
    """Best-first search from a text over operations to the cheapest reachable one: (text, whether a wrong decoding lies on the way to it).

    States are texts, kept in a set of those seen; the queue goes by cost and step for every decoding undone. A text reached must beat
    stands, the cost of the start as it is. Every operation shortens a text or moves it out of the characters that it applies to, so the
    states come to an end; none is left out.
    """
    queue, seen, serial = [(stands, 0, start, 0)], {start}, 0
    best_cost, best_text, best_undone = stands, start, False
    while queue:
        _, _, text, undone = heapq.heappop(queue)
        for more, wrong in moves(text):
            if more in seen:
                continue
            seen.add(more)
            steps = undone + wrong
            total = cost(more) + step * steps
            if total < best_cost and steps:
                best_cost, best_text, best_undone = total, more, True
            serial += 1
            heapq.heappush(queue, (total, serial, more, steps))
    return best_text, best_undone


def search(run: str, left: str, right: str, bits: Callable[[str], float]) -> tuple[str, bool]:
    """best_first from a run between its neighbours over decoding and unescaping; the run itself is judged with its references resolved."""
    cost = lambda text: implausibility(plain(text), left, right, bits)
    return best_first(run, moves, cost, STEP, cost(run))


def sister_moves(text: str) -> Iterator[tuple[str, bool]]:
    """The letters that a letter is when the byte it was read from is read in another single-byte encoding."""
    for read, meant in SISTERS:
        byte = to_bytes(read).get(text)
        if byte is not None:
            other = bytes([byte]).decode(meant, "ignore")
            if other and other != text and letter(other):
                yield other, True


def search_letter(ch: str, counts: Mapping[str, int]) -> tuple[str, bool]:
    """best_first from an odd letter over sister encodings, one of them for a text. The cost is the surprise of a letter between its neighbours, by the pages that have it there."""
    cost = lambda text: -math.log2(counts.get(text, 0) + 0.5)
    return best_first(ch, lambda text: sister_moves(text) if text == ch else (), cost, 0.0, cost(ch))


@lru_cache(100_000)
def worth_searching(run: str) -> bool:
    """Whether any operation but unescaping could apply, or characters are already lost."""
    text = plain(run)
    return "�" in text or any(wrong for _, wrong in moves(text))


def language_key(language: str | None) -> str:
    key = (language or "").strip().lower()[:2]
    return key if key in ALPHABET else ""


def home_letters(language: str | None) -> frozenset[str]:
    alphabet = ALPHABET.get(language_key(language)) or "".join(ALPHABET.values())
    return frozenset(alphabet + alphabet.upper())


def gather(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One scan: per page the candidate runs (r) and odd letters (w) with neighbours; per batch, pages by character (c) and by letter with neighbours (t)."""
    watched = "".join(sorted({*sister_letters(), *"".join(sister_letters().values())}))
    around = re.compile(rf"(?s)(?<=(.{{2}}))([{watched}])(?=(.{{2}}))")
    cut = re.compile(r"[^\w]")
    odd = {key: re.compile("[" + "".join(sorted(set(watched) - home_letters(key))) + "]") for key in (*ALPHABET, "")}
    for batch in batches:
        rows: list[tuple] = []
        chars: Counter[str] = Counter()
        windows: Counter[tuple[str, str, str]] = Counter()
        pages = 0
        for page_id, text, language in zip(batch.page_id, batch.html, batch.language, strict=True):
            if not text:
                continue
            pages += 1
            if text.isascii() and "&" not in text:
                continue
            chars.update(set(text))
            found, spans = set(), []
            for start, end, run in runs_of(text):
                if worth_searching(run[0]):
                    found.add(run)
                    spans.append((start, end))
            rows += [("r", page_id, *x, 1) for x in found]
            here = {(cut.sub(" ", a), ch, cut.sub(" ", b)) for a, ch, b in around.findall(text)}
            windows.update(here)
            strange = set()
            for hit in odd[language_key(language)].finditer(text):
                at = hit.start()
                k = bisect.bisect_right(spans, (at, len(text))) - 1
                if 2 <= at < len(text) - 2 and (k < 0 or at >= spans[k][1]):
                    strange.add((cut.sub(" ", text[at - 2 : at]), text[at], cut.sub(" ", text[at + 1 : at + 3])))
            rows += [("w", page_id, *x, 1) for x in strange]
        rows += [("c", None, ch, None, None, n) for ch, n in chars.items() if ch > "\x7f"]
        rows += [("t", None, *x, n) for x, n in windows.items()]
        rows.append(("p", None, None, None, None, pages))
        frame = pd.DataFrame(rows, columns=["kind", "page_id", "a", "b", "c", "n"])
        yield frame.assign(page_id=pd.array([r[1] for r in rows], dtype="Int64"))


def evidence(pages: DataFrame) -> DataFrame:
    """gather over distinct pages (page_id, html, language), kept as a table: far smaller than the pages, read several times."""
    return written(spread(pages.select("page_id", "html", "language")).mapInPandas(gather, EVIDENCE), "encoding-evidence")


def judged_runs(facts: DataFrame) -> DataFrame:
    """(a, b, c, fixed, damaged, lost) for every distinct run and its neighbours.

    The table of characters goes to the workers; it has one row per character, so Unicode bounds it at 1.1 million.
    """
    counts = {r["a"]: r["n"] for r in facts.where("kind = 'c'").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    pages = facts.where("kind = 'p'").agg(F.sum("n")).first()[0] or 0
    unseen = math.log2(2 * pages + 2)
    shared = facts.sparkSession.sparkContext.broadcast(counts)

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value

        def bits(ch: str) -> float:
            return 0.0 if ch < "\x80" else min(unseen, -math.log2((known.get(ch, 0) + 0.5) / (pages + 1)))

        for batch in batches:
            out = []
            for run, left, right in zip(batch.a, batch.b, batch.c, strict=True):
                fixed, damaged = search(run, left, right, bits)
                lost = LOST.search(fixed) is not None
                out.append((run, left, right, fixed, damaged or lost, lost))
            yield pd.DataFrame(out, columns=["a", "b", "c", "fixed", "damaged", "lost"])

    return facts.where("kind = 'r'").select("a", "b", "c").distinct().mapInPandas(judge, "a string, b string, c string, fixed string, damaged boolean, lost boolean")


def judged_letters(facts: DataFrame) -> DataFrame:
    """(a, b, c, fixed) for odd letters that the search takes for another letter of a sister encoding, by the pages that have either between the same neighbours."""
    by_window = facts.where("kind = 't'").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    readings = F.create_map(*[F.lit(x) for pair in sister_letters().items() for x in pair])
    odd = facts.where("kind = 'w'").select("a", "b", "c").distinct()
    asked = odd.withColumn("state", F.explode(F.split(F.concat("b", readings[F.col("b")]), ""))).where("state <> ''")
    counted = asked.join(by_window.withColumnRenamed("b", "state"), ["a", "state", "c"])
    states = counted.groupBy("a", "b", "c").agg(F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("counts"))  # a letter and its few readings

    @F.pandas_udf("string")
    def judge(letters: pd.Series, counts: pd.Series) -> pd.Series:
        found = [search_letter(ch, dict(known)) for ch, known in zip(letters, counts, strict=True)]
        return pd.Series([fixed if undone else None for fixed, undone in found], dtype="object")

    return states.where(F.size("counts") > 1).select("a", "b", "c", judge("b", "counts").alias("fixed")).where("fixed IS NOT NULL")


def damage(pages: DataFrame) -> DataFrame:
    """(page_id, at, written, lost): the damaged spots of pages (page_id, html, language) and what stood there.

    A spot is the run with the character before and after it. lost: characters are gone for good (U+FFFD).
    Null and empty pages have none. Repeated rows count as often as they occur, which moves no decision but a tie.
    Other columns are not read.
    """
    facts = evidence(pages)
    runs = facts.where("kind = 'r'").select("page_id", "a", "b", "c").join(judged_runs(facts).where("damaged"), ["a", "b", "c"])
    runs = runs.select("page_id", F.lit("run").alias("spot"), F.col("b").alias("left"), F.col("a").alias("at"), F.col("c").alias("right"), F.col("fixed").alias("written"), "lost")
    letters = facts.where("kind = 'w'").select("page_id", "a", "b", "c").join(judged_letters(facts), ["a", "b", "c"])
    letters = letters.select("page_id", F.lit("letter").alias("spot"), F.col("a").alias("left"), F.col("b").alias("at"), F.col("c").alias("right"), F.col("fixed").alias("written"), F.lit(False).alias("lost"))
    return runs.unionByName(letters)


def restore(text: str, spots: Iterable[tuple[str, str, str, str, str]]) -> str:
    """text with the runs and letters of its spots replaced: the same runs that were found, each between its neighbours."""
    spots = list(spots)
    fixed = {(at, left, right): written for spot, left, at, right, written in spots if spot == "run"}
    if fixed:
        out, done = [], 0
        for start, end, run in runs_of(text):
            if run in fixed:
                out += [text[done:start], fixed[run]]
                done = end
        text = "".join([*out, text[done:]])
    for spot, left, at, right, written in spots:
        if spot == "letter":
            near = [re.escape(x).replace(r"\ ", r"\W") for x in (left, right)]
            text = re.sub(f"(?<={near[0]}){at}(?={near[1]})", lambda _, to=written: to, text)
    return text


def repaired_pages(pages: DataFrame, spots: DataFrame) -> DataFrame:
    """(page_id, html, lost) of the damaged pages, restored where that is possible. Copies of a page fall together, differing rows of a page_id stay."""
    per_page = spots.groupBy("page_id").agg(F.collect_set(F.struct("spot", "left", "at", "right", "written")).alias("spots"), F.max("lost").alias("lost"))

    @F.pandas_udf("string")
    def fix(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([restore(t, [(x["spot"], x["left"], x["at"], x["right"], x["written"]) for x in spots]) for t, spots in zip(texts, lists, strict=True)])

    joined = pages.select("page_id", "html").join(per_page, "page_id").withColumn("_copy", F.md5("html")).dropDuplicates(["page_id", "_copy"])
    return joined.select("page_id", fix("html", "spots").alias("html"), "lost")
