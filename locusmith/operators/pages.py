"""Pages to citable units: body regions, headings, markers, sequence, spans, addresses and the checks of each page family.

What concerns one page is read by an Arrow function that returns small marks; what spans pages is windows and one fold.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from locusmith.functions import text as T
from locusmith.operators.fold import ordered_fold
from locusmith.plans.store import written

# Patterns that tell the parts of the pages of each family.
BODY_DIV = re.compile(r'<div[^>]*class="[^"]*article-content[^"]*"[^>]*>', re.I)
DIV = re.compile(r"<(/?)div\b[^>]*>", re.I)
RULE = re.compile(r"<hr\b[^>]*>", re.I)
DEFINITION = re.compile(r'<a\b[^>]*\bname="J\d+"[^>]*>', re.I)
APPARATUS_WORD = "Jegyzetek"
MARKER_WRAP = r"(?:\s*<(?:font|span|em|i|b|strong)\b[^>]*>)*"
ANCHORED = re.compile(rf'<a\s+name="(K?\d+)"[^>]*>{MARKER_WRAP}\s*(\d{{1,4}})\s*\.{{0,2}}', re.I)
BARE = re.compile(r"(?:<p\b[^>]*>|<br\s*/?>\s*<br\s*/?>)\s*(\d{1,4})\s*\.{0,2}\s+", re.I)
BLOCK = re.compile(rf'<p\b[^>]*\bclass\s*=\s*"?MsoNormal"?[^>]*>{MARKER_WRAP}\s*(?=(\d{{1,4}})[\s<])', re.I)
INLINE = re.compile(r"(?:<br\s*/?>|[.!?][\")”]?)\s{1,3}(\d{1,4})(?=\s)")
PARAGRAPH = re.compile(r"<p\b([^>]*)>(.*?)</p>", re.I | re.S)
LABELS = {"hu": "Összefoglalás", "en": "IN BRIEF"}
BOLD_START = re.compile(r"\s*<(?:strong|b)\b", re.I)
CENTRED = re.compile(r'align\s*=\s*"?center"?', re.I)
LINK_ONLY = re.compile(r"\s*<a\b[^>]*>(?:(?!</a>).)*</a>\s*\Z", re.I | re.S)

MARK = StructType(
    [
        StructField("what", StringType()),  # marker, label, heading or empty
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("printed", IntegerType()),
        StructField("anchor", StringType()),
        StructField("inline", BooleanType()),
        StructField("kind", StringType()),
        StructField("sure", BooleanType()),
    ]
)
#: A mark with, of a marker, its own markup and what follows up to the next marker.
PIECE = StructType([*MARK.fields, StructField("own", StringType()), StructField("after", StringType())])
SCAN = StructType([StructField("region", StringType()), StructField("apparatus", StringType()), StructField("marks", ArrayType(PIECE))])


@dataclass(frozen=True)
class Family:
    """A page family: how its body is found, its footnotes look, and its paragraphs are marked."""

    name: str
    footnotes: str
    label: str
    anchor_signal: bool
    dense: bool = True


FAMILIES = {
    "anchored": Family("anchored", T.FOOTNOTE_NAMED, LABELS["hu"], True),
    "block": Family("block", T.FOOTNOTE_RAISED, LABELS["en"], False),
    "titled": Family("titled", T.FOOTNOTE_NONE, "", False, dense=False),
}


def family(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"unknown page family {name}; there are {', '.join(sorted(FAMILIES))}")
    return FAMILIES[name]


def family_of(page: Column) -> Column:
    """The family a page's own markup shows; null for none."""
    return F.when(page.rlike(r"(?i)<p\b[^>]*\btitle\s*="), "titled").when(page.rlike(r'(?i)<div[^>]*class="[^"]*article-content'), "anchored").when(page.rlike(r"(?i)<hr\b[^>]*\bnoshade\b"), "block")


def balanced_region(page: str) -> str | None:
    """What the article's div holds, by the running depth of div tags; null without such a div or where it never closes."""
    opened = BODY_DIV.search(page)
    if not opened:
        return None
    depth = 1
    for tag in DIV.finditer(page, opened.end()):
        depth += -1 if tag.group(1) else 1
        if not depth:
            return page[opened.end() : tag.start()]
    return None


def ruled_region(page: str) -> tuple[str, str] | None:
    """(body, apparatus) of a page whose parts horizontal rules divide; attributes in any order, case and quoting."""
    rules = [(m, dict(re.findall(r"([a-z]+)\s*=\s*\"?([^\s\">]+)", m.group().lower())), m.group().lower()) for m in RULE.finditer(page)]
    opened = next((m for m, a, raw in rules if "noshade" in raw and a.get("size") == "1"), None)
    if opened is None:
        return None
    later = [(m, a.get("width")) for m, a, _ in rules if m.start() >= opened.end()]
    for width in ("30%", "70%"):
        for m, w in later:
            if w == width:
                return page[opened.end() : m.start()], page[m.start() :] if width == "30%" else ""
    return page[opened.end() :], ""


def apparatus_start(region: str) -> int:
    """Where the notes begin: at their label if only markup parts it from the first definition, else at the paragraph around it, else at the definition."""
    first = DEFINITION.search(region)
    if not first:
        return len(region)
    at = region.lower().rfind(APPARATUS_WORD.lower(), 0, first.start())
    if at >= 0 and re.fullmatch(r"\s*:?\s*(?:<[^>]*>|\s)*", region[at + len(APPARATUS_WORD) : first.start()]):
        return at
    paragraph = region.rfind("<p", 0, first.start())
    return paragraph if paragraph >= 0 else first.start()


def visible(fragment: str, footnotes: str) -> str:
    """The normalised text of a fragment, for judging headings."""
    plain = re.sub(footnotes, "", fragment) if footnotes else fragment
    plain = re.sub(T.ANY_TAG, "", re.sub(T.BLOCK_TAG, " ", plain))
    return " ".join(unicodedata.normalize("NFC", entities.unescape(plain)).split())


def heading_kind(of: Family, attributes: str, fragment: str) -> str | None:
    """Why a paragraph is no prose: empty, nav, in-brief, bold, allcaps or centred, the first that holds; null for prose."""
    shown = visible(fragment, of.footnotes)
    if not shown:
        return "empty"
    if of.name == "anchored":
        if re.search(r'<a\s+name="K?\d+"', fragment, re.I):
            return None
        if LINK_ONLY.match(fragment):
            return "nav"
    elif re.match(rf"{MARKER_WRAP}\s*\d{{1,4}}[\s<]", fragment, re.I):
        return None
    if shown.casefold() == of.label.casefold():
        return "in-brief"
    if BOLD_START.match(fragment):
        return "bold"
    letters = [c for c in shown if c.isalpha()]
    if letters and all(c == c.upper() for c in letters):
        return "allcaps"
    return "centred" if of.name == "anchored" and CENTRED.search(attributes) else None


def scan(page: str | None, of: Family) -> tuple[str, str, list[tuple]] | None:
    """(region with headings blanked, apparatus, marks) of a page; null where it has no body."""
    if not page:
        return None
    if of.name == "anchored":
        region, apparatus = balanced_region(page), ""
        if region is None:
            return None
        cut = apparatus_start(region)
        region, apparatus = region[:cut], region[cut:]
    else:
        parts = ruled_region(page)
        if parts is None:
            return None
        region, apparatus = parts
    marks: list[tuple] = []
    pieces, at = [], 0
    for block in PARAGRAPH.finditer(region):
        if of.name == "block" and "msonormal" not in block.group(1).lower():
            continue
        kind = heading_kind(of, block.group(1), block.group(2))
        if kind is None:
            continue
        what = {"in-brief": "label", "empty": "empty"}.get(kind, "heading")
        marks.append((what, block.start(), block.end(), None, None, False, kind, None))
        pieces += [region[at : block.start()], " " * (block.end() - block.start())]
        at = block.end()
    region = "".join([*pieces, region[at:]])
    if of.name == "anchored":
        marks += [("label", m.start(), m.end(), None, None, False, "bare", None) for m in re.finditer(re.escape(of.label), region)]
    marks += [("marker", *m, None, m[3] is not None if of.name == "anchored" else not m[4]) for m in markers(region, of)]
    marks.sort(key=lambda m: (m[1], m[0]))
    return region, apparatus, with_pieces(region, marks)


def with_pieces(region: str, marks: list[tuple]) -> list[tuple]:
    """marks with the two pieces of the region that belong to each marker; all pieces together are the region from its first marker on."""
    starts = [m[1] for m in marks if m[0] == "marker"]
    ends = dict(zip(starts, [*starts[1:], len(region)], strict=False))
    return [(*m, region[m[1] : m[2]], region[m[2] : ends[m[1]]]) if m[0] == "marker" else (*m, None, None) for m in marks]


def markers(region: str, of: Family) -> list[tuple[int, int, int, str | None, bool]]:
    """(start, end, printed, anchor, inline) of the paragraph markers of a region; of two that overlap the surer kind stays."""
    found: list[tuple[int, int, int, str | None, bool]] = []

    def add(hits: Iterable[tuple[int, int, int, str | None, bool]]) -> None:
        surer = list(found)
        found.extend(h for h in hits if not any(s <= h[0] < e or h[0] <= s < h[1] for s, e, *_ in surer))

    if of.name == "anchored":
        add((m.start(), m.end(), int(m.group(2)), m.group(1), False) for m in ANCHORED.finditer(region))
        add((m.start(), m.end(), int(m.group(1)), None, False) for m in BARE.finditer(region))
    else:
        add((m.start(), m.end() + len(m.group(1)), int(m.group(1)), None, False) for m in BLOCK.finditer(region))
        add((m.start(1), m.end(1), int(m.group(1)), None, True) for m in INLINE.finditer(region))
    return sorted(found)


@F.pandas_udf(SCAN)
def _scan(pages: pd.Series, families: pd.Series) -> pd.DataFrame:
    rows = [scan(p, FAMILIES[f]) if f in FAMILIES and f != "titled" else None for p, f in zip(pages, families, strict=True)]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["region", "apparatus", "marks"])


def scanned(pages: DataFrame, html: str = "html", family_column: str = "family") -> DataFrame:
    """pages with region, apparatus and marks in place of their html; a page without a body has a null region."""
    return pages.withColumn("_scan", _scan(html, family_column)).select(*[c for c in pages.columns if c != html], "_scan.*")


def without_body(scans: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages whose body was not found, as defects: (key, kind, locator)."""
    return scans.where("region IS NULL").select(key, F.lit("count-mismatch").alias("kind"), F.concat(F.lit("page:"), F.col("page")).alias("locator"))


def skipped_headings(scans: DataFrame) -> DataFrame:
    """How many headings of each kind were left out of the text, by family."""
    marks = scans.select("family", F.explode("marks").alias("m")).where("m.what <> 'marker' AND m.kind <> 'bare'")
    return marks.groupBy("family", F.concat(F.lit("heading-"), F.col("m.kind")).alias("skipped")).agg(F.count(F.lit(1)).alias("headings"))


def marked(scans: DataFrame, key: list[str]) -> DataFrame:
    """One row per mark of a page, with what is in force at it: in_brief is true from a label to the next heading that is not empty."""
    rows = scans.select(*key, F.explode("marks").alias("m")).select(*key, "m.*").drop("own", "after")
    return in_force(rows, key)


def in_force(rows: DataFrame, key: list[str]) -> DataFrame:
    """Marks with in_brief: whether the last label or heading before them on their page is a label."""
    upto = Window.partitionBy(*key).orderBy("start", F.col("what") == "marker").rowsBetween(Window.unboundedPreceding, 0)
    force = F.last(F.when(F.col("what").isin("label", "heading"), F.col("what")), ignorenulls=True).over(upto)
    return rows.withColumn("in_brief", F.coalesce(force == "label", F.lit(False)))


def accepted_markers(marks: DataFrame, document: list[str], order: list[str]) -> DataFrame:
    """The markers of each document in order, with accepted: a sure one (anchored, or at the start of a paragraph of the
    block family) always, another only where it continues the greatest number accepted so far. The sequence runs across the
    pages of a document."""
    rows = marks.where("what = 'marker'").drop("what", "kind")

    def step(last: int, row) -> tuple[int, bool]:
        good = bool(row.sure) or row.printed == last + 1
        return (max(last, int(row.printed)) if good else last), good

    return ordered_fold(rows, document, order, lambda: 0, step, "accepted", "boolean")


def inline_markers(accepted: DataFrame) -> DataFrame:
    """Accepted markers in the middle of a paragraph, as defects: located by the sequence alone."""
    return accepted.where("accepted AND inline").withColumn("defect", F.lit("marker-inline"))


def spans(accepted: DataFrame, page: list[str]) -> DataFrame:
    """Accepted markers with the offset where their text ends on the page: at the next accepted marker; null for the page's last."""
    rows = accepted.where("accepted").drop("accepted")
    return rows.withColumn("until", F.lead("start").over(Window.partitionBy(*page).orderBy("start")))


def numbered_units(pages: DataFrame, document: list[str]) -> DataFrame:
    """Units of the numbered families: document columns, page, page_id, number, anchor, anchor_expected, role, text.

    pages: page_id, page, html, family and the document columns; the pages of a document are ordered by page and page_id, and copies of a page
    fall together. A page without a body or markers gives none. The scan cuts every page at its markers once; what is accepted
    is decided over the numbers alone, and a unit's text is put together from the pieces up to the next accepted marker.
    """
    key = [*document, "page", "page_id", "family"]
    scans = scanned(pages.select(*key, "html").where("family IN ('anchored', 'block')"))
    # read twice below, so kept: the scan is the one stage that runs in Python over whole pages
    marks = scans.select(*key, F.explode("marks").alias("m")).select(*key, "m.*").dropDuplicates(["page_id", "start", "what"])
    marks = written(marks, "page-marks")
    judged = accepted_markers(in_force(marks.drop("own", "after"), key), document, ["page", "page_id", "start"])
    run = F.count_if("accepted").over(Window.partitionBy("page_id").orderBy("start"))
    judged = judged.withColumn("_run", run).where("_run > 0").select("page_id", "start", "accepted", "in_brief", "_run")
    pieces = marks.where("what = 'marker'").join(judged, ["page_id", "start"])
    piece = F.struct("start", F.when(F.col("accepted"), F.col("after")).otherwise(F.concat("own", "after")).alias("text"))
    first = lambda c: F.max(F.when(F.col("accepted"), F.col(c)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["text"]), "")  # one unit: at most what its page holds
    units = pieces.groupBy(*key, "_run").agg(first("printed").alias("number"), first("anchor").alias("anchor"), first("in_brief").alias("in_brief"), joined.alias("_fragment"))
    # the family only decides what a footnote looks like; the Python steps of normalising then run once per fragment
    anchored = F.col("family") == "anchored"
    plain = F.when(anchored, T.without_footnotes(F.col("_fragment"), T.FOOTNOTE_NAMED)).otherwise(T.without_footnotes(F.col("_fragment"), T.FOOTNOTE_RAISED))
    return units.select(
        *document,
        "page",
        "page_id",
        "number",
        "anchor",
        F.when(anchored, T.anchor_of(F.col("number"))).alias("anchor_expected"),
        F.when(F.col("in_brief"), "summary").alias("role"),
        T.without_marker_residue(T.normalised(plain, T.FOOTNOTE_NONE)).alias("text"),
    )


TITLED = r'(?is)<p\b[^>]*\btitle\s*=\s*"([^"]*)"[^>]*>(.*?)</p>'
REF_SPAN = r'(?is)<span\b[^>]*\bclass\s*=\s*"?ref"?[^>]*>\s*\[(\d+)\]\s*([^<]*?)\s*</span>'


def titled_units(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Units of pages that title their paragraphs: keep columns, position, label, ref_number, ref_label, text."""
    zipped = F.arrays_zip(F.regexp_extract_all("html", F.lit(TITLED), F.lit(1)).alias("label"), F.regexp_extract_all("html", F.lit(TITLED), F.lit(2)).alias("inner"))
    rows = pages.where("family = 'titled'").select(*keep, F.posexplode(zipped).alias("position", "_u"))
    inner = F.col("_u.inner")
    return rows.select(
        *keep,
        "position",
        T.folded_locator(F.col("_u.label")).alias("label"),
        F.nullif(F.regexp_extract(inner, REF_SPAN, 1), F.lit("")).cast("long").alias("ref_number"),
        T.folded_locator(F.nullif(F.regexp_extract(inner, REF_SPAN, 2), F.lit(""))).alias("ref_label"),
        T.without_marker_residue(T.normalised(F.regexp_replace(inner, REF_SPAN, ""), T.FOOTNOTE_NONE)).alias("text"),
    )


# The grammar of printed addresses, ranks for sorting them, and the roles they name.
ADDRESS = r"^(I|I-II|II-II|III)\s+q\.\s*(\d+)(?:\s+a\.\s*(\d+))?\s*(?:(pr\.|co\.|ad arg\.)|(arg)\.\s*(\d+)|(ad)\s+(\d+)|(s\. ?c\.)(?:\s*(\d+))?)$"
PART_PREFACE = r"^(I|I-II|II-II|III)\s+pr\.$"
WORK_PREFACE = r"(?i)^Summa theologiae,?\s*pr\.$"
PART_RANK = {"I": 1, "I-II": 2, "II-II": 3, "III": 4}
ROLE_RANK = {"pr": 0, "arg": 1, "sc": 2, "co": 3, "ad": 4, "adarg": 4}
ROLE_NAMES = {"pr": "prooemium", "arg": "objection", "sc": "sed_contra", "co": "respondeo", "ad": "reply", "adarg": "reply"}
SHORT_ROLES = {"pr.": "pr", "co.": "co", "ad arg.": "adarg", "arg": "arg", "ad": "ad", "s. c.": "sc", "s.c.": "sc"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def address(label: Column) -> Column:
    """part, question, article, role and number of a printed address; null for any other spelling."""

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(label, ADDRESS, i), F.lit(""))

    role = literal_map(SHORT_ROLES)[F.coalesce(group(4), group(5), group(7), group(9))]
    index = F.coalesce(group(6), group(8), group(10), F.lit("0")).cast("int")

    def of(part: Column, question: Column, article: Column, role: Column, index: Column) -> Column:
        return F.struct(part.alias("part"), question.cast("int").alias("question"), article.cast("int").alias("article"), role.alias("role"), index.alias("index"))

    none = F.lit(None)
    return (
        F.when(label.rlike(WORK_PREFACE), of(none.cast("string"), none, none, F.lit("pr"), F.lit(0)))
        .when(label.rlike(PART_PREFACE), of(F.regexp_extract(label, PART_PREFACE, 1), none, none, F.lit("pr"), F.lit(0)))
        .when(label.rlike(ADDRESS), of(group(1), group(2), group(3), role, index))
    )


def address_locator(a: Column, work: str = "summa") -> Column:
    """work:part.qN.aN.role; a role that is counted carries its number where it has one."""
    role = F.when(a["role"].isin("arg", "ad", "sc") & (a["index"] > 0), F.concat(a["role"], a["index"].cast("string"))).otherwise(a["role"])
    return F.when(a.isNotNull(), F.concat(F.lit(f"{work}:"), F.concat_ws(".", a["part"], F.concat(F.lit("q"), a["question"]), F.concat(F.lit("a"), a["article"]), role)))


def address_role(a: Column) -> Column:
    """The role an address names, as units store it."""
    return literal_map(ROLE_NAMES)[a["role"]]


def address_sequence(a: Column) -> Column:
    """The place of an address in the work, as an array that sorts: part, question, article, role, number."""
    rank = F.coalesce(literal_map(PART_RANK)[a["part"]], F.lit(0))
    return F.when(a.isNotNull(), F.array(rank, F.coalesce(a["question"], F.lit(0)), F.coalesce(a["article"], F.lit(0)), literal_map(ROLE_RANK)[a["role"]], a["index"]))


def headings_in_force(rows: DataFrame, page: list[str], at: str = "at", kind: str = "kind", number: str = "number") -> DataFrame:
    """Rows with the question and article headings in force at their offset: columns quaestio and articulus.

    Headings are rows with a kind: B (part), D (question), E (article) or G (preface); other rows have none. A part ends both, a question
    its article, a preface the article. A heading at a row's own offset is in force.
    """
    upto = Window.partitionBy(*page).orderBy(at, F.col(kind).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.struct(F.col(kind).alias("k"), F.col(number).alias("n"))
    outer = F.last(F.when(F.col(kind).isin("B", "D"), latest), ignorenulls=True).over(upto)
    inner = F.last(F.when(F.col(kind).isNotNull(), latest), ignorenulls=True).over(upto)
    rows = rows.withColumns({"_outer": outer, "_inner": inner})
    return rows.withColumns({"quaestio": F.when(F.col("_outer.k") == "D", F.col("_outer.n")), "articulus": F.when(F.col("_inner.k") == "E", F.col("_inner.n"))}).drop("_outer", "_inner")


def label_disagreements(units: DataFrame) -> DataFrame:
    """Units whose own label, apparatus label and headings in force do not agree, null-aware: columns label, ref_label, question, article, quaestio, articulus."""
    apart = (F.col("ref_label").isNotNull() & ~F.col("label").eqNullSafe(F.col("ref_label"))) | ~F.col("question").eqNullSafe(F.col("quaestio")) | ~F.col("article").eqNullSafe(F.col("articulus"))
    return units.where(apart).withColumn("defect", F.lit("label-disagreement"))


OPTION = r"""(?i)value\s*=\s*"?#(\d+)"?\s*>([^']*)'"""


def enumeration_defects(pages: DataFrame, units: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, kind, listed, present, missing, extra): pages whose own list of units is absent or differs from the units in them.

    Lists are compared in order; missing and extra count with repetition, so a label listed twice and absent is missing twice.
    """
    listed = pages.select(key, F.transform(F.regexp_extract_all("html", F.lit(OPTION), F.lit(2)), lambda x: T.contents_spelling(T.folded_locator(x))).alias("toc"))
    rows = units.select(key, F.struct("position", T.contents_spelling(F.col("label")).alias("label")).alias("_u"))
    body = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("_u")), lambda u: u["label"]).alias("body"))
    both = listed.join(body, key, "left").withColumn("body", F.coalesce("body", F.array().cast("array<string>")))
    missing = F.size(F.filter("toc", lambda x: ~F.array_contains(F.col("body"), x)))
    extra = F.size(F.filter("body", lambda x: ~F.array_contains(F.col("toc"), x)))
    kind = F.when(F.size("toc") == 0, "enumeration-absent").when(F.col("toc") != F.col("body"), "enumeration-mismatch")
    return both.select(key, kind.alias("kind"), F.size("toc").alias("listed"), F.size("body").alias("present"), missing.alias("missing"), extra.alias("extra")).where("kind IS NOT NULL")


# Latin numerals of prefaces.
NUMERALS = {"unum": 1, "duo": 2, "tria": 3, "quattuor": 4, "quatuor": 4, "quinque": 5, "sex": 6, "septem": 7, "octo": 8, "novem": 9, "decem": 10, "undecim": 11, "duodecim": 12, "tredecim": 13, "quattuordecim": 14, "quatuordecim": 14, "quindecim": 15, "sedecim": 16, "sexdecim": 16, "septendecim": 17, "duodeviginti": 18, "octodecim": 18, "undeviginti": 19, "novendecim": 19, "viginti": 20}


def stated_count(preface: Column) -> Column:
    """The number of articles a preface announces after 'quaeruntur', also as a sum (decem et septem); null if it announces none."""
    any_numeral = "|".join(sorted(NUMERALS, key=len, reverse=True))
    pattern = rf"(?i)\bquaeruntur\s+(?:({any_numeral})\s+et\s+({any_numeral})|({any_numeral}))\b"
    value = [literal_map(NUMERALS)[F.lower(F.nullif(F.regexp_extract(preface, pattern, i), F.lit("")))] for i in (1, 2, 3)]
    return F.coalesce(value[2], value[0] + value[1])


def article_shapes(units: DataFrame, work: list[str]) -> DataFrame:
    """Articles whose parts do not fit: (work..., article, kind). units: locator, role and the work columns.

    More replies than objections and contrary statements together; no main answer; objections not numbered 1 to n, each once.
    """
    tail = F.regexp_extract("locator", r"\.([^.]*)$", 1)
    rows = units.select(*work, T.article_of(F.col("locator")).alias("article"), F.regexp_extract(tail, "^([a-z]+)", 1).alias("r"), F.nullif(F.regexp_extract(tail, r"(\d+)$", 1), F.lit("")).cast("int").alias("n")).where("r IN ('arg', 'sc', 'co', 'ad')")
    per = rows.groupBy(*work, "article").agg(
        F.count_if(F.col("r") == "ad").alias("ad"),
        F.count_if(F.col("r").isin("arg", "sc")).alias("raised"),
        F.count_if(F.col("r") == "co").alias("co"),
        F.count_if(F.col("r") == "arg").alias("arg"),
        F.count_distinct(F.when(F.col("r") == "arg", F.col("n"))).alias("numbers"),
        F.max(F.when(F.col("r") == "arg", F.col("n"))).alias("last"),
        F.min(F.when(F.col("r") == "arg", F.col("n"))).alias("first"),
    )
    gap = (F.col("arg") > 0) & ~((F.col("numbers") == F.col("arg")) & (F.col("first") == 1) & (F.col("last") == F.col("arg")))
    kinds = F.array_compact(F.array(F.when(F.col("ad") > F.col("raised"), "more-replies"), F.when(F.col("co") == 0, "answer-absent"), F.when(F.coalesce(gap, F.lit(True)), "objections-not-contiguous")))
    return per.select(*work, "article", F.explode(kinds).alias("kind"))


def article_counts(units: DataFrame, work: list[str]) -> DataFrame:
    """Per question: the number its preface states and the number of its articles; verdict equal, differs or unstated. units: locator, text."""
    question = F.regexp_extract("locator", r"^(.*\.q\d+)(?:\.|$)", 1)
    rows = units.select(*work, F.nullif(question, F.lit("")).alias("question"), F.nullif(F.regexp_extract("locator", r"\.(a\d+)\.", 1), F.lit("")).alias("article"), F.when(F.col("locator").rlike(r"\.q\d+\.pr$"), stated_count(F.col("text"))).alias("stated")).where("question IS NOT NULL")
    per = rows.groupBy(*work, "question").agg(F.max("stated").alias("stated"), F.count_distinct("article").alias("articles"))
    return per.withColumn("verdict", F.when(F.col("stated").isNull(), "unstated").when(F.col("stated") == F.col("articles"), "equal").otherwise("differs"))


REFERENCED = r'(?i)<a\b[^>]*\bname\s*=\s*"?-([0-9A-Za-z]+)"?[^>]*>'
DEFINED = r'(?i)<a\b[^>]*\bname\s*=\s*"?\$([0-9A-Za-z]+)"?[^>]*>'


def footnote_balance(scans: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages whose footnote references and definitions differ as sets: (key, referenced, defined, undefined, unreferenced) with four samples each."""
    sets = scans.where("family = 'block' AND region IS NOT NULL").select(key, F.array_distinct(F.regexp_extract_all("region", F.lit(REFERENCED), F.lit(1))).alias("r"), F.array_distinct(F.regexp_extract_all("apparatus", F.lit(DEFINED), F.lit(1))).alias("d"))
    sets = sets.withColumns({"u": F.array_except("r", "d"), "v": F.array_except("d", "r")}).where("size(u) > 0 OR size(v) > 0")
    return sets.select(key, F.size("r").alias("referenced"), F.size("d").alias("defined"), F.array_join(F.slice("u", 1, 4), ", ").alias("undefined"), F.array_join(F.slice("v", 1, 4), ", ").alias("unreferenced"))


def unnumbered_pages(pages: DataFrame, units: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key).distinct().join(units.select(key), key, "left_anti")

