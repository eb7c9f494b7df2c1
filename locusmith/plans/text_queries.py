"""Queries of the text, link and page operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmith.functions import hashing
from locusmith.functions import text as T
from locusmith.operators import chunking, links, pages
from locusmith.plans.store import table
from locusmith.sources import files


def quoted(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def page_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Pages with their copies; what is made of them is narrower than they are, and there the copies fall."""
    return table(spark, sf_dir, "source_pages", ["page_id", *columns])


def once(rows: DataFrame, key: str = "page_id") -> DataFrame:
    return rows.dropDuplicates([key])


def unit_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "stored_units", ["unit_id", *columns]).dropDuplicates(["unit_id"])


def context_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "context_units", ["context_id", *columns]).dropDuplicates(["context_id"])


PAGES = "(SELECT DISTINCT page_id, source_id, language, page, html, url FROM source_pages)"
UNITS = "(SELECT DISTINCT unit_id, document_id, locator, language, text, ordinal, role, ingested_at, deleted_at FROM stored_units)"
CONTEXT = "(SELECT DISTINCT context_id, answer_id, locator, language, text, source_id, edition, url FROM context_units)"
# The SQL states its patterns for itself, so that a wrong one of the operators shows.
RAISED_SQL = """'(?is)<sup\\b[^>]*>\\s*<a\\b[^>]*\\bname\\s*=\\s*"?-[0-9A-Za-z]+"?[^>]*>.*?</a>\\s*</sup>'"""
BLOCK_SQL = "'(?i)<(?:/)?(?:blockquote|br|dd|div|dl|dt|h[1-6]|hr|li|ol|p|pre|table|td|th|tr|ul)(?:[^A-Za-z0-9_>][^>]*)?>'"
TITLED_SQL = """'(?is)<p\\b[^>]*\\btitle\\s*=\\s*"([^"]*)"[^>]*>(.*?)</p>'"""
SPAN_SQL = """'(?is)<span\\b[^>]*\\bclass\\s*=\\s*"?ref"?[^>]*>\\s*\\[([0-9]+)\\]\\s*([^<]*?)\\s*</span>'"""


def named_sql(text: str) -> str:
    for name, meant in (("nbsp", "chr(32)"), ("quot", "chr(34)"), ("ldquo", "chr(8220)"), ("lt", "chr(60)"), ("gt", "chr(62)")):
        text = f"regexp_replace({text}, '(?i)&{name};', {meant}, 'g')"
    return text


def numeric_sql(text: str, source: str) -> str:
    """A subquery of source with its column text where decimal, then hexadecimal references are the characters they name."""
    for pattern, value in (("&#[0-9]+;", "rtrim(substr({}, 3), ';')"), ("&#[xX][0-9a-fA-F]+;", "'0x' || rtrim(substr({}, 4), ';')")):
        number = f"TRY_CAST({value.format('refs[i]')} AS BIGINT)"
        one = f"CASE WHEN i > len(refs) THEN '' WHEN {number} BETWEEN 0 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INT)) ELSE refs[i] END"
        source = f"(SELECT * EXCLUDE (parts, refs) REPLACE (array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || {one}), '') AS {text}) FROM (SELECT *, string_split_regex({text}, '{pattern}') AS parts, regexp_extract_all({text}, '{pattern}') AS refs FROM {source}))"
    return source


def nrm1_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return once(page_table(spark, sf_dir, "html").select("page_id", F.size(F.regexp_extract_all(html, F.lit(T.FOOTNOTE_RAISED), F.lit(0))).cast("bigint").alias("references"), F.md5(T.without_footnotes(html, T.FOOTNOTE_RAISED)).alias("rest")))


def nrm2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(page_table(spark, sf_dir, "html").select("page_id", F.md5(T.blocks_to_spaces(F.col("html"))).alias("text")))


def nrm3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(page_table(spark, sf_dir, "html").select("page_id", F.md5(T.without_tags(T.blocks_to_spaces(F.col("html")))).alias("text")))


def nrm4_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(page_table(spark, sf_dir, "html").select("page_id", F.md5(F.regexp_replace(T.named_references(F.col("html")), "(?i)&amp;", "&")).alias("text")))


def nrm4_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_table(spark, sf_dir, "text").select("context_id", T.decoded_references(F.col("text")).alias("text"))


def nrm5_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_table(spark, sf_dir, "text").select("unit_id", T.nfc(F.col("text")).alias("text"))


def nrm6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_table(spark, sf_dir, "text").select("unit_id", T.collapsed(F.col("text")).alias("text"))


def nrm7_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_table(spark, sf_dir, "text").select("context_id", T.normalised(F.col("text"), T.FOOTNOTE_RAISED).alias("text"))


def nrm8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_table(spark, sf_dir, "text", "ordinal").select("unit_id", T.without_marker_residue(F.concat(F.lit(" . "), "text")).alias("text"))


LABEL_IN = "concat(replace(locator, ':', '&ordf; IIae, '), ',  ad arg.')"


def nrm9_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.replace("locator", F.lit(":"), F.lit("&ordf; IIae, ")), F.lit(",  ad arg."))
    return unit_table(spark, sf_dir, "locator").select("unit_id", T.folded_locator(label).alias("label"), T.contents_spelling(T.folded_locator(label)).alias("listed"))


def nrm11_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ["doc_id", "title"]).select("doc_id", T.slug(F.col("title")).alias("slug"))


def hsh2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(page_table(spark, sf_dir, "html").select("page_id", hashing.page_hash(F.col("html")).alias("hash")))


def _discovered(how: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return links.page_links(page_table(spark, sf_dir, "html"), links.discovery(how)).withColumn("position", F.col("position").cast("bigint"))

    return query


def dsc4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(page_table(spark, sf_dir, "html", "url"), links.discovery("any-path"), base="url").select("page_id", "slug", "url")


#: The link shapes, stated again for the SQL: (pattern, ordered by slug).
LINK_SQL = {
    "quoted-path": ("""'(?i)<a\\b[^>]*\\bhref\\s*=\\s*"(/[^"#?]*?([^"#/?]+))(?:[#?][^"]*)?"'""", False),
    "any-path": ("""'(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']?(/[^"''\\s>#?]*?([^"''\\s>#?/]+))["''#?\\s>]'""", False),
    "any-path-sorted": ("""'(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']?(/[^"''\\s>#?]*?([^"''\\s>#?/]+))["''#?\\s>]'""", True),
}


def _links_sql(how: str) -> str:
    pattern, by_slug = LINK_SQL[how]
    order = "slug" if by_slug else "pos"
    return f"""WITH found AS (
      SELECT page_id, unnest(regexp_extract_all(html, {pattern}, 1)) AS link, unnest(regexp_extract_all(html, {pattern}, 2)) AS slug,
        generate_subscripts(regexp_extract_all(html, {pattern}, 1), 1) AS pos FROM {PAGES})
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS BIGINT) AS position, slug, link
      FROM (SELECT page_id, slug, min(pos) AS pos, arg_min(link, pos) AS link FROM found GROUP BY page_id, slug)"""


def _contents(spark: SparkSession, sf_dir: str, link) -> DataFrame:
    """One contents page per source, in the link shape of a family: its pages by id, every third one linked twice."""
    rows = page_table(spark, sf_dir, "source_id").groupBy("source_id").agg(F.sort_array(F.collect_set("page_id")).alias("ids"))
    html = F.array_join(F.transform("ids", lambda i: F.concat(link(i), F.when(i % 3 == 0, link(i)).otherwise(""))), "\n")
    return rows.select(F.col("source_id").alias("page_id"), html.alias("html"))


def dsc2_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _contents(spark, sf_dir, lambda i: F.concat(F.lit("<A class=x HREF=__P"), F.hex(i), F.when(i % 2 == 0, ".HTM#top>").otherwise(".HTM>"), i.cast("string"), F.lit("</A>")))
    return links.page_links(index, links.discovery("upper-htm")).select(F.col("page_id").alias("source_id"), F.col("position").cast("bigint").alias("position"), "slug", "link")


def dsc3_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _contents(spark, sf_dir, lambda i: F.concat(F.lit("<a href='../st/sth"), F.lpad((i * 7919 % 10000).cast("string"), 4, "0"), F.lit(".html#"), i.cast("string"), F.lit("'>x</a>")))
    return links.page_links(index, links.discovery("numbered-html")).select(F.col("page_id").alias("source_id"), F.col("position").cast("bigint").alias("position"), "slug", "link")


def family_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_table(spark, sf_dir, "source_id", "language", "page", "html")
    return rows.withColumn("language", F.coalesce("language", F.lit("?"))).withColumn("family", pages.family_of(F.col("html")))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.scanned(family_pages(spark, sf_dir).where("family IN ('anchored', 'block')"))


def _bare_marks():
    """Marks without the text between them."""
    return F.transform("marks", lambda m: m.dropFields("own", "after"))


def prs2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(_scans(spark, sf_dir).select("page_id", "family", F.length("region").alias("region_chars"), F.length("apparatus").alias("apparatus_chars")))


def prs5_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.skipped_headings(once(_scans(spark, sf_dir).select("page_id", "family", _bare_marks().alias("marks"))))


def prs8_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.marked(once(_scans(spark, sf_dir).select("page_id", _bare_marks().alias("marks"))), ["page_id"])


DOCUMENT = ["source_id", "language"]


def prs10_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = once(_scans(spark, sf_dir).select(*DOCUMENT, "page", "page_id", _bare_marks().alias("marks")))
    marks = pages.marked(scans, [*DOCUMENT, "page", "page_id"])
    rows = pages.accepted_markers(marks, DOCUMENT, ["page", "page_id", "start"])
    return rows.groupBy("source_id", "language", "accepted", "inline").agg(F.count(F.lit(1)).alias("markers"))


def prs11_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.numbered_units(family_pages(spark, sf_dir), DOCUMENT)


def prs13_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.titled_units(family_pages(spark, sf_dir), ["page_id"])
    return rows.select("page_id", F.col("position").cast("bigint").alias("position"), "label", "ref_number").dropDuplicates(["page_id", "position"])


def prs13_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.titled_units(family_pages(spark, sf_dir), ["page_id"]).dropDuplicates(["page_id", "position"])


# Addresses printed from stored locators, read back by the grammar.
PRINTED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(locator, ':', 2), '\.(pr|co)$', ' \1.'), '\.adarg$', ' ad arg.'), '\.(arg)(\d+)$', ' \1. \2'), '\.(ad)(\d+)$', ' \1 \2'), '\.sc(\d*)$', ' s. c. \1'), '\.([qa])(\d+)', ' \1. \2', 'g')"
SCHOLASTIC = r"^[^:]+:(?:I|I-II|II-II|III)\."


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stored_units", ["locator"]).distinct().where(F.col("locator").rlike(SCHOLASTIC))
    label = F.split_part("locator", F.lit(":"), F.lit(2))
    for pattern, by in ((r"\.(pr|co)$", " $1."), (r"\.adarg$", " ad arg."), (r"\.(arg)(\d+)$", " $1. $2"), (r"\.(ad)(\d+)$", " $1 $2"), (r"\.sc(\d*)$", " s. c. $1"), (r"\.([qa])(\d+)", " $1. $2")):
        label = F.regexp_replace(label, pattern, by)
    return rows.withColumn("label", F.trim(label)).withColumn("a", pages.address(F.col("label")))


def prs14_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    sequence = F.array_join(F.transform(pages.address_sequence(a), lambda x: x.cast("string")), ".")
    return _addressed(spark, sf_dir).select("locator", "label", pages.address_locator(a).alias("canonical"), pages.address_role(a).alias("role"), sequence.alias("sequence"))


def prs17_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unit_table(spark, sf_dir, "document_id", "locator", "ordinal")
    question = F.regexp_extract("locator", r"\.q(\d+)", 1).cast("int")
    article = F.regexp_extract("locator", r"\.a(\d+)", 1).cast("int")
    kind = F.when(F.col("locator").rlike(r"\.q\d+\.pr$"), "D").when(F.col("locator").rlike(r"\.co$"), "E").when(F.col("locator").rlike(r"^[^:]*:[IV-]*\.?pr$"), "B")
    rows = rows.where(F.col("locator").rlike(r"\.q\d+")).select("document_id", "unit_id", (F.col("ordinal").cast("bigint") * 10**9 + F.col("unit_id")).alias("at"), kind.alias("kind"), F.when(kind == "D", F.try_to_number(F.regexp_extract("locator", r"\.q(\d+)", 1), F.lit("999999"))).otherwise(F.try_to_number(F.regexp_extract("locator", r"\.a(\d+)", 1), F.lit("999999"))).cast("bigint").alias("number"))
    return pages.headings_in_force(rows, ["document_id"]).select("unit_id", "quaestio", "articulus")


def prs18_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scholastic units against the headings in force at them: prefaces of questions and main answers stand for the headings, in the order of the units."""
    rows = unit_table(spark, sf_dir, "document_id", "locator", "ordinal").where(F.col("locator").rlike(r"\.q\d+"))
    number = lambda letter: F.nullif(F.regexp_extract("locator", rf"\.{letter}(\d+)(?:\.|$)", 1), F.lit("")).cast("bigint")
    kind = F.when(F.col("locator").rlike(r"\.q\d+\.pr$"), "D").when(F.col("locator").rlike(r"\.co$"), "E")
    rows = rows.select("document_id", "unit_id", (F.col("ordinal").cast("bigint") * 10**9 + F.col("unit_id")).alias("at"), kind.alias("kind"), F.when(kind == "D", number("q")).otherwise(number("a")).alias("number"), number("q").alias("question"), number("a").alias("article"))
    framed = pages.headings_in_force(rows, ["document_id"]).withColumn("label", F.col("unit_id").cast("string"))
    return pages.label_disagreements(framed.withColumn("ref_label", F.lit(None).cast("string"))).select("unit_id", "question", "article", "quaestio", "articulus", "defect")


def prs19_enumerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = family_pages(spark, sf_dir).where("family = 'titled'")
    units = pages.titled_units(rows, ["page_id"]).select("page_id", "position", "label").dropDuplicates(["page_id", "position"])
    return once(pages.enumeration_defects(rows, units))


def prs21_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.article_shapes(unit_table(spark, sf_dir, "document_id", "locator", "role"), ["document_id"])


def prs22_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unit_table(spark, sf_dir, "document_id", "locator", "text", "ordinal")
    # the prefaces of the test texts announce nothing, so each gets a numeral; every fifth stays without
    numerals = F.array(*[F.lit(x) for x in ("duo", "Tria", "quatuor", "decem et septem", "duodeviginti")])
    phrase = F.concat("text", F.lit(". Circa primum quaeruntur "), F.element_at(numerals, (F.col("unit_id") % 5 + 1).cast("int")), F.lit(": et deinde"))
    stated = F.when(F.col("locator").rlike(r"\.pr$") & (F.col("ordinal") % 5 > 0), phrase).otherwise(F.col("text"))
    return pages.article_counts(rows.withColumn("text", stated), ["document_id"])


def prs23_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(pages.footnote_balance(_scans(spark, sf_dir)))


def prs24_unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.unnumbered_pages(page_table(spark, sf_dir), prs11_units(spark, sf_dir).select("page_id").unionByName(prs13_texts(spark, sf_dir).select("page_id")))


def prs26_bodiless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page read as its language's family, declared as sources declare one; those whose markup is another's have no body."""
    declared = F.when(F.col("language") == "hu", "anchored").otherwise("block")
    rows = page_table(spark, sf_dir, "language", "page", "html").withColumn("family", declared)
    return once(pages.without_body(pages.scanned(rows)))


def prs12_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "stored_units", ["locator"]).distinct()
    number = F.regexp_extract("locator", r":(\d+)$", 1)
    return rows.where(number != "").select("locator", T.anchor_of(number.cast("bigint")).alias("anchor"))


def src6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes in two encodings, with a byte that fits neither rule of UTF-8 at the end, read as they are declared."""
    rows = page_table(spark, sf_dir, "html")
    broken = F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("C3")))
    latin = F.encode(F.regexp_replace("html", r"[^\x{0}-\x{FF}]", "?"), "ISO-8859-1")
    return once(rows.select("page_id", F.md5(files.decoded(broken, F.lit(" UTF8 "))).alias("utf8"), F.md5(files.decoded(latin, F.lit("ISO-8859-1"))).alias("latin1"), F.md5(files.decoded(broken, F.lit("no-such"))).alias("unknown")))


def chk4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stored_units", ["locator"]).distinct().select("locator", T.article_of(F.col("locator")).alias("article"), chunking.passage_label(F.col("locator")).alias("label"))


QUERIES = {
    q.__name__: q
    for q in (nrm1_footnotes, nrm2_blocks, nrm3_tags, nrm4_named, nrm4_references, nrm5_nfc, nrm6_collapsed, nrm7_normalised, nrm8_residue, nrm9_folded, nrm11_slugs, hsh2_pages, dsc4_urls, prs2_regions, prs5_headings, prs8_marks, prs10_accepted, prs11_units, prs12_anchors, prs13_titled, prs13_texts, prs14_addresses, prs17_headings, prs18_disagreements, prs19_enumerations, prs21_shapes, prs22_counts, prs23_footnotes, prs24_unnumbered, prs26_bodiless, src6_decoded, chk4_labels)
} | {"dsc2_upper": dsc2_upper, "dsc3_numbered": dsc3_numbered, "dsc1_quoted": _discovered("quoted-path"), "dsc2_paths": _discovered("any-path"), "dsc3_sorted": _discovered("any-path-sorted")}

SPACES_SQL = "'[\\x{9}-\\x{D}\\x{20}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+'"
_COLLAPSED = f"trim(regexp_replace(text, {SPACES_SQL}, ' ', 'g'))"
_FOLDED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)&ordf;|ª', '', 'g'), 'IIae', 'II', 'g'), ',', '', 'g'), '\\s+', ' ', 'g'))"

ORACLE = {
    "nrm1_footnotes": f"SELECT page_id, len(regexp_extract_all(html, {RAISED_SQL})) AS \"references\", md5(regexp_replace(html, {RAISED_SQL}, '', 'g')) AS rest FROM {PAGES}",
    "nrm2_blocks": f"SELECT page_id, md5(regexp_replace(html, {BLOCK_SQL}, ' ', 'g')) AS text FROM {PAGES}",
    "nrm3_tags": f"SELECT page_id, md5(regexp_replace(regexp_replace(html, {BLOCK_SQL}, ' ', 'g'), '<[^>]+>', '', 'g')) AS text FROM {PAGES}",
    "nrm4_named": f"SELECT page_id, md5(regexp_replace({named_sql('html')}, '(?i)&amp;', '&', 'g')) AS text FROM {PAGES}",
    "nrm4_references": f"SELECT context_id, regexp_replace(text, '(?i)&amp;', '&', 'g') AS text FROM {numeric_sql('text', f"(SELECT context_id, {named_sql('text')} AS text FROM {CONTEXT})")}",
    "nrm7_normalised": f"""SELECT context_id, trim(regexp_replace(nfc_normalize(regexp_replace(text, '(?i)&amp;', '&', 'g')), {SPACES_SQL}, ' ', 'g')) AS text FROM {numeric_sql('text', f"""(SELECT context_id, {named_sql(f"regexp_replace(regexp_replace(regexp_replace(text, {RAISED_SQL}, '', 'g'), {BLOCK_SQL}, ' ', 'g'), '<[^>]+>', '', 'g')")} AS text FROM {CONTEXT})""")}""",
    "nrm5_nfc": f"SELECT unit_id, nfc_normalize(text) AS text FROM {UNITS}",
    "nrm6_collapsed": f"SELECT unit_id, {_COLLAPSED} AS text FROM {UNITS}",
    "nrm8_residue": f"SELECT unit_id, regexp_replace(' . ' || text, '^[.\\s]+', '') AS text FROM {UNITS}",
    "nrm9_folded": f"SELECT unit_id, label, regexp_replace(label, '\\bad arg\\.$', 'ad') AS listed FROM (SELECT unit_id, {_FOLDED.format(LABEL_IN)} AS label FROM {UNITS})",
    "nrm11_slugs": "SELECT doc_id, replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(title, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', '', 'g'))), '[^\\p{L}\\p{N} _-]', '', 'g'), ' ', '-') AS slug FROM documents",
    "hsh2_pages": f"SELECT page_id, sha256(html) AS hash FROM {PAGES}",
    "dsc1_quoted": _links_sql("quoted-path"),
    "dsc2_paths": _links_sql("any-path"),
    "dsc3_sorted": _links_sql("any-path-sorted"),
    "dsc4_urls": f"""WITH found AS (SELECT page_id, url, unnest(regexp_extract_all(html, {LINK_SQL['any-path'][0]}, 1)) AS link, unnest(regexp_extract_all(html, {LINK_SQL['any-path'][0]}, 2)) AS slug, generate_subscripts(regexp_extract_all(html, {LINK_SQL['any-path'][0]}, 1), 1) AS pos FROM {PAGES})
      SELECT page_id, slug, regexp_extract(any_value(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') || arg_min(link, pos) AS url FROM found WHERE url IS NOT NULL GROUP BY page_id, slug UNION ALL SELECT DISTINCT page_id, slug, NULL FROM found WHERE url IS NULL""",
    "dsc2_upper": f"SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY page_id) AS position, '__P' || upper(printf('%X', page_id)) AS slug, '__P' || upper(printf('%X', page_id)) || '.HTM' AS link FROM (SELECT DISTINCT source_id, page_id FROM source_pages)",
    "dsc3_numbered": """WITH p AS (SELECT DISTINCT source_id, 'sth' || lpad(CAST(page_id * 7919 % 10000 AS VARCHAR), 4, '0') AS slug FROM source_pages)
      SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY slug) AS position, slug, '../st/' || slug || '.html' AS link FROM p""",
    "prs12_anchors": "SELECT DISTINCT locator, 'K' || lpad(n, greatest(4, length(n))::INT, '0') AS anchor FROM (SELECT locator, regexp_extract(locator, ':(\\d+)$', 1) AS n FROM stored_units) WHERE n <> ''",
    "prs13_titled": f"""WITH titled AS (SELECT page_id, html FROM {PAGES} WHERE regexp_matches(html, '(?i)<p\\b[^>]*\\btitle\\s*=')),
      u AS (SELECT page_id, unnest(regexp_extract_all(html, {TITLED_SQL}, 1)) AS l, unnest(regexp_extract_all(html, {TITLED_SQL}, 2)) AS i, generate_subscripts(regexp_extract_all(html, {TITLED_SQL}, 1), 1) AS p FROM titled)
      SELECT page_id, CAST(p - 1 AS BIGINT) AS position, {_FOLDED.format('l')} AS label, CAST(nullif(regexp_extract(i, {SPAN_SQL}, 1), '') AS BIGINT) AS ref_number FROM u""",
    "prs13_texts": f"""WITH titled AS (SELECT page_id, html FROM {PAGES} WHERE regexp_matches(html, '(?i)<p\\b[^>]*\\btitle\\s*=')),
      u AS (SELECT page_id, unnest(regexp_extract_all(html, {TITLED_SQL}, 1)) AS l, unnest(regexp_extract_all(html, {TITLED_SQL}, 2)) AS i, generate_subscripts(regexp_extract_all(html, {TITLED_SQL}, 1), 1) AS p FROM titled),
      b AS (SELECT *, {named_sql(f"regexp_replace(regexp_replace(regexp_replace(i, {SPAN_SQL}, '', 'g'), {BLOCK_SQL}, ' ', 'g'), '<[^>]+>', '', 'g')")} AS text FROM u)
      SELECT page_id, p - 1 AS position, {_FOLDED.format('l')} AS label, CAST(nullif(regexp_extract(i, {SPAN_SQL}, 1), '') AS BIGINT) AS ref_number, {_FOLDED.format(f"nullif(regexp_extract(i, {SPAN_SQL}, 2), '')")} AS ref_label,
        regexp_replace(trim(regexp_replace(nfc_normalize(regexp_replace(text, '(?i)&amp;', '&', 'g')), {SPACES_SQL}, ' ', 'g')), '^[.\\s]+', '') AS text FROM {numeric_sql('text', 'b')}""",
    "prs14_addresses": f"""WITH l AS (SELECT DISTINCT locator, trim({PRINTED}) AS label FROM stored_units WHERE regexp_matches(locator, {quoted(SCHOLASTIC)})),
      r AS (SELECT *, split_part(locator, ':', 2) AS tail, regexp_extract(locator, '\\.([a-z]+)\\d*$', 1) AS role FROM l)
      SELECT locator, label, 'summa:' || tail AS canonical, CASE role WHEN 'pr' THEN 'prooemium' WHEN 'arg' THEN 'objection' WHEN 'sc' THEN 'sed_contra' WHEN 'co' THEN 'respondeo' ELSE 'reply' END AS role,
        CASE split_part(tail, '.', 1) WHEN 'I' THEN 1 WHEN 'I-II' THEN 2 WHEN 'II-II' THEN 3 ELSE 4 END || '.' || coalesce(nullif(regexp_extract(tail, '\\.q(\\d+)', 1), ''), '0') || '.' || coalesce(nullif(regexp_extract(tail, '\\.a(\\d+)\\.', 1), ''), '0')
        || '.' || CASE role WHEN 'pr' THEN 0 WHEN 'arg' THEN 1 WHEN 'sc' THEN 2 WHEN 'co' THEN 3 ELSE 4 END || '.' || coalesce(nullif(regexp_extract(tail, '\\.(?:arg|sc|ad)(\\d+)$', 1), ''), '0') AS sequence FROM r""",
    "prs17_headings": f"""WITH u AS (SELECT unit_id, document_id, CAST(ordinal AS BIGINT) * 1000000000 + unit_id AS pos,
        CASE WHEN regexp_matches(locator, '\\.q\\d+\\.pr$') THEN 'D' WHEN regexp_matches(locator, '\\.co$') THEN 'E' END AS kind,
        CAST(nullif(regexp_extract(locator, '\\.q(\\d+)', 1), '') AS BIGINT) AS q, CAST(nullif(regexp_extract(locator, '\\.a(\\d+)', 1), '') AS BIGINT) AS a FROM {UNITS} WHERE regexp_matches(locator, '\\.q\\d+'))
      SELECT unit_id, last_value(CASE WHEN kind = 'D' THEN q END IGNORE NULLS) OVER w AS quaestio,
        CASE WHEN last_value(kind IGNORE NULLS) OVER w = 'E' THEN last_value(CASE WHEN kind = 'E' THEN a END IGNORE NULLS) OVER w END AS articulus
      FROM u WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "prs21_shapes": f"""WITH r AS (SELECT document_id, regexp_replace(locator, '\\.[^.]*$', '') AS article, regexp_extract(locator, '\\.([a-z]+)\\d*$', 1) AS r, CAST(nullif(regexp_extract(locator, '\\.[a-z]+(\\d+)$', 1), '') AS INT) AS n FROM {UNITS}),
      p AS (SELECT document_id, article, count(*) FILTER (r = 'ad') AS ad, count(*) FILTER (r IN ('arg', 'sc')) AS raised, count(*) FILTER (r = 'co') AS co, count(*) FILTER (r = 'arg') AS arg, count(DISTINCT n) FILTER (r = 'arg') AS numbers, min(n) FILTER (r = 'arg') AS lo, max(n) FILTER (r = 'arg') AS hi FROM r WHERE r IN ('arg', 'sc', 'co', 'ad') GROUP BY ALL)
      SELECT document_id, article, 'more-replies' AS kind FROM p WHERE ad > raised UNION ALL SELECT document_id, article, 'answer-absent' FROM p WHERE co = 0
      UNION ALL SELECT document_id, article, 'objections-not-contiguous' FROM p WHERE arg > 0 AND coalesce(NOT (numbers = arg AND lo = 1 AND hi = arg), true)""",
    "prs22_counts": f"""WITH r AS (SELECT document_id, nullif(regexp_extract(locator, '^(.*\\.q\\d+)(?:\\.|$)', 1), '') AS question, nullif(regexp_extract(locator, '\\.(a\\d+)\\.', 1), '') AS article,
        CASE WHEN regexp_matches(locator, '\\.q\\d+\\.pr$') AND ordinal % 5 > 0 THEN [2, 3, 4, 17, 18][CAST(unit_id % 5 + 1 AS INT)] END AS stated FROM {UNITS})
      SELECT document_id, question, max(stated) AS stated, count(DISTINCT article) AS articles, CASE WHEN max(stated) IS NULL THEN 'unstated' WHEN max(stated) = count(DISTINCT article) THEN 'equal' ELSE 'differs' END AS verdict FROM r WHERE question IS NOT NULL GROUP BY document_id, question""",
    "src6_decoded": f"SELECT page_id, md5(html || chr(65533)) AS utf8, md5(regexp_replace(html, '[^\\x{{0}}-\\x{{FF}}]', '?', 'g')) AS latin1, md5(html || chr(65533)) AS unknown FROM {PAGES}",
    "prs18_disagreements": f"""WITH u AS (SELECT unit_id, document_id, CAST(ordinal AS BIGINT) * 1000000000 + unit_id AS pos,
        CASE WHEN regexp_matches(locator, '\\.q\\d+\\.pr$') THEN 'D' WHEN regexp_matches(locator, '\\.co$') THEN 'E' END AS kind,
        CAST(nullif(regexp_extract(locator, '\\.q(\\d+)', 1), '') AS BIGINT) AS q, CAST(nullif(regexp_extract(locator, '\\.a(\\d+)(?:\\.|$)', 1), '') AS BIGINT) AS a FROM {UNITS} WHERE regexp_matches(locator, '\\.q\\d+')),
      f AS (SELECT unit_id, q, a, last_value(CASE WHEN kind = 'D' THEN q END IGNORE NULLS) OVER w AS quaestio,
        CASE WHEN last_value(kind IGNORE NULLS) OVER w = 'E' THEN last_value(CASE WHEN kind = 'E' THEN a END IGNORE NULLS) OVER w END AS articulus
        FROM u WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT unit_id, q AS question, a AS article, quaestio, articulus, 'label-disagreement' AS defect FROM f WHERE q IS DISTINCT FROM quaestio OR a IS DISTINCT FROM articulus""",
    "prs19_enumerations": f"""WITH titled AS (SELECT page_id, html FROM {PAGES} WHERE regexp_matches(html, '(?i)<p\\b[^>]*\\btitle\\s*=')),
      t AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)value\\s*=\\s*"?#([0-9]+)"?\\s*>([^\\x27]*)\\x27', 2), lambda x: regexp_replace({_FOLDED.format('x')}, '\\bad arg\\.$', 'ad')) AS toc,
        list_transform(regexp_extract_all(html, {TITLED_SQL}, 1), lambda x: regexp_replace({_FOLDED.format('x')}, '\\bad arg\\.$', 'ad')) AS body FROM titled)
      SELECT page_id, CASE WHEN len(toc) = 0 THEN 'enumeration-absent' ELSE 'enumeration-mismatch' END AS kind, len(toc) AS listed, len(body) AS present,
        len(list_filter(toc, lambda x: NOT list_contains(body, x))) AS missing, len(list_filter(body, lambda x: NOT list_contains(toc, x))) AS extra FROM t WHERE len(toc) = 0 OR toc <> body""",
    "prs2_regions": r"""WITH p AS (SELECT DISTINCT page_id, html, regexp_matches(html, '(?i)<div[^>]*class="[^"]*article-content') AS anchored FROM source_pages WHERE NOT regexp_matches(html, '(?i)<p\b[^>]*\btitle\s*=') AND (regexp_matches(html, '(?i)<div[^>]*class="[^"]*article-content') OR regexp_matches(html, '(?i)<hr\b[^>]*\bnoshade\b'))),
      t AS (SELECT page_id, string_split_regex(html, '(?i)<hr\b[^>]*>') AS parts, regexp_extract_all(html, '(?i)<hr\b[^>]*>') AS tags FROM p WHERE NOT anchored),
      o AS (SELECT *, coalesce(list_position(list_transform(tags, lambda x: contains(lower(x), 'noshade') AND regexp_extract(lower(x), '\bsize\s*=\s*"?([^\s">]+)', 1) = '1'), true), 0) AS i, list_transform(tags, lambda x: regexp_extract(lower(x), '\bwidth\s*=\s*"?([^\s">]+)', 1)) AS widths FROM t),
      e AS (SELECT *, list_filter(range(i + 1, len(tags) + 1), lambda k: widths[k] = '30%')[1] AS notes, list_filter(range(i + 1, len(tags) + 1), lambda k: widths[k] = '70%')[1] AS rule FROM o),
      block AS (SELECT page_id, 'block' AS family, CASE WHEN i > 0 THEN length(array_to_string(list_transform(range(i + 1, coalesce(notes, rule, len(tags) + 1) + 1), lambda k: parts[k] || CASE WHEN k < coalesce(notes, rule, len(tags) + 1) THEN tags[k] ELSE '' END), '')) END AS region_chars,
        CASE WHEN i > 0 THEN CASE WHEN notes IS NULL THEN 0 ELSE length(array_to_string(list_transform(range(notes, len(tags) + 1), lambda k: tags[k] || parts[k + 1]), '')) END END AS apparatus_chars FROM e),
      d AS (SELECT page_id, regexp_replace(html, '(?is)^.*?<div[^>]*class="[^"]*article-content[^"]*"[^>]*>', '') AS rest FROM p WHERE anchored),
      v AS (SELECT page_id, string_split_regex(rest, '(?i)</?div\b[^>]*>') AS parts, regexp_extract_all(rest, '(?i)</?div\b[^>]*>') AS tags FROM d),
      z AS (SELECT *, list_filter(range(1, len(tags) + 1), lambda i: 2 * len(list_filter(tags[1:i], lambda x: starts_with(x, '</'))) - i = 1)[1] AS k FROM v),
      g AS (SELECT page_id, array_to_string(list_transform(range(1, k + 1), lambda j: parts[j] || CASE WHEN j < k THEN tags[j] ELSE '' END), '') AS region FROM z),
      n AS (SELECT page_id, region, strpos(region, regexp_extract(region, '(?i)<a\b[^>]*\bname="J[0-9]+"[^>]*>')) AS def, regexp_matches(region, '(?i)<a\b[^>]*\bname="J[0-9]+"[^>]*>') AS noted FROM g),
      h AS (SELECT *, substr(region, 1, def - 1) AS before, regexp_extract(substr(region, 1, def - 1), '(?is)^.*(jegyzetek.*)$', 1) AS labelled FROM n),
      c AS (SELECT *, CASE WHEN NOT noted THEN length(region) WHEN regexp_full_match(labelled, '(?is)jegyzetek\s*:?\s*(?:<[^>]*>|\s)*') THEN length(before) - length(labelled)
        WHEN contains(before, '<p') THEN length(before) - length(regexp_extract(before, '(?s)^.*(<p.*)$', 1)) ELSE def - 1 END AS cut FROM h)
      SELECT * FROM block UNION ALL SELECT page_id, 'anchored', CAST(cut AS BIGINT), CAST(length(region) - cut AS BIGINT) FROM c""",
    "prs23_footnotes": r"""WITH p AS (SELECT DISTINCT page_id, html FROM source_pages WHERE regexp_matches(html, '(?i)<hr\b[^>]*\bnoshade\b') AND NOT regexp_matches(html, '(?i)<div[^>]*class="[^"]*article-content') AND NOT regexp_matches(html, '(?i)<p\b[^>]*\btitle\s*=')),
      t AS (SELECT page_id, string_split_regex(html, '(?i)<hr\b[^>]*>') AS parts, regexp_extract_all(html, '(?i)<hr\b[^>]*>') AS tags FROM p),
      o AS (SELECT *, coalesce(list_position(list_transform(tags, lambda x: contains(lower(x), 'noshade') AND regexp_extract(lower(x), '\bsize\s*=\s*"?([^\s">]+)', 1) = '1'), true), 0) AS i, list_transform(tags, lambda x: regexp_extract(lower(x), '\bwidth\s*=\s*"?([^\s">]+)', 1)) AS widths FROM t),
      e AS (SELECT *, list_filter(range(i + 1, len(tags) + 1), lambda k: widths[k] = '30%')[1] AS notes, list_filter(range(i + 1, len(tags) + 1), lambda k: widths[k] = '70%')[1] AS rule FROM o WHERE i > 0),
      r AS (SELECT page_id, array_to_string(list_transform(range(i + 1, coalesce(notes, rule, len(tags) + 1) + 1), lambda k: parts[k] || CASE WHEN k < coalesce(notes, rule, len(tags) + 1) THEN tags[k] ELSE '' END), '') AS region,
        CASE WHEN notes IS NULL THEN '' ELSE array_to_string(list_transform(range(notes, len(tags) + 1), lambda k: tags[k] || parts[k + 1]), '') END AS apparatus FROM e),
      s AS (SELECT page_id, regexp_extract_all(region, '(?i)<a\b[^>]*\bname\s*=\s*"?-([0-9A-Za-z]+)"?[^>]*>', 1) AS r, regexp_extract_all(apparatus, '(?i)<a\b[^>]*\bname\s*=\s*"?\$([0-9A-Za-z]+)"?[^>]*>', 1) AS d FROM r),
      u AS (SELECT page_id, list_filter(r, lambda x, k: list_position(r, x) = k) AS r, list_filter(d, lambda x, k: list_position(d, x) = k) AS d FROM s),
      v AS (SELECT *, list_filter(r, lambda x: NOT list_contains(d, x)) AS a, list_filter(d, lambda x: NOT list_contains(r, x)) AS b FROM u)
      SELECT page_id, len(r) AS referenced, len(d) AS defined, array_to_string(a[1:4], ', ') AS undefined, array_to_string(b[1:4], ', ') AS unreferenced FROM v WHERE len(a) > 0 OR len(b) > 0""",
    "prs26_bodiless": f"""WITH p AS (SELECT DISTINCT page_id, language, page, html FROM source_pages),
      d AS (SELECT page_id, page, language, regexp_matches(html, '(?i)<div[^>]*class="[^"]*article-content[^"]*"[^>]*>') AS opened,
        regexp_extract_all(regexp_replace(html, '(?is)^.*?<div[^>]*class="[^"]*article-content[^"]*"[^>]*>', ''), '(?i)<(/?)div\\b[^>]*>', 1) AS divs,
        len(list_filter(regexp_extract_all(lower(html), '<hr\\b[^>]*>'), lambda h: contains(h, 'noshade') AND regexp_extract(h, 'size\\s*=\\s*"?([^\\s">]+)', 1) = '1')) > 0 AS ruled FROM p WHERE html <> '')
      SELECT page_id, 'count-mismatch' AS kind, 'page:' || page AS locator FROM d WHERE CASE WHEN language = 'hu' THEN NOT opened OR len(list_filter(range(1, len(divs) + 1), lambda i: 2 * len(list_filter(divs[1:i], lambda x: x = '/')) - i = 1)) = 0 ELSE NOT ruled END
      UNION ALL SELECT page_id, 'count-mismatch', 'page:' || page FROM p WHERE coalesce(html, '') = ''""",
    "chk4_labels": """WITH l AS (SELECT DISTINCT locator, regexp_replace(locator, '\\.[^.]*$', '') AS article, regexp_extract(locator, '([^.:]*)$', 1) AS r FROM stored_units)
      SELECT locator, article, CASE WHEN r = 'pr' THEN 'Prooemium' WHEN r = 'co' THEN 'Respondeo' WHEN r = 'adarg' THEN 'Ad argumentum'
        WHEN regexp_matches(r, '^(arg|sc|ad)\\d*$') THEN trim(CASE regexp_extract(r, '^([a-z]+)', 1) WHEN 'arg' THEN 'Obiectio' WHEN 'sc' THEN 'Sed contra' ELSE 'Ad' END || ' ' || regexp_extract(r, '(\\d*)$', 1)) ELSE r END AS label FROM l""",
}
