"""Texts that were cut off before their end, and how often each source cuts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmith.plans.store import spread, written

FACTS = "kind string, doc_id bigint, source string, genre string, a string, b string, c string, d string, n bigint, m bigint"

PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "”", "«": "»", "‘": "’"}
OPENER = {")": "(", "]": "[", "}": "{", "”": "“„", "»": "«", "’": "‘"}
CLOSERS = "".join(sorted(set(PAIRS.values()))) + "\"'"
# Elements whose end tag may not be left out.
ENCLOSING = frozenset("a abbr article aside b big blockquote button center cite code del details div dl em fieldset figure font footer form h1 h2 h3 h4 h5 h6 header i ins label main mark math menu nav ol pre q s section select small span strike strong sub summary sup table textarea title tt u ul var".split())
#: What moves the automaton, over the whole text: fences, tags, environments, broken escapes, quotes and brackets. Escaped signs and intervals such as [0, 1) are read over.
TOKEN = re.compile(
    r"""(?P<fence>^[ \t]*(?:`{3,}|~{3,}))"""
    r"""|\\begin\{(?P<begin>\w+\*?)\}|\\end\{(?P<end>\w+\*?)\}"""
    r"""|(?P<escape>\\(?:u(?![{])[0-9a-fA-F]{0,3}(?![0-9a-fA-F\w])|x[0-9a-fA-F]?(?![0-9a-fA-F\w])))"""
    r"""|\\[(){}\[\]"]|[\[(\]]\s*[-+]?[\w.∞]+\s*[,;]\s*[-+]?[\w.∞]+\s*[\])\[]"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?:\s+[a-zA-Z-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+)|\s+(?:hidden|open|disabled|controls|reversed))*\s*(?P<void>/?)>"""
    r"""|(?P<sign>[()\[\]{}“”„«»‘’"])""",
    re.M,
)
#: What stands at the end in place of what was lost: marks of omission, halves of characters, escapes, references and tags.
STAND_INS = (
    ("mark", re.compile(r"(?:…|\.{3,}|\. \. \.|[\[(](?:…|\.{2,})[\])])\Z")),
    ("bytes", re.compile(r"�\Z")),
    ("hyphen", re.compile(r"[^\W\d_][-‐\xad]\Z")),
    ("escape", re.compile(r"\\(?:u[0-9a-fA-F]{0,3}|U[0-9a-fA-F]{0,7}|x[0-9a-fA-F]?|[a-z]?)\Z")),
    ("reference", re.compile(r"&(?:#\d*|#[xX][0-9a-fA-F]*|[a-zA-Z]{2,})\Z|%[0-9A-F]?\Z")),
    ("markup", re.compile(r"<[!/]?[a-zA-Z][^<>]*\Z|<\Z|\[\[[^\]]*\Z|\{\{[^}]*\Z|\[[^\[\]]*\]\([^()\s]*\Z")),
)
TERMINATED = re.compile(rf"[.!?։。！？;:]?[.!?。！？][{re.escape(CLOSERS)}]*\Z")
ASIDE = re.compile(r"\A[(\[].*[)\]]\Z", re.S)
WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")

#: Deviations of the bounds of rates: of what is denied to a word or a source, and of what closing lines are told by.
SURE, LIKELY = 3.0, 2.0
#: A source in which surely more than this share of the texts that end with a full stop leave a sign open has that habit.
HABIT = 0.05
#: A word belongs to closing lines if this share of its occurrences stand in last lines without a full stop, and likely more than the second.
CLOSES, LEAST = 0.9, 0.5
#: One word alone closes if likely more than this share of the lines that begin with it are such last lines.
ALONE = 0.1
#: A last word is half a word if at least this share of its occurrences, those of the words it begins included, are of these.
HALVES = 0.05
#: A word ends no line if it does so at less than this share of the rate of all words, and surely below that rate.
SELDOM = 0.02


def left_open(text: str) -> list[str]:
    """What a stack automaton holds at the end of a text, outermost first: signs, "<tag>", "```" or "\\name" of environments; "\\u" for an escape that was broken anywhere.

    A closer without its opener changes nothing, one that reaches over openers closes them as well. A quote opened again at the start of
    a paragraph is the same quote. An opening ‘ is not reported, since it is written for ’ too often.
    """
    stack: list[str] = []
    fence, broken = "", False

    def close(openers: str | tuple[str, ...]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at] in openers:
                del stack[at:]
                return

    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "fence":
            mark = m.group().strip()[0]
            if fence == mark:
                fence = ""
                close(("```",))
            elif not fence:
                fence = mark
                stack.append("```")
            continue
        if fence or kind is None:
            continue
        if kind == "escape":
            broken = True
        elif kind == "begin":
            stack.append("\\" + m.group("begin"))
        elif kind == "end":
            close(("\\" + m.group("end"),))
        elif kind in ("tag", "close", "void"):
            name = m.group("tag").lower()
            if name in ENCLOSING and not m.group("void"):
                if m.group("close"):
                    close((f"<{name}>",))
                else:
                    stack.append(f"<{name}>")
        else:
            sign, at = m.group(), m.start()
            before, after = text[at - 1 : at], text[at + 1 : at + 2]
            if sign == '"':
                if '"' in stack and (not after or not after.isalnum()):
                    close('"')
                elif (not before or before.isspace() or before in "([{–—-“„") and after and not after.isspace():
                    stack.append('"')
            elif sign in OPENER:
                close(OPENER[sign])
            elif sign == "“" and stack and stack[-1] == "„" and not after.isalnum():
                stack.pop()
            elif not (sign in "“„«" and sign in stack and (not before or before == "\n")):
                stack.append(sign)
    return [s for s in stack if s != "‘"] + ["\\u"] * broken


def end_state(text: str) -> tuple[str, str]:
    """(what a text by itself shows, last line): complete, a stand-in's name, open (something is left open), or bare (no terminator)."""
    state, last = ending(text)
    return ("open" if state in ("complete", "bare") and left_open(text) else state), last


def ending(text: str) -> tuple[str, str]:
    """(what the end shows, last line): complete, a stand-in's name, or bare."""
    text = text.rstrip()
    last = text[text.rfind("\n") + 1 :]
    for name, pattern in STAND_INS:
        if pattern.search(last):
            return name, last
    if TERMINATED.search(last) or ASIDE.match(last) and "\n" in text:
        return "complete", last
    return "bare", last


def gather(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One scan. Documents that do not end as complete ones do, or leave something open (d), and the words of their last lines (l). Summed per batch:

    words outside such last lines (w), words of inner lines without a terminator and how often they end one (v), first words of lines that
    go on (s), inner lines and those without a terminator by source and genre (b), texts with a terminator by source (t), and what those leave open (o).
    """
    for batch in batches:
        rows: list[tuple] = []
        words: Counter[str] = Counter()
        listed: Counter[str] = Counter()
        finals: Counter[str] = Counter()
        starts: Counter[str] = Counter()
        inner: Counter[tuple[str | None, str | None]] = Counter()
        bare: Counter[tuple[str | None, str | None]] = Counter()
        ended: Counter[str | None] = Counter()
        habits: Counter[tuple[str | None, str]] = Counter()
        for doc_id, text, source, genre in zip(batch.doc_id, batch.text, batch.source, batch.genre, strict=True):
            if not text or not text.strip():
                continue
            text = text.rstrip()
            state, last = ending(text)
            opened = sorted(set(left_open(text)))
            lines = text.split("\n")
            words.update(WORD.findall(text if state == "complete" else text[: len(text) - len(last)]))
            if len(lines) > 1:
                starts.update([line.split(" ", 1)[0] for line in lines if " " in line])
                key = (source, genre)
                whole = [line for line in lines[1:-1] if line.strip()]  # the first line may be a heading or an address
                open_ended = [line for line in whole if not TERMINATED.search(line.rstrip())]
                inner[key] += len(whole)
                bare[key] += len(open_ended)
                for found in map(WORD.findall, open_ended):
                    listed.update(found)
                    finals.update(found[-1:])
            if state == "complete":
                ended[source] += 1
                habits.update((source, sign) for sign in opened)
                if not opened:
                    continue
            line = re.sub(r"\d+", "0", last) if state == "bare" and len(lines) > 1 else None
            tail = WORD.findall(last)
            word = tail[-1] if tail and last.rstrip(" ([{“„‘«\"").endswith(tail[-1]) else None
            digest = hashlib.md5(text.encode("utf-8", "replace")).hexdigest()
            rows.append(("d", doc_id, source, genre, state, "\n".join(opened) or None, line, word, 0, 0))
            if line is not None:
                rows += [("l", None, None, None, line, w, word, digest, 0, 0) for w in set(tail)]
        rows += [("w", None, None, None, w, None, None, None, n, 0) for w, n in words.items()]
        rows += [("v", None, None, None, w, None, None, None, n, finals[w]) for w, n in listed.items()]
        rows += [("s", None, None, None, w, None, None, None, n, 0) for w, n in starts.items()]
        rows += [("b", None, *k, None, None, None, None, n, bare[k]) for k, n in inner.items()]
        rows += [("t", None, k, None, None, None, None, None, n, 0) for k, n in ended.items()]
        rows += [("o", None, k, None, sign, None, None, None, n, 0) for (k, sign), n in habits.items()]
        frame = pd.DataFrame(rows, columns=["kind", "doc_id", "source", "genre", "a", "b", "c", "d", "n", "m"])
        yield frame.assign(doc_id=pd.array([r[1] for r in rows], dtype="Int64"))


def bound(hits: Column, trials: Column, deviations: float) -> Column:
    """Wilson's bound of a rate, the upper one for positive deviations and the lower one for negative; 1 and 0 where nothing was tried."""
    z2 = deviations * deviations
    root = deviations * F.sqrt(hits * (trials - hits) / trials + z2 / 4)
    return F.when(trials > 0, (hits + z2 / 2 + root) / (trials + z2)).otherwise(1.0 if deviations > 0 else 0.0)


def closing_lines(parts: DataFrame, words: DataFrame, starts: DataFrame, halves: DataFrame, never: DataFrame) -> DataFrame:
    """Last lines that close a text although no full stop does: (line).

    parts: (line, word, last, digest), a row per different word of a last line. Either the line holds a word that stands in such last lines
    more often than elsewhere, or it is one word that seldom begins a longer line and may end one; half a word at the end is no such word. A line that a line as frequent goes on with (or any, after a word that ends no lines), is no closing line but part of one.
    Every rate is one of different texts, copies count once; a line's number of texts alone decides nothing.
    """
    by_line = parts.select("line", "last", "digest").distinct().groupBy("line", "last").agg(F.count(F.lit(1)).alias("texts"))
    closing = parts.select("word", "digest").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("closing"))
    everywhere = F.col("closing") + F.coalesce("total", F.lit(0))
    own = closing.join(words, "word", "left").where((F.col("closing") >= CLOSES * everywhere) & (bound(F.col("closing"), everywhere, -LIKELY) > LEAST)).select("word")
    halved = halves.select("last", F.col("last").alias("word"))
    held = parts.select("line", "word", "last").distinct().join(own, "word").join(halved, ["last", "word"], "left_anti").select("line").distinct()
    alone = by_line.where("line = last").join(starts.withColumnRenamed("word", "last"), "last", "left")
    alone = alone.where(bound(F.col("texts"), F.col("texts") + F.coalesce("lines", F.lit(0)), -LIKELY) > ALONE)
    alone = alone.join(never, "last", "left_anti").join(halves, "last", "left_anti").select("line")
    candidates = by_line.join(held.unionByName(alone).distinct(), "line")
    candidates = candidates.join(never.withColumn("_never", F.lit(True)), "last", "left")
    order = Window.partitionBy(F.split("line", " ", 2)[0]).orderBy("line")
    candidates = candidates.withColumns({"_next": F.lead("line").over(order), "_more": F.lead("texts").over(order)})
    # the next line in order goes on where this one ends
    part = F.coalesce(F.expr("startswith(_next, line)") & ((F.col("_more") >= F.col("texts")) | F.coalesce("_never", F.lit(False))), F.lit(False))
    return candidates.where(~part).select("line").distinct()


def half_words(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(last): last words that no text holds elsewhere, but as the beginning of other words."""
    lasts = parts.where("last IS NOT NULL").select("last", "digest").distinct().groupBy("last").agg(F.count(F.lit(1)).alias("closing"))
    unknown = lasts.join(words.withColumnRenamed("word", "last"), "last", "left_anti")
    begun = words.select(F.explode(F.expr("transform(sequence(1, greatest(1, char_length(word) - 1)), i -> left(word, i))")).alias("last"), "total", "word").where("last <> word")
    longer = begun.join(unknown, "last").groupBy("last", "closing").agg(F.sum("total").alias("longer"))
    return longer.where(F.col("longer") >= HALVES * (F.col("longer") + F.col("closing"))).select("last")


def verdicts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, state, cut) of the documents (doc_id, text, source, genre) that do not end as complete texts do.

    A stack automaton over the whole text finds what is left open: quotes, brackets, tags, code fences, environments, broken escapes. Open
    signs that complete texts of the source often leave open too are its habit and no evidence (a baseline; the text itself
    is not counted in it). Stand-ins at the end (marks of omission, half characters, escapes, references, tags) are told by patterns.
    A missing terminator is no cut where the last line is a closing line, or where inner lines of the same source and genre, which cannot
    have been cut, mostly lack one too (the genre's where the source's rate is unsure) and the last word is one that ends lines: it is
    known from elsewhere and does not surely end lines far more seldom than words do.
    Null and blank texts are no case and do not appear; repeats of a cut text are cut. A null source or genre is a
    group of its own. Other columns are not read.
    """
    rows = documents.select("doc_id", "text", "source", "genre")
    facts = written(spread(rows).mapInPandas(gather, FACTS), "truncation-facts")
    ends = facts.where("kind = 'd'").select("doc_id", "source", "genre", F.col("a").alias("state"), F.col("b").alias("opened"), F.col("c").alias("line"), F.col("d").alias("word"))
    parts = facts.where("kind = 'l'").select(F.col("a").alias("line"), F.col("b").alias("word"), F.col("c").alias("last"), F.col("d").alias("digest"))
    sums = facts.where("kind IN ('w', 'v', 's')").groupBy("kind", F.col("a").alias("word")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    sums = written(sums, "truncation-words")
    words = sums.where("kind = 'w'").select("word", F.col("n").alias("total"))
    listed = sums.where("kind = 'v'").select("word", F.col("n").alias("listed"), F.col("m").alias("final"))
    starts = sums.where("kind = 's'").select("word", F.col("n").alias("lines"))

    usual_final = listed.agg(F.coalesce(F.try_divide(F.sum("final"), F.sum("listed")), F.lit(0.0)).alias("usual_final"))
    seldom = (bound(F.col("final"), F.col("listed"), SURE) < F.col("usual_final")) & (F.col("final") < SELDOM * F.col("usual_final") * F.col("listed"))
    never = listed.crossJoin(F.broadcast(usual_final)).where(seldom).select(F.col("word").alias("last"))

    signs = facts.where("kind = 'o'").groupBy("source", F.col("a").alias("sign")).agg(F.sum("n").alias("leaving"))
    ended = facts.where("kind = 't'").groupBy("source").agg(F.sum("n").alias("ended"))
    signs = signs.join(ended.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("sign").alias("_sign"), "leaving", "ended")
    opened = ends.where("opened IS NOT NULL").select("doc_id", "source", "state", F.explode(F.split("opened", "\n")).alias("sign"))
    opened = opened.join(signs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("sign") == F.col("_sign")), "left")
    itself = F.when(F.col("state") == "complete", 1).otherwise(0)
    habit = bound(F.coalesce("leaving", F.lit(0)) - itself, F.coalesce("ended", F.lit(0)) - itself, -SURE) > HABIT
    opened = opened.where(~habit).select("doc_id").distinct().withColumn("open", F.lit(True))

    base = facts.where("kind = 'b'").groupBy("source", "genre").agg(F.sum("n").alias("inner"), F.sum("m").alias("bare"))
    by_genre = base.groupBy("genre").agg(((F.sum("bare") * 2 >= F.sum("inner")) & (F.sum("inner") > 0)).alias("by_genre"))
    own = F.when(bound(F.col("bare"), F.col("inner"), -SURE) > 0.5, True).when(bound(F.col("bare"), F.col("inner"), SURE) < 0.5, False)
    base = base.select(F.col("source").alias("_s"), F.col("genre").alias("_g"), own.alias("by_source"))
    by_genre = by_genre.select(F.col("genre").alias("_gg"), "by_genre")

    out = ends.join(opened, "doc_id", "left")
    out = out.join(closing_lines(parts, words, starts, half_words(parts, words), never).withColumn("closing", F.lit(True)), "line", "left")
    out = out.join(words.select("word", F.lit(True).alias("known")), "word", "left").join(never.select(F.col("last").alias("word"), F.lit(True).alias("never")), "word", "left")
    out = out.join(base, out.source.eqNullSafe(base._s) & out.genre.eqNullSafe(base._g), "left").join(by_genre, out.genre.eqNullSafe(by_genre._gg), "left")
    no = F.lit(False)
    listlike = F.coalesce("by_source", "by_genre", no) & F.coalesce("known", no) & ~F.coalesce("never", no)
    complete = (F.col("state") == "complete") | (F.col("state") == "bare") & (F.coalesce("closing", no) | listlike)
    state = F.when(F.coalesce("open", no) & F.col("state").isin("complete", "bare"), "open").otherwise(F.col("state"))
    return out.select("doc_id", "source", state.alias("state"), (F.coalesce("open", no) | ~complete).alias("cut"))


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, state) of the documents whose text was cut off."""
    return verdicts(documents).where("cut").drop("cut")


def cut_rates(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """By source: documents with text, how many of them are cut, and the rate. Sources without a cut text are listed with 0."""
    whole = documents.where(F.regexp_replace("text", r"[\s\p{Z}]+", "") != "").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    some = cut.groupBy("source").agg(F.count(F.lit(1)).alias("_cut")).withColumnRenamed("source", "_source")
    joined = whole.join(some, whole.source.eqNullSafe(F.col("_source")), "left")
    n = F.coalesce("_cut", F.lit(0))
    return joined.select("source", "documents", n.alias("cut_documents"), F.round(n / F.col("documents"), 6).alias("rate"))
