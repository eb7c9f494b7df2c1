"""The citation gate: segmented answers verified against the context they were given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Most characters of a quotation, most share of an answer and of a unit, and whether edition and url are required."""

    max_chars: int = 400
    answer_share: float = 0.25
    unit_share: float = 0.5
    attribution: bool = True


def context_map(context: DataFrame, order: str = "position") -> DataFrame:
    """One row per answer and locator; of repeated locators the last by order counts."""
    last = Window.partitionBy("answer_id", "locator").orderBy(F.col(order).desc())
    return context.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


FATAL = ("quotation_unknown_locator", "quotation_not_exact", "claim_without_citation")


def judged_segments(segments: DataFrame, context: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every segment, judged once: segments with code (what is wrong with a quotation, null if it stands), kept and missing (a claim's citations
    that are in the context and those that are not, as written).

    segments: answer_id, segment, kind, text, citations, locator. context: as of context_map, with text, edition, url.
    In order: unknown locator and inexact text are fatal; too long, unattributed, more than the unit's share and more than the
    answer's share are dropped. The shares see only what passed before. Of the answer's share quotations are dropped from
    the end: the i-th survives iff those up to it fit beside the prose. Lengths are in code points. All locators of an answer, quoted or
    cited, meet its context in one join.
    """
    quotes, claims = F.col("kind") == "quotation", F.col("kind") == "claim"
    named = F.when(quotes, F.array("locator")).when(claims, F.col("citations"))
    asked = segments.select("answer_id", "segment", "kind", "text", "citations", "locator", F.posexplode_outer(named).alias("_i", "_named"))
    units = context.select("answer_id", F.col("locator").alias("_named"), F.coalesce("text", F.lit("")).alias("_unit"), "edition", "url", F.lit(True).alias("_known"))
    rows = asked.join(units, ["answer_id", "_named"], "left").withColumn("_quote", F.coalesce("text", F.lit(""))).withColumn("_chars", F.length("_quote"))
    unattributed = (F.coalesce("edition", F.lit("")) == "") | (F.coalesce("url", F.lit("")) == "")
    early = (
        F.when(~quotes, None)
        .when(F.col("_known").isNull(), "quotation_unknown_locator")
        .when(~F.contains("_unit", "_quote"), "quotation_not_exact")
        .when(F.col("_chars") > limits.max_chars, "quotation_too_long")
        .when(F.lit(limits.attribution) & unattributed, "quotation_missing_attribution")
    )
    rows = rows.withColumn("code", early)
    stands = quotes & F.col("code").isNull()
    counted = F.sum(F.when(stands, F.col("_chars")).otherwise(0))
    over = (F.length("_unit") > 0) & (counted.over(Window.partitionBy("answer_id", "_named")) / F.length("_unit") > limits.unit_share)
    rows = rows.withColumn("_over", over).withColumn("code", F.when(stands & F.col("_over"), "quotations_exceed_unit_ratio").otherwise(F.col("code")))
    answer = Window.partitionBy("answer_id")
    prose = F.sum(F.when(~quotes & (F.coalesce("_i", F.lit(0)) == 0), F.col("_chars")).otherwise(0)).over(answer)
    upto = counted.over(answer.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_prose": prose, "_upto": upto})
    whole = F.col("_prose") + F.col("_upto")
    fits = (whole == 0) | (F.col("_upto") / F.when(whole == 0, 1).otherwise(whole) <= limits.answer_share)
    rows = rows.withColumn("code", F.when(stands & ~fits, "quotations_exceed_answer_ratio").otherwise(F.col("code")))

    def listed(c: Column) -> Column:
        cited = F.when(claims & c & F.col("_named").isNotNull(), F.struct("_i", "_named"))
        return F.transform(F.sort_array(F.collect_list(cited)), lambda x: x["_named"])

    alike = ("kind", "text", "citations", "locator", "code")
    one = rows.groupBy("answer_id", "segment").agg(*[F.first(c).alias(c) for c in alike], listed(F.col("_known").isNotNull()).alias("kept"), listed(F.col("_known").isNull()).alias("missing"))
    return one.select("answer_id", "segment", *alike, "kept", "missing")


def judged_quotations(segments: DataFrame, context: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The quotations of judged_segments: (answer_id, segment, locator, quote, code)."""
    rows = judged_segments(segments, context, limits).where("kind = 'quotation'")
    return rows.select("answer_id", "segment", "locator", F.coalesce("text", F.lit("")).alias("quote"), "code")


def judged_claims(segments: DataFrame, context: DataFrame) -> DataFrame:
    """The claims of judged_segments: (answer_id, segment, kept, missing)."""
    return judged_segments(segments, context).where("kind = 'claim'").select("answer_id", "segment", "kept", "missing")


def violations_of(judged: DataFrame) -> DataFrame:
    """(answer_id, segment, code, locator, fatal) of every violation in judged_segments."""
    fault = lambda code, locator: F.struct(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), locator.alias("locator"))
    nowhere = F.lit(None).cast("string")
    quoted = F.when(F.col("code").isNotNull(), F.array(fault(F.col("code"), F.col("locator"))))
    strays = F.transform("missing", lambda x: fault("citation_not_in_context", x))
    bare = F.when(F.size("kept") == 0, F.array(fault("claim_without_citation", nowhere)))
    none = F.array().cast("array<struct<code:string,locator:string>>")
    faults = F.when(F.col("kind") == "quotation", F.coalesce(quoted, none)).when(F.col("kind") == "claim", F.concat(strays, F.coalesce(bare, none)))
    rows = judged.select("answer_id", "segment", F.explode(faults).alias("_f")).select("answer_id", "segment", "_f.code", "_f.locator")
    return rows.withColumn("fatal", F.col("code").isin(*FATAL))


def violations(segments: DataFrame, context: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """violations_of segments, judged against their context."""
    return violations_of(judged_segments(segments, context, limits))


def _status(fatal: Column, dropped: Column) -> Column:
    return F.when(fatal > 0, "failed").when(dropped == 0, "pass").otherwise("repaired")


def _faults() -> tuple[Column, Column]:
    """(fatal, dropped): how many violations of either sort a judged segment has."""
    inexact, bare = F.col("code").isin(*FATAL), (F.col("kind") == "claim") & (F.size("kept") == 0)
    fatal = F.coalesce(inexact, F.lit(False)).cast("int") + bare.cast("int")
    strays = F.when(F.col("kind") == "claim", F.size("missing")).otherwise(0)
    return fatal, (F.col("code").isNotNull() & ~F.coalesce(inexact, F.lit(False))).cast("int") + strays


def verdicts_of(judged: DataFrame) -> DataFrame:
    """(answer_id, fatal, dropped, status) of judged_segments: failed with a fatal violation, pass without any, else repaired. Connecting segments pass."""
    fatal, dropped = _faults()
    per = judged.groupBy("answer_id").agg(F.sum(fatal).alias("fatal"), F.sum(dropped).alias("dropped"))
    return per.withColumn("status", _status(F.col("fatal"), F.col("dropped")))


def verdicts(segments: DataFrame, found: DataFrame) -> DataFrame:
    """verdicts_of by violations that were found before."""
    answers = segments.select("answer_id").distinct()
    per = found.groupBy("answer_id").agg(F.count_if("fatal").alias("fatal"), F.count_if(~F.col("fatal")).alias("dropped"))
    rows = answers.join(per, "answer_id", "left").select("answer_id", F.coalesce("fatal", F.lit(0)).alias("fatal"), F.coalesce("dropped", F.lit(0)).alias("dropped"))
    return rows.withColumn("status", _status(F.col("fatal"), F.col("dropped")))


def repaired_segments(segments: DataFrame, context: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The segments that remain of answers that did not fail, claims with their kept citations only."""
    fatal, dropped = _faults()
    answer = Window.partitionBy("answer_id")
    rows = judged_segments(segments, context, limits).withColumns({"_fatal": F.sum(fatal).over(answer), "_dropped": F.sum(dropped).over(answer)})
    rows = rows.withColumn("status", _status(F.col("_fatal"), F.col("_dropped"))).where("_fatal = 0 AND code IS NULL")
    return rows.select("answer_id", "status", "segment", "kind", "text", F.when(F.col("kind") == "claim", F.col("kept")).otherwise(F.col("citations")).alias("citations"), "locator")


def refusal_correctness(results: DataFrame) -> DataFrame:
    """One row over results (question_id, expects_refusal, refused): refusals that were due, answers that were due, and the share of either that came.

    A null refused counts as an answer, a null expects_refusal as no expectation at all. Without a question of a sort its share is null.
    """
    known = results.where("expects_refusal IS NOT NULL").select("expects_refusal", F.coalesce("refused", F.lit(False)).alias("refused"))
    due, answered = F.count_if("expects_refusal"), F.count_if(~F.col("expects_refusal"))
    right, wrong = F.count_if(F.col("expects_refusal") & F.col("refused")), F.count_if(~F.col("expects_refusal") & F.col("refused"))
    counts = known.agg(due.alias("refusals_due"), right.alias("refused_rightly"), answered.alias("answers_due"), wrong.alias("refused_wrongly"))
    share = F.try_divide(F.col("refused_rightly") + F.col("answers_due") - F.col("refused_wrongly"), F.col("refusals_due") + F.col("answers_due"))
    return counts.select("*", F.try_divide("refused_rightly", "refusals_due").alias("refusal_correctness"), F.try_divide(F.col("answers_due") - F.col("refused_wrongly"), "answers_due").alias("answer_rate"), share.alias("accuracy"))


def gate_metrics(segments: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ratios: quotations that are exact, citations that are in the context, and claims that keep a citation."""
    quotes = F.count_if(F.col("kind") == "quotation")
    claims = F.count_if(F.col("kind") == "claim")
    base = segments.agg(quotes.alias("quotations"), claims.alias("claims"), F.sum(F.when(F.col("kind") == "claim", F.size(F.coalesce("citations", F.array().cast("array<string>")))).otherwise(0)).alias("citations"))
    faults = found.agg(F.count_if(F.col("code").isin("quotation_unknown_locator", "quotation_not_exact")).alias("inexact"), F.count_if(F.col("code") == "citation_not_in_context").alias("stray"), F.count_if(F.col("code") == "claim_without_citation").alias("bare"))
    one = base.join(F.broadcast(faults))
    return one.select("quotations", "claims", "citations", F.try_divide(F.col("quotations") - F.col("inexact"), "quotations").alias("quote_fidelity"), F.try_divide(F.col("citations") - F.col("stray"), "citations").alias("citation_validity"), F.try_divide(F.col("claims") - F.col("bare"), "claims").alias("groundedness"))
