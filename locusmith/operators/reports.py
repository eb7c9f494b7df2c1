"""Reports of an evaluation: small collected frames as JSON and Markdown, with where they come from, and what a fidelity measurement says."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from locusmith.operators.metrics import Z


@dataclass(frozen=True)
class Report:
    """One evaluation of one embedding space. Rows are those of metrics: intervals (slice, metric, n, mean, low, high, status), questions
    (question_id, slice and metric columns), latency (percentile to milliseconds) and truncation (source_id, passages, truncated)."""

    identity: str
    corpus_hash: str
    gold_hash: str
    seed: int
    resamples: int
    excluded: list[str] = field(default_factory=list)
    intervals: list[dict] = field(default_factory=list)
    questions: list[dict] = field(default_factory=list)
    latency: dict[str, float] = field(default_factory=dict)
    truncation: list[dict] = field(default_factory=list)


def rows_of(df: DataFrame | None, *order: str) -> list[dict]:
    """A summary frame (slices, questions of an authored set, sources) as rows in order."""
    return [] if df is None else [r.asDict() for r in df.orderBy(*order).collect()]


def made(identity: str, corpus_hash: str, gold_hash: str, intervals: DataFrame, questions: DataFrame, latency: Mapping[str, float], truncation: DataFrame | None = None, excluded: Sequence[str] = (), seed: int = 0, resamples: int = 9999) -> Report:
    """A report of collected frames. A number that is not finite is an error: JSON has no word for it."""
    report = Report(identity, corpus_hash, gold_hash, seed, resamples, sorted(excluded), rows_of(intervals, "slice", "metric"), rows_of(questions, "question_id"), dict(latency), rows_of(truncation, "source_id"))
    as_json(report)
    return report


def as_json(report: Report) -> str:
    return json.dumps(asdict(report), ensure_ascii=False, indent=2, allow_nan=False) + "\n"


def from_json(text: str) -> Report:
    """A report read back; unknown or missing fields are an error."""
    return Report(**json.loads(text))


def _cell(value: object) -> str:
    return "–" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def _table(header: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    return ["| " + " | ".join(header) + " |", "|" + "---|" * len(header), *("| " + " | ".join(map(_cell, row)) + " |" for row in rows), ""]


def as_markdown(report: Report, comparison: Sequence[Mapping] | None = None) -> str:
    """The report for readers: provenance, means with their intervals, every question, latency, truncation, and the comparison if there is one."""
    lines = [f"# Evaluation of `{report.identity}`", "", f"- corpus `{report.corpus_hash}`", f"- gold set `{report.gold_hash}`", f"- intervals: 95 % percentile bootstrap over questions, {report.resamples} resamples, seed {report.seed}"]
    lines += [f"- left out: {', '.join(report.excluded) or 'no question'}", "- not measured: generation, cost, latency from end to end", "", "## Means", ""]
    lines += _table(["slice", "metric", "n", "mean", "low", "high", "status"], [[r[k] for k in ("slice", "metric", "n", "mean", "low", "high", "status")] for r in report.intervals])
    if report.questions:
        names = [k for k in report.questions[0] if k != "question_id"]
        lines += ["## Questions", "", *_table(["question", *names], [[q["question_id"], *(q[n] for n in names)] for q in report.questions])]
    lines += ["## Latency of retrieval", "", *(f"- {name}: {value:.2f} ms" for name, value in sorted(report.latency.items())), ""]
    if report.truncation:
        lines += ["## Passages cut by the context limit", "", *_table(["source", "passages", "cut"], [[r[k] for k in ("source_id", "passages", "truncated")] for r in report.truncation])]
    if comparison:
        names = list(comparison[0])
        lines += ["## The two best of each slice", "", "Required n is the whole number of paired questions, not what is still missing; the choice is exploratory.", "", *_table(names, [[row[n] for n in names] for row in comparison])]
    return "\n".join(lines)


def comparison_json(rows: Sequence[Mapping], reports: Sequence[Report], metric: str = "recall@10") -> str:
    """The comparison of metrics.compared with the provenance its reports share; reports of different corpora or gold sets are refused."""
    sets = {(r.corpus_hash, r.gold_hash) for r in reports}
    if len(reports) < 2 or len(sets) != 1:
        raise ValueError("a comparison needs two reports of one corpus and one gold set")
    head = {"corpus_hash": reports[0].corpus_hash, "gold_hash": reports[0].gold_hash, "identities": [r.identity for r in reports], "metric": metric, "confidence": 0.95, "power": 0.8, "z": round(Z, 6)}
    return json.dumps({**head, "slices": [dict(r) for r in rows]}, ensure_ascii=False, indent=2, allow_nan=False) + "\n"


def write(folder: str | Path, stem: str, report: Report, comparison: Sequence[Mapping] | None = None, others: Sequence[Report] = ()) -> list[Path]:
    """Writes <stem>.json, <stem>.md and, with a comparison, <stem>.comparison.json; the stem is a time, and an existing file is never replaced."""
    files = {f"{stem}.json": as_json(report), f"{stem}.md": as_markdown(report, comparison)}
    if comparison is not None:
        files[f"{stem}.comparison.json"] = comparison_json(comparison, [report, *others])
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        with (root / name).open("x", encoding="utf-8") as out:
            out.write(text)
    return [root / name for name in files]


# From what agreement with the original an unquantized export counts as right, and below what a quantized one as broken.
CONTROL_RIGHT, QUANTIZED_BROKEN = 0.999, 0.9


def fidelity_lines(result: Mapping[str, object]) -> list[str]:
    """What a fidelity measurement establishes, line by line, and what it does not.

    result: model_id, precision, error (of the export), artifact_bytes, declared_dimensions, observed_dimensions, probes, min_cosine, mean_cosine,
    control_cosine (of the unquantized export), agreement, mean_margin, perturbation, margins_below, load_seconds, query_seconds; what was not measured is null.
    """
    get = result.get
    if get("error"):
        return [f"{get('model_id')}: no export ({get('error')})", "  This is no low score: without an export the model cannot serve at all."]
    lines = [f"{get('model_id')}: exported as {get('precision')}"]
    if get("artifact_bytes") is not None:
        lines.append(f"  size: {get('artifact_bytes') / 1e6:,.0f} MB")
    if get("declared_dimensions") != get("observed_dimensions"):
        lines.append(f"  WRONG dimensions: {get('observed_dimensions')} instead of the declared {get('declared_dimensions')}; this is another model")
    if get("min_cosine") is not None:
        lines.append(f"  cosine with the original: least {get('min_cosine'):.5f}, mean {get('mean_cosine'):.5f}, {get('probes')} probes")
    control, mean = get("control_cosine"), get("mean_cosine")
    if get("precision") == "fp32":
        lines.append("  control: not needed, nothing was quantized")
    elif control is None:
        lines.append("  control: missing, so a low cosine cannot be put down to quantizing or to the export")
    else:
        lines.append(f"  control: unquantized against original {control:.5f}")
        if control > CONTROL_RIGHT and mean is not None and mean < QUANTIZED_BROKEN:
            lines.append("  BROKEN by quantizing: the same export is right without it, so this model needs another precision")
        elif control < CONTROL_RIGHT:
            lines.append("  FAULT of the export: it differs before anything is quantized, so the figures say nothing about the model")
    if get("agreement") is not None:
        lines.append(f"  same nearest in the same order: {get('agreement'):.0%} of the probes")
        margin, moved = get("mean_margin"), get("perturbation")
        if margin is not None and moved is not None:
            lines.append(f"  mean margin {margin:.4f}, mean movement {moved:.4f}")
            weak, probes = get("margins_below") or 0, get("probes")
            if weak and weak == probes:
                lines.append("  NO POWER: every margin is below the movement, so the order says nothing either way")
            elif weak:
                lines.append(f"  {weak} of {probes} margins are below the movement; there the order is left to chance")
            lines.append("  Not to be compared between models: each is held against its own margins and movement.")
    if get("load_seconds") is not None:
        lines.append(f"  loads in {get('load_seconds'):.1f} s, one query takes {get('query_seconds'):.3f} s")
    return [*lines, "  Not established: how well either of them retrieves."]
