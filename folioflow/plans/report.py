"""The scoring report as Markdown (SNK04), from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioflow.operators.scoring import OUTCOMES


def percent(part: int, whole: int) -> str:
    """PRJ20: one decimal, a dash where whole is 0."""
    return "—" if whole == 0 else f"{100 * part / whole:.1f}%"


def shown(value: str | None, width: int = 50) -> str:
    return "null" if value is None else value[:width].replace("|", "\\|").replace("\n", " ")


def markdown(stats: DataFrame, wrong: DataFrame, total_wrong: int, title: str) -> str:
    """``stats`` as of ``scoring.overlay_stats``, ``wrong`` as of ``scoring.mismatches``."""
    rows = sorted(stats.collect(), key=lambda r: (r.overlay, str(r.group)))
    overall = next((r for r in rows if r.overlay == "overall"), None)
    lines = [f"# {title}", ""]
    if overall:
        absent = overall.hallucination + overall.correct_abstain
        lines += [f"Accuracy {overall.correct}/{overall.n} = {percent(overall.correct, overall.n)}, hallucination {overall.hallucination}/{absent} = {percent(overall.hallucination, absent)}", ""]
    lines += ["| group | n | " + " | ".join(OUTCOMES) + " | accuracy |", "|---" * (len(OUTCOMES) + 3) + "|"]
    for r in rows:
        lines.append(f"| {r.overlay}{'' if r.group is None else ': ' + r.group} | {r.n} | " + " | ".join(str(r[o]) for o in OUTCOMES) + f" | {percent(r.correct, r.n)} |")
    lines += ["", "## Mismatches", "", "| document | field | outcome | predicted | gold |", "|---|---|---|---|---|"]
    listed = wrong.collect()
    lines += [f"| {r[0]} | {r.field} | {r.outcome} | {shown(r.pred_json)} | {shown(r.gold_json)} |" for r in listed]
    if total_wrong > len(listed):
        lines.append(f"| … {total_wrong - len(listed)} more | | | | |")
    return "\n".join(lines) + "\n"
