"""Reports: small tables to JSON and Markdown, large ones to Parquet."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame

LEAST_FOR_RATE = 10
MAX_ROWS = 100_000
#: Rules whose wording was tuned on the packaged corpus.
TUNED = ("not_x_but_y", "tricolon", "first_x_that", "restating_closer", "pullquote_fragment")


def counted(k: int | None, n: int | None) -> str:
    """k of n always, with a rate only from ten on."""
    if k is None or not n:
        return "n/a"
    return f"{k} of {n}" + (f" = {k / n:.2f}" if n >= LEAST_FOR_RATE else "")


def with_interval(k: int, n: int, low: float | None, high: float | None) -> str:
    text = counted(k, n)
    return text if low is None or high is None or n < LEAST_FOR_RATE else f"{text} ({low:.2f} to {high:.2f})"


def money(usd: float | None) -> str:
    """n/a is not 0."""
    if usd is None:
        return "n/a"
    return f"${usd:.6f}" if abs(usd) < 0.01 else f"${usd:.4f}"


def number(x: float | None, places: int = 0) -> str:
    return "n/a" if x is None else f"{x:.{places}f}"


def tuning_note(classes: Sequence[str]) -> str:
    own = [r for r in TUNED if r in classes]
    return f"Wording tuned on the same corpus: {', '.join(own)}." if own else "No rule's wording was tuned on this corpus."


def markdown_table(header: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    return "\n".join(["| " + " | ".join(r) + " |" for r in (header, ["---"] * len(header), *rows)])


def rows_of(df: DataFrame, order: Sequence[str]) -> list[dict]:
    """A report's table on the driver; it is a few rows by rule or arm, and refused if it is not."""
    rows = df.orderBy(*order).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError("too many rows for a report; write them as Parquet")
    return [r.asDict(recursive=True) for r in rows]


def render(tables: dict[str, DataFrame], title: str, bar: float = 0.7) -> tuple[dict, str]:
    """(JSON object, Markdown) of an evaluation's tables."""
    out = {k: rows_of(tables[k], o) for k, o in (("overall", ["arm", "threshold"]), ("classes", ["arm", "class", "threshold"]), ("per_rule", ["arm", "rule", "threshold"]), ("calibration", ["arm", "bucket"]), ("summary", ["arm"]))}
    classes = sorted({r["rule"] for r in out["per_rule"]})
    text = [f"# {title}", "", tuning_note(classes), "", "## Overall", ""]
    text.append(markdown_table(("Arm", "Threshold", "Faults caught", "Clean flagged", "Off-rule flags"), [
        (r["arm"], f"{r['threshold']:.2f}", counted(r["hits"], r["positives"]), with_interval(r["fp_docs"], r["n_clean"], r["fp_doc_low"], r["fp_doc_high"]), str(r["off_rule_flags"])) for r in out["overall"]
    ]))
    text += ["", f"## Rules at {bar:.2f}", "", markdown_table(("Arm", "Rule", "Caught", "False alarms"), [
        (r["arm"], r["rule"], with_interval(r["hits"], r["n_positive"], r["low"], r["high"]), counted(r["fps"], r["n_clean"])) for r in out["per_rule"] if abs(r["threshold"] - bar) < 1e-9
    ])]
    text += ["", "## Calls", "", markdown_table(("Arm", "Documents", "Requests", "Median ms", "p95 ms", "Cost"), [
        (r["arm"], str(r["documents"]), str(r["requests"]), number(r["median_ms"]), number(r["p95_ms"]), money(None if r["usd_e8"] is None else r["usd_e8"] / 1e8)) for r in out["summary"]
    ])]
    return out | {"classes_list": classes}, "\n".join(text) + "\n"


def write(folder: str, tables: dict[str, DataFrame], title: str, big: dict[str, DataFrame] | None = None, private: bool = True) -> None:
    """scores.json, tables.md and a Parquet table for each of big.  A new folder is kept out of version control."""
    os.makedirs(folder, exist_ok=True)
    ignore = os.path.join(folder, ".gitignore")
    if private and not os.path.exists(ignore):
        with open(ignore, "x", encoding="utf-8") as f:
            f.write("*\n")
    found, text = render(tables, title)
    with open(os.path.join(folder, "scores.json"), "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False, indent=1)
    with open(os.path.join(folder, "tables.md"), "w", encoding="utf-8") as f:
        f.write(text)
    for name, df in (big or {}).items():
        df.write.mode("overwrite").parquet(os.path.join(folder, "raw", name))


def panel_markdown(totals: dict, scores: Sequence[dict], latency: Sequence[dict]) -> str:
    """A bench report of collected tables."""
    by = {r["model_id"]: r for r in latency}
    head = f"{totals['calls']} calls, {totals['failures']} failures, {totals['retries']} retries, {money(totals['priced_usd'])} for models with a price."
    if totals["unpriced"]:
        head += f" No price: {', '.join(totals['unpriced'])}."
    rows = [(r["arm"], f"{r['threshold']:.2f}", counted(r["hits"], r["positives"]), counted(r["fp_docs"], r["n_clean"]), str(r["off_rule_flags"]), number(by.get(r["arm"].split("/")[0], {}).get("median_ms"))) for r in scores]
    return "\n".join(["# Panel", "", head, "", markdown_table(("Model", "Threshold", "Caught", "Clean flagged", "Off-rule", "Median ms"), rows), ""])
