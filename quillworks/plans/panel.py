"""The bench: a panel of models over one evaluation corpus, read and scored like an arm."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bench, score

#: call(model slug, prompt, text) -> {"text", "truncated", "input_tokens", "output_tokens", "reasoning_tokens", "attempts"}, or raises.
Adapter = Callable[[str, str, str], dict]
CALLS = "repeat int, doc string, model_id string, outcome string, reply string, latency_ms double, attempts int, input_tokens long, output_tokens long, message string"


def run_calls(plan: DataFrame, adapters: dict[str, Adapter], prompt: str) -> DataFrame:
    """plan (repeat, doc, text, model_id, provider, slug, slot) to raw calls, in slot order within a partition.  Write before reading twice."""

    def run(batches: Iterator) -> Iterator:
        import time

        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                row = {"repeat": r.repeat, "doc": r.doc, "model_id": r.model_id, "outcome": "failure", "reply": None, "latency_ms": None, "attempts": 1, "input_tokens": 0, "output_tokens": 0, "message": None}
                began = time.monotonic()
                try:
                    a = adapters[r.provider](r.slug, prompt, r.text)
                    reasoning = a.get("reasoning_tokens", 0)
                    done = a.get("output_tokens", 0)
                    row |= {"outcome": "truncated" if a.get("truncated") else "reply", "reply": a.get("text", ""), "attempts": a.get("attempts", 1), "input_tokens": a.get("input_tokens", 0), "output_tokens": done + reasoning if reasoning > done else done}
                except Exception as e:  # noqa: BLE001  an adapter may fail in any way; the call is a row all the same
                    row["message"] = str(e)[:300]
                row["latency_ms"] = (time.monotonic() - began) * 1000
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLS.split(", ")])

    ordered = plan.repartition("doc").sortWithinPartitions("repeat", "doc", "slot")
    return ordered.mapInPandas(run, CALLS)


def read_calls(calls: DataFrame, rules: Sequence[str], prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with outcome, missing and cost, readings): failures, truncation and replies that cannot be read are kept apart."""
    parsed = bench.parse_reply(F.coalesce("reply", F.lit("")), list(rules))
    rows = calls.join(F.broadcast(prices.select("model_id", "input_usd", "output_usd")), "model_id", "left").withColumn("_r", F.explode(F.array(parsed)))
    outcome = bench.outcome_of(F.col("outcome") == "failure", F.col("outcome") == "truncated", F.col("_r.ok"))
    none = F.lit(list(rules))
    rows = rows.withColumn("outcome", outcome).withColumn("missing", F.when(F.col("outcome") == "answered", F.col("_r.missing")).otherwise(none))
    rows = rows.withColumn("cost_usd", bench.call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_usd"), F.col("output_usd")))
    readings = rows.where("outcome = 'answered'").select("model_id", "repeat", "doc", F.explode("_r.readings").alias("x")).select("model_id", "repeat", "doc", "x.rule", "x.flag", "x.p")
    return rows.drop("_r", "reply", "input_usd", "output_usd"), readings


def score_panel(docs: DataFrame, readings: DataFrame, countable: DataFrame, rules: DataFrame, bars: Sequence[float] = score.THRESHOLDS) -> DataFrame:
    """Overall scores of each model, repeat and decision; the countable cells (doc, rule, probability, answered) are the same for all."""
    cells = bench.cells_of(readings).withColumn("arm", F.concat_ws("/", "model_id", "repeat", "decision")).select("arm", "doc", "rule", "probability").withColumn("answered", F.lit(True))
    arms = cells.select("arm").distinct()
    shared = countable.where("answered").select("doc", "rule", "probability", "answered").crossJoin(F.broadcast(arms)).select(*cells.columns)
    every = docs.select("id", "kind", "truth").crossJoin(F.broadcast(arms))
    g = score.grid(every, cells.unionByName(shared), rules)
    return score.overall(g, rules, bars)
