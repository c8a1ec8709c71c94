"""Recorded answers, found by the phrase that a text contains."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PHRASES = 100_000


def match_states(states: DataFrame, recorded: DataFrame, last: bool = True) -> DataFrame:
    """states (doc_id, text) with ord of the last (or first) recorded (ord, match) that the text contains; null without one.

    A recording is a small file (a megabyte at most), so its phrases travel to the texts as one automaton; each text
    is read once however many phrases there are.
    """
    phrases = [(r[0], r[1]) for r in recorded.select("ord", "match").limit(MAX_PHRASES + 1).collect()]
    if len(phrases) > MAX_PHRASES:
        raise ValueError(f"a recording holds at most {MAX_PHRASES} phrases")
    sent = states.sparkSession.sparkContext.broadcast(phrases)
    better = max if last else min

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        always = None
        for ord_, phrase in sent.value:
            if phrase == "":
                always = ord_ if always is None else better(always, ord_)
            elif phrase is not None:
                machine.add_word(phrase, better(ord_, machine.get(phrase, ord_)))
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column(1):
                hits = [v for _, v in machine.iter(text.as_py() or "")] if len(machine) else []
                if always is not None:
                    hits.append(always)
                out.append(better(hits) if hits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "ord"])

    return states.select("doc_id", "text").mapInArrow(run, "doc_id long, ord long")


def recording_of(outcomes: DataFrame, texts: DataFrame, run_date: str | None = None, limit: int = 20_000) -> dict:
    """A recording of judged paragraphs: outcomes as run_judge() gives them, texts (key, text).

    Shorter texts come first, so that in a growing draft the longest one that it contains answers.  One failure is a
    failure of the whole, as a recording with holes would answer for the wrong paragraph.
    """
    if not outcomes.where("outcome <> 'answered'").limit(1).isEmpty():
        raise ValueError("a paragraph was not answered, so nothing is recorded")
    rows = outcomes.join(texts, "key").selectExpr("text", "nouls", "input_tokens", "latency_ms").orderBy(F.length("text"), "text").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a recording holds at most {limit} paragraphs")
    responses = [{"match": r.text, "nouls": dict(sorted(r.nouls.items())), "inputTokens": r.input_tokens, "latencyMs": r.latency_ms} for r in rows]
    return ({"measured": True, "runDate": run_date} if run_date else {}) | {"default": {"nouls": {}}, "responses": responses}
