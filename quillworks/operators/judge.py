"""Judgment rules: who is asked, how, and what counts as an answer.

A judge is a plug-in that answers batches of questions inside mapInPandas, never a scalar function, which a plan
could run twice.  Paragraphs are filtered, looked up in the cache and made distinct before the judge stands in the
plan; breaker and time budget belong to a partition, and ``parallel=1`` orders them as one sequential run would.
"""

from __future__ import annotations

import email.utils
import json
import re
import time
from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ruleset import Rule
from .chunk import STATE_CAP, closes_block, opens_block

ENCODED_RUN = 256
#: Fixed values of the service contract.
RETRY_STATUSES = (429, 500, 502, 503, 529)
ATTEMPTS, BACKOFF_MS, LONGEST_WAIT_MS, TIMEOUT_S = 4, 1000, 8000, 10
BREAKER = 3
USD_PER_INPUT_TOKEN = 0.042e-6
BUDGET_S, BUDGET_PER_PARAGRAPH_S = 60, 20
LOCAL_TIMEOUT_S, LOCAL_PER_PARAGRAPH_S = 180, 200


class Judge(Protocol):
    model: str

    def ask(self, text: str, questions: str) -> dict:
        """{"nouls": {rule: probability}, "input_tokens": n, "output_tokens": n, "usage_reported": bool, "attempts": n}, or raises JudgeError."""
        ...


class JudgeError(RuntimeError):
    def __init__(self, message: str, transient: bool = True):
        super().__init__(message)
        self.transient = transient


def question(rule: Rule) -> dict:
    instructions = {"what": rule.what}
    if rule.not_for:
        instructions["not_for"] = rule.not_for
    if rule.examples:
        instructions["examples"] = list(rule.examples)
    return {"type": "noul", "instructions": instructions, "criteria": {"true": rule.criteria[0], "false": rule.criteria[1]}}


def questions_json(rules: Sequence[Rule]) -> str:
    return json.dumps({r.id: question(r) for r in rules}, separators=(",", ":"), ensure_ascii=False)


def rules_for(rules: Sequence[Rule], opens: bool, closes: bool) -> list[Rule]:
    """A piece that does not open its block is not asked about openings, one that does not close it not about endings."""
    return [r for r in rules if not r.countable and (opens or r.sentence != "first") and (closes or r.sentence != "last")]


def with_questions(chunks: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds questions (JSON) and asked (rule ids): four sets at most, as literals."""
    q, ids = None, None
    for opens in (True, False):
        for closes in (True, False):
            own = rules_for(rules, opens, closes)
            when = (opens_block(F.col("part")) == opens) & (closes_block(F.col("part")) == closes)
            q = (q if q is not None else F).when(when, F.lit(questions_json(own)))
            names = F.array(*[F.lit(r.id) for r in own]) if own else F.array().cast("array<string>")
            ids = (ids if ids is not None else F).when(when, names)
    return chunks.withColumn("questions", q).withColumn("asked", ids)


def refusal(text: Column) -> Column:
    """Why a text is not sent; null if it is."""
    return (
        F.when(text.isNull(), "not text").when(T.is_blank(text), "blank").when(F.length(text) > STATE_CAP, "too long")
        .when(text.rlike(r"(?i)data:[^,\s]*;base64,"), "data address").when(text.rlike(rf"[A-Za-z0-9+/=]{{{ENCODED_RUN + 1}}}"), "encoded run")
    )


def synthetic(row: Column, ord_: Column) -> Column:
    """A probability that stands for a judge in tests: spread over [0, 1], the same in any engine."""
    return F.pmod(row * 7919 + ord_ * 104729, F.lit(10007)) / F.lit(10006.0)


def usable(nouls: Column) -> Column:
    """Answers that are probabilities."""
    return F.map_filter(nouls, lambda _, p: p.isNotNull() & ~F.isnan(p) & p.between(0, 1))


def parse_answer(body: Column) -> Column:
    """A recorded reply {model, nouls, usage} as a struct; usage that is missing counts 0 and is marked."""
    raw = F.from_json(body, "model string, nouls map<string, double>, usage struct<input_tokens: long, output_tokens: long>")
    return F.struct(
        raw["model"].alias("model"), usable(raw["nouls"]).alias("nouls"), F.coalesce(raw["usage"]["input_tokens"], F.lit(0)).alias("input_tokens"),
        F.coalesce(raw["usage"]["output_tokens"], F.lit(0)).alias("output_tokens"), raw["usage"]["input_tokens"].isNotNull().alias("usage_reported"),
    )


def wait_ms(attempt: Column, retry_after_ms: Column) -> Column:
    """Before the next try, after try number attempt: what was asked for within the cap, or a doubling ladder; null: give up."""
    ladder = F.lit(BACKOFF_MS) * F.pow(F.lit(2), attempt - 1)
    return F.when(retry_after_ms.isNull(), ladder).when(retry_after_ms <= LONGEST_WAIT_MS, F.greatest(retry_after_ms, F.lit(BACKOFF_MS)).cast("double"))


def wait_ms_py(attempt: int, retry_after_ms: float | None) -> float | None:
    if retry_after_ms is None:
        return BACKOFF_MS * 2 ** (attempt - 1)
    return None if retry_after_ms > LONGEST_WAIT_MS else max(retry_after_ms, BACKOFF_MS)


def retry_after_ms_py(header: str | None, now_ms: float) -> float | None:
    """Seconds or a date; None for anything else."""
    text = (header or "").strip()
    if re.fullmatch(r"[0-9]+", text):
        return int(text) * 1000
    try:
        at = email.utils.parsedate_to_datetime(text).timestamp() * 1000
    except (ValueError, TypeError):
        return None
    return max(0.0, at - now_ms)


def transient(kind: Column, status: Column) -> Column:
    """Whether a failure may pass: not a refusal or a missing key; HTTP by status; anything else yes."""
    return F.when(kind.isin("refused", "missing key"), False).when(kind == "http", status.isin(*RETRY_STATUSES)).otherwise(True)


def cost_usd(input_tokens: Column) -> Column:
    return input_tokens * USD_PER_INPUT_TOKEN


def budget_s(n_prose: int, local: bool = False) -> float:
    return n_prose * LOCAL_PER_PARAGRAPH_S if local else max(BUDGET_S, n_prose * BUDGET_PER_PARAGRAPH_S)


def is_loopback(host: str) -> bool:
    host = host.strip("[]").lower()
    return host in ("localhost", "::1") or bool(re.fullmatch(r"127(\.[0-9]{1,3}){3}", host))


def ask_with_retries(call, sleep=time.sleep) -> dict:  # noqa: ANN001
    """call(attempt) -> answer, or raises JudgeError; errors with retry_after_ms say how long to wait."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call(attempt) | {"attempts": attempt}
        except JudgeError as e:
            wait = wait_ms_py(attempt, getattr(e, "retry_after_ms", None))
            if not e.transient or attempt == ATTEMPTS or wait is None:
                raise
            sleep(wait / 1000)
    raise AssertionError("unreachable")


class Recorded:
    """Answers by phrase: the first (``last=False``) or last phrase that a text contains, else the default."""

    def __init__(self, phrases: Sequence[tuple[str, dict[str, float]]], default: dict[str, float], last: bool = False, model: str = "recorded"):
        self.phrases, self.default, self.last, self.model = list(phrases), default, last, model

    def ask(self, text: str, questions: str) -> dict:
        found = [n for p, n in self.phrases if p in text]
        nouls = (found[-1] if self.last else found[0]) if found else self.default
        asked = json.loads(questions)
        return {"nouls": {k: v for k, v in nouls.items() if k in asked}, "input_tokens": len(text) // 4, "output_tokens": 0, "usage_reported": True, "attempts": 1}


class Http:
    """A judge behind HTTPS.  post(url, body, headers, timeout) -> (status, headers, text) is injected in tests."""

    def __init__(self, url: str, key: str, model: str, post=None):  # noqa: ANN001
        self.url, self.key, self.model, self.post = url, key, model, post

    def ask(self, text: str, questions: str) -> dict:
        from .scrub import scrub

        if not self.key:
            raise JudgeError("no key", transient=False)

        def call(_: int) -> dict:
            body = json.dumps({"model": self.model, "state": text, "questions": json.loads(questions)}, ensure_ascii=False)
            try:
                status, headers, reply = (self.post or http_post)(self.url, body, {"authorization": f"Bearer {self.key}", "content-type": "application/json"}, TIMEOUT_S)
            except OSError as e:
                raise JudgeError(scrub(str(e), [self.key])) from None
            if status != 200:
                error = JudgeError(scrub(f"HTTP {status}: {reply[:200]}", [self.key]), status in RETRY_STATUSES)
                error.retry_after_ms = retry_after_ms_py(headers.get("retry-after"), time.time() * 1000)
                raise error
            try:
                answer = json.loads(reply)
                usage = answer.get("usage") or {}
                nouls = {k: float(v) for k, v in answer["nouls"].items() if isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1}
            except (ValueError, KeyError, AttributeError):
                raise JudgeError("the reply is not an answer") from None
            return {"nouls": nouls, "input_tokens": usage.get("input_tokens", 0), "output_tokens": usage.get("output_tokens", 0), "usage_reported": "input_tokens" in usage}

        return ask_with_retries(call)


def http_post(url: str, body: str, headers: dict, timeout: float) -> tuple[int, dict, str]:
    import urllib.error
    import urllib.request

    class NoRedirect(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):  # noqa: ANN002, ANN202
            return None

    request = urllib.request.Request(url, body.encode(), headers)  # noqa: S310
    try:
        with urllib.request.build_opener(NoRedirect).open(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode("utf-8", "replace")


class LocalChat:
    """A chat server on this machine with the panel's prompt; thoughts in its reply are cut, its cost is 0."""

    def __init__(self, base: str, model: str, post=None):  # noqa: ANN001
        from urllib.parse import urlparse

        if not is_loopback(urlparse(base).hostname or ""):
            raise ValueError("a local judge must be on this machine")
        self.url, self.model, self.post = base.rstrip("/") + "/chat/completions", model, post

    def ask(self, text: str, questions: str) -> dict:
        from .bench import ReplyError, parse_reply_py, prompt_of_questions

        asked = json.loads(questions)
        body = json.dumps({"model": self.model, "messages": [{"role": "system", "content": prompt_of_questions(asked)}, {"role": "user", "content": text}]})
        try:
            status, _, reply = (self.post or http_post)(self.url, body, {"content-type": "application/json"}, LOCAL_TIMEOUT_S)
        except OSError as e:
            raise JudgeError(str(e)) from None
        if status != 200:
            raise JudgeError(f"HTTP {status}", status in RETRY_STATUSES)
        try:
            content = re.sub(r"(?s)<think>.*?</think>", "", json.loads(reply)["choices"][0]["message"]["content"])
            readings, _, _ = parse_reply_py(content, list(asked))
        except (ValueError, KeyError, IndexError, TypeError, ReplyError):
            raise JudgeError("the reply is not an answer") from None
        if not readings:
            raise JudgeError("the reply names no rule")
        return {"nouls": {k: r["p"] for k, r in readings.items()}, "input_tokens": 0, "output_tokens": 0, "usage_reported": True, "attempts": 1}


ANSWERS = "key string, outcome string, nouls map<string, double>, model string, input_tokens long, output_tokens long, usage_reported boolean, attempts int, latency_ms long, message string"


def run_judge(rows: DataFrame, judge: Judge, parallel: int | None = None, seconds: float | None = None) -> DataFrame:
    """rows (key, text, questions) to one outcome each: answered, failed, refused or not sent.

    Refused texts never reach the judge.  A partition stops after BREAKER transient failures in a row, at once on a
    permanent one, and when its time is up; what it did not send says so.  Write the result before reading it twice.
    """
    rows = rows.select("key", "text", "questions", refusal(F.col("text")).alias("refused"))
    if parallel:
        rows = rows.repartition(parallel, "key") if parallel > 1 else rows.coalesce(1).sortWithinPartitions("key")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        fails, stopped, end = 0, None, time.monotonic() + seconds if seconds else None
        for pdf in batches:
            out = []
            for key, text, questions, refused in pdf.itertuples(index=False, name=None):
                row = {"key": key, "outcome": "not sent", "nouls": None, "model": judge.model, "input_tokens": 0, "output_tokens": 0, "usage_reported": True, "attempts": 0, "latency_ms": 0, "message": stopped}
                if stopped is None and end is not None and time.monotonic() > end:
                    stopped = row["message"] = "time is up"
                if stopped is None and refused is not None:
                    row |= {"outcome": "refused", "message": refused}
                elif stopped is None:
                    began = time.monotonic()
                    try:
                        row |= judge.ask(text, questions) | {"outcome": "answered", "message": None}
                        fails = 0
                    except JudgeError as e:
                        row |= {"outcome": "failed", "message": str(e), "attempts": getattr(e, "attempts", 1)}
                        fails = fails + 1 if e.transient else BREAKER
                        if fails >= BREAKER:
                            stopped = "stopped after failures in a row" if e.transient else "stopped by a failure that will not pass"
                    row["latency_ms"] = int((time.monotonic() - began) * 1000)
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.replace("map<string, double>", "map").split(", ")])

    return rows.mapInPandas(run, ANSWERS)


def breaker_log(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A log of calls (outcome: ok, transient, permanent, refused, hit) with what a breaker would have done.

    Adds run (transient failures in a row up to the call; refusals and cache hits neither count nor reset) and halted
    (the breaker had opened before this call).
    """
    w = Window.partitionBy(*key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = log.withColumn("_resets", F.count_if(F.col("outcome") == "ok").over(before))
    in_run = Window.partitionBy(*key, "_resets").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("run", F.count_if(F.col("outcome") == "transient").over(in_run))
    opened = F.max(((F.col("run") >= BREAKER) & (F.col("outcome") == "transient")) | (F.col("outcome") == "permanent")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("halted", F.coalesce(opened, F.lit(False))).drop("_resets")


def usage(answers: DataFrame) -> DataFrame:
    """One row of sums over a run's outcomes; retries are tries beyond the first."""
    sent = F.col("outcome").isin("answered", "failed")
    return answers.agg(
        F.count_if(sent).alias("requests"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(cost_usd(F.col("input_tokens"))), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_ms"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)), F.lit(0)).alias("retries"),
    )
