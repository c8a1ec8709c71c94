"""A panel of models on the same corpus: who runs, in what order, at what price, and how its replies are read."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import median, p95, round4


class ReplyError(ValueError):
    pass


# --- prompt and reply ------------------------------------------------------

HEAD = "You judge one paragraph of prose against the rules below, each by its own description."
FOOT = 'Reply with one JSON object and nothing else: for each rule id, {"flag": true or false, "p": a number from 0 to 1}.'


def prompt_of_questions(questions: dict[str, dict]) -> str:
    out = [HEAD, ""]
    for name, q in questions.items():
        i, c = q["instructions"], q["criteria"]
        out.append(f"[{name}] {i['what']}")
        if i.get("not_for"):
            out.append(f"does not count: {i['not_for']}")
        if i.get("examples"):
            out.append(f"examples of yes: {' | '.join(i['examples'])}")
        out += [f"yes means: {c['true']}", f"no means: {c['false']}", ""]
    return "\n".join([*out, FOOT])


FENCED = r"(?s)\A`{3}[A-Za-z0-9_-]*[ \t]*\n(.*?)\n?`{3}\z"


def parse_reply_py(text: str, rules: Sequence[str]) -> tuple[dict, list[str], list[str]]:
    """(readings, missing, extra).  One fence around the whole is taken off; nothing is repaired."""
    body = text.strip()
    if m := re.match(FENCED.replace(r"\z", r"\Z"), body):
        body = m[1].strip()
    try:
        found = json.loads(body)
    except ValueError:
        raise ReplyError("the reply is not JSON") from None
    if not isinstance(found, dict):
        raise ReplyError("the reply is JSON but no object")

    def sound(x: object) -> bool:
        p = x.get("p") if isinstance(x, dict) else None
        return isinstance(x, dict) and isinstance(x.get("flag"), bool) and isinstance(p, (int, float)) and not isinstance(p, bool) and math.isfinite(p) and 0 <= p <= 1

    readings = {r: {"flag": found[r]["flag"], "p": float(found[r]["p"])} for r in rules if sound(found.get(r))}
    return readings, [r for r in rules if r not in readings], [k for k in found if k not in rules]


def reply_body(text: Column) -> Column:
    body = T.trim(text)
    inner = F.regexp_extract(body, FENCED, 1)
    return F.when(body.rlike(FENCED), T.trim(inner)).otherwise(body)


def parse_reply(text: Column, rules: Sequence[str]) -> Column:
    """Struct of ok, readings (rule to flag and p), missing, extra; nothing is cast: a flag must be the token true or false, p a number."""
    asked = F.lit(list(rules))

    def read(body: Column) -> Column:
        top = F.from_json(body, "map<string, string>")
        whole = body.rlike(r"(?s)\A\{.*\}\z") & F.try_parse_json(body).isNotNull()

        def reading(name: Column) -> Column:
            one = F.from_json(F.try_element_at(top, name), "map<string, string>")
            raw = F.coalesce(F.try_element_at(top, name), F.lit(""))
            # from_json drops the quotes of strings, so the tokens are checked in the object's own text.
            flag = F.regexp_extract(raw, r'"flag"\s*:\s*(true|false)\s*[,}]', 1)
            p = F.regexp_extract(raw, r'"p"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*[,}]', 1).try_cast("double")
            good = one.isNotNull() & flag.isin("true", "false") & p.between(0, 1)
            return F.struct(name.alias("rule"), F.when(good, flag == "true").alias("flag"), F.when(good, p).alias("p"))

        all_ = F.transform(asked, reading)
        return F.struct(
            F.coalesce(whole, F.lit(False)).alias("ok"),
            F.filter(all_, lambda r: r["p"].isNotNull()).alias("readings"),
            F.transform(F.filter(all_, lambda r: r["p"].isNull()), lambda r: r["rule"]).alias("missing"),
            F.array_sort(F.array_except(F.coalesce(F.map_keys(top), F.array().cast("array<string>")), asked)).alias("extra"),
        )

    return T.let(reply_body(text), read)


def chat_text(content: Column) -> Column:
    """A chat message's content: a string, or the texts of a list of parts."""
    parts = F.from_json(content, "array<struct<text: string>>")
    return F.when(content.rlike(r"\A\s*\["), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.from_json(F.concat(F.lit('{"t":'), content, F.lit("}")), "t string")["t"])


def billed_output(completion: Column, reasoning: Column) -> Column:
    """Some providers count reasoning within the completion, some beside it: more reasoning than completion is beside it."""
    return F.when(F.coalesce(reasoning, F.lit(0)) > completion, completion + reasoning).otherwise(completion)


# --- who runs --------------------------------------------------------------


def resolve_panel(panel: DataFrame, catalog: DataFrame, run_date: str) -> DataFrame:
    """panel (ord, model_id, provider, match, prefer, alternates) against catalog (provider, id, input_usd, output_usd, json_mode).

    The first preference that is listed, else the first alternate, else, without preferences, the first id that matches.
    """
    read = catalog.select("provider").distinct().withColumn("_read", F.lit(True))
    hits = panel.join(catalog, (panel["provider"] == catalog["provider"]) & F.regexp_like(catalog["id"], panel["match"]), "left").drop(catalog["provider"])
    place = lambda want: F.when(F.array_position(want, F.col("id")) > 0, F.array_position(want, F.col("id")))
    entry = F.struct("id", "input_usd", "output_usd", "json_mode")
    none = F.array().cast("array<string>")
    want, other = F.coalesce("prefer", none), F.coalesce("alternates", none)
    rows = hits.withColumn("_p", place(want)).withColumn("_a", place(other))
    s = rows.groupBy("ord", "model_id", "provider", "match", want.alias("prefer")).agg(
        F.array_sort(F.collect_set("id")).alias("candidates"), F.min_by(F.when(F.col("_p").isNotNull(), entry), "_p").alias("p"),
        F.min_by(F.when(F.col("_a").isNotNull(), entry), "_a").alias("a"), F.min_by(entry, "id").alias("f"),
    )
    s = s.join(F.broadcast(read), "provider", "left")
    chosen = F.coalesce("p", "a", F.when((F.size("prefer") == 0) & (F.size("candidates") > 0), F.col("f")))
    s = s.withColumn("c", chosen)
    wanted, listed = F.array_join("prefer", ", "), F.array_join("candidates", ", ")
    note = (
        F.when(F.col("_read").isNull(), F.concat(F.lit("the list of "), F.col("provider"), F.lit(" was not read")))
        .when(F.col("c").isNull() & (F.size("prefer") == 0), F.concat(F.lit(f"on {run_date} nothing is listed that matches "), F.col("match")))
        .when(F.col("c").isNull(), F.concat(wanted, F.lit(f" not listed on {run_date}; matches: "), F.when(listed == "", "none").otherwise(listed)))
        .when(F.col("p").isNull() & F.col("a").isNotNull(), F.concat(wanted, F.lit(f" not listed on {run_date}; alternate ran")))
        .when((F.size("prefer") == 0) & (F.size("candidates") > 1), F.concat(F.lit("no preference; first of "), listed))
    )
    return s.select("ord", "model_id", "provider", F.col("c.id").alias("slug"), F.col("c").isNotNull().alias("available"), "candidates", F.coalesce("c.json_mode", F.lit(False)).alias("json_mode"), F.col("c.input_usd").alias("input_usd"), F.col("c.output_usd").alias("output_usd"), note.alias("note"))


def first_price(models: DataFrame, prices: DataFrame) -> DataFrame:
    """models (slug, ...) with the first price row (ord, match, input, output) whose match the slug contains; null without one.

    Both sides are a panel's size, so the comparison of all with all is a few hundred rows.
    """
    found = models.select("slug").distinct().join(F.broadcast(prices), F.contains("slug", "match"))
    best = found.groupBy("slug").agg(F.min_by(F.struct("input", "output"), "ord").alias("p"))
    return models.join(F.broadcast(best), "slug", "left").withColumn("file_input", F.col("p.input")).withColumn("file_output", F.col("p.output")).drop("p")


def price(catalog_in: Column, catalog_out: Column, file_in: Column, file_out: Column) -> Column:
    """The catalogue's price if it has both sides, else the price file's, else null: half a price is none."""
    own = F.when(catalog_in.isNotNull() & catalog_out.isNotNull(), F.struct(catalog_in.alias("input"), catalog_out.alias("output"), F.lit("catalogue").alias("source")))
    file = F.when(file_in.isNotNull() & file_out.isNotNull(), F.struct(file_in.alias("input"), file_out.alias("output"), F.lit("price file").alias("source")))
    return F.coalesce(own, file)


def catalogue(body: Column) -> Column:
    """A provider's list (JSON, data[]) as an array of id, input_usd, output_usd, json_mode."""
    raw = F.from_json(body, "data array<struct<id: string, pricing: struct<prompt: string, completion: string>, supported_parameters: array<string>>>")["data"]

    def entry(m: Column) -> Column:
        a, b = m["pricing"]["prompt"].try_cast("double"), m["pricing"]["completion"].try_cast("double")
        both = F.coalesce((a >= 0) & (b >= 0), F.lit(False))
        return F.struct(m["id"].alias("id"), F.when(both, a).alias("input_usd"), F.when(both, b).alias("output_usd"), F.coalesce(F.array_contains(m["supported_parameters"], "response_format"), F.lit(False)).alias("json_mode"))

    return F.transform(F.filter(raw, lambda m: m["id"].isNotNull()), entry)


# --- the run ---------------------------------------------------------------


def call_plan(models: DataFrame, docs: DataFrame, repeats: int) -> DataFrame:
    """repeat, doc_index, slot, model: each document asks the models in an order turned by its index.  The panel is the small side."""
    m = models.select("model_id", (F.row_number().over(Window.orderBy("ord")) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    rows = docs.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).crossJoin(F.broadcast(m))
    return rows.withColumn("slot", F.pmod(F.col("place") - F.col("doc_index"), F.col("n")).cast("int")).drop("place", "n")


def call_cost(input_tokens: Column, output_tokens: Column, input_usd: Column, output_usd: Column) -> Column:
    """Null without a price."""
    return input_tokens * input_usd + output_tokens * output_usd


def outcome_of(failed: Column, truncated: Column, parsed: Column) -> Column:
    return F.when(failed, "failure").when(truncated, "truncated").when(~parsed, "parse failure").otherwise("answered")


def cells_of(readings: DataFrame) -> DataFrame:
    """readings (model_id, repeat, doc, rule, flag, p) as two sets of cells: the model's own flag, and its probability."""
    flag = readings.select("model_id", "repeat", "doc", "rule", F.lit("flag").alias("decision"), F.col("flag").cast("double").alias("probability"))
    return flag.unionByName(readings.select("model_id", "repeat", "doc", "rule", F.lit("p").alias("decision"), F.col("p").alias("probability")))


def without_band(readings: DataFrame, bar: float) -> DataFrame:
    """The judgment model as a row of the panel: undecided readings go, its flag is its probability at the bar."""
    return readings.where(~F.col("p").between(0.4, 0.6)).withColumn("flag", F.col("p") >= bar)


def repeat_spread(hits: DataFrame) -> DataFrame:
    """hits (model_id, repeat, hits, positives) to mean, least and most recall over repeats."""
    per = hits.groupBy("model_id", "repeat").agg((F.sum("hits") / F.sum("positives")).alias("recall"))
    return per.groupBy("model_id").agg(round4(F.avg("recall")).alias("mean"), round4(F.min("recall")).alias("least"), round4(F.max("recall")).alias("most"), F.count(F.lit(1)).alias("repeats"))


def latency(calls: DataFrame) -> DataFrame:
    """Of calls that came back; failures have none."""
    return calls.where("outcome <> 'failure'").groupBy("model_id").agg(F.count(F.lit(1)).alias("calls"), round4(median(F.col("latency_ms"))).alias("median_ms"), p95(F.col("latency_ms")).alias("p95_ms"))


def unanswered_by_rule(calls: DataFrame) -> DataFrame:
    return calls.select("model_id", F.explode("missing").alias("rule")).groupBy("model_id", "rule").agg(F.count(F.lit(1)).alias("unanswered"))


def totals(calls: DataFrame) -> DataFrame:
    """One row: calls, failures, retries, money of the priced, and which models have no price."""
    return calls.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("outcome") == "failure").alias("failures"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"),
        F.sum("cost_usd").alias("priced_usd"), F.array_sort(F.collect_set(F.when(F.col("cost_usd").isNull(), F.col("model_id")))).alias("unpriced"),
    )
