"""Scores, judgments, cache, calls and panel over labels, events and documents.

The judge is synthetic: a probability computed from ids, the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prng, stats
from ..operators import bench, cache, flags, judge, score, seed, twins
from ..sources.ruleset import Rule, Ruleset, Seed, merge, rules_frame, select
from .common import documents, round4_sql, table

RULES = "rule string, ord int, is_countable boolean, is_judgment boolean, guaranteed boolean, inert_on_clean string"
RULE_ROWS = [("r0", 0, True, False, True, None), ("r1", 1, True, False, True, "its word list is empty"), ("r2", 2, False, True, False, None), ("r3", 3, False, True, False, None)]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULE_ROWS, RULES)


def eval_docs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents under arms A (nothing asked, all 0) and C (the synthetic judge); low quality is a planted fault."""
    seeded = F.col("quality") == 0
    one = table(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("id"), F.when(seeded, "seeded").otherwise("clean").alias("kind"),
        F.when(seeded, F.concat(F.lit("r"), (F.col("doc_id") % 4).cast("string"))).alias("truth"), ((F.col("doc_id") * 37) % 500).cast("double").alias("latency_ms"),
        F.lit(1).cast("long").alias("requests"), (F.col("doc_id") % 3 == 0).cast("long").alias("retries"), F.lit(0).cast("long").alias("unanswered"),
        (F.col("doc_id") % 100 + 50).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(True).alias("usage_reported"),
    )
    both = one.withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("C"))))
    return both.withColumn("cost_usd", judge.cost_usd(F.col("input_tokens")))


def cells(spark: SparkSession, d: str) -> DataFrame:
    g = eval_docs(spark, d).select("arm", "doc_id", F.col("id").alias("doc")).crossJoin(F.broadcast(rules(spark).select("rule", "ord")))
    g = g.where((F.col("arm") == "A") | ((F.col("doc_id") + F.col("ord")) % 11 != 0))
    p = F.when(F.col("arm") == "A", F.lit(0.0)).otherwise(judge.synthetic(F.col("doc_id"), F.col("ord")))
    return g.select("arm", "doc", "rule", p.alias("probability"), F.lit(True).alias("answered"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    return score.grid(eval_docs(spark, d), cells(spark, d), rules(spark))


GRID = """
rules(rule, ord, countable, guaranteed, inert) AS (VALUES ('r0', 0, true, true, NULL), ('r1', 1, true, true, 'x'), ('r2', 2, false, false, NULL), ('r3', 3, false, false, NULL)),
docs AS (
  SELECT a.arm, l.doc_id, 'doc-' || l.doc_id AS doc, CASE WHEN quality = 0 THEN 'seeded' ELSE 'clean' END AS kind, CASE WHEN quality = 0 THEN 'r' || (doc_id % 4) END AS truth,
         CAST((doc_id * 37) % 500 AS DOUBLE) AS ms, doc_id % 3 = 0 AS retried, doc_id % 100 + 50 AS tokens
  FROM labels l, (VALUES ('A'), ('C')) a(arm)),
grid AS (
  SELECT arm, doc, kind, truth, rule, ord, countable, arm = 'A' OR (doc_id + ord) % 11 <> 0 AS answered,
         CASE WHEN arm = 'A' OR (doc_id + ord) % 11 = 0 THEN 0.0::DOUBLE ELSE ((doc_id * 7919 + ord * 104729) % 10007) / 10006.0::DOUBLE END AS p,
         kind = 'seeded' AND coalesce(truth = rule, false) AS own
  FROM docs, rules),
bars(threshold) AS (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE))"""


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {round4_sql(f'CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)')} END"


def wilson_sql(k: str, n: str, low: str, high: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    z2 = "(1.96::DOUBLE * 1.96::DOUBLE)"
    under = f"(1 + {z2} / {n})"
    center = f"(({p} + {z2} / (2 * CAST({n} AS DOUBLE))) / {under})"
    half = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * CAST({n} AS DOUBLE) * {n})) / {under})"
    return (
        f"CASE WHEN {n} > 0 THEN {round4_sql(f'greatest(0.0::DOUBLE, {center} - {half})')} END AS {low}, "
        f"CASE WHEN {n} > 0 THEN {round4_sql(f'least(1.0::DOUBLE, {center} + {half})')} END AS {high}"
    )


def per_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return score.per_rule(grid(spark, d))


def overall_scores(spark: SparkSession, d: str) -> DataFrame:
    return score.overall(grid(spark, d), rules(spark))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    return score.by_class(grid(spark, d), rules(spark))


def multi_grain_scores(spark: SparkSession, d: str) -> DataFrame:
    return score.multi_grain(grid(spark, d), rules(spark))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return score.calibration(grid(spark, d))


def unanswered_cells(spark: SparkSession, d: str) -> DataFrame:
    return score.unanswered_cells(grid(spark, d))


def misses(spark: SparkSession, d: str) -> DataFrame:
    return score.misses(grid(spark, d))


def false_positives(spark: SparkSession, d: str) -> DataFrame:
    return score.false_positives(grid(spark, d))


def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    return score.summary(eval_docs(spark, d))


def post_odds(spark: SparkSession, d: str) -> DataFrame:
    return score.post_odds(overall_scores(spark, d), spark.createDataFrame([("A", 0), ("C", 1)], "arm string, ord int"))


def duplicate_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each cell written twice; the later one counts."""
    one = cells(spark, d).where("arm = 'C'")
    two = one.withColumn("seq", F.lit(1)).unionByName(one.withColumn("probability", 1 - F.col("probability")).withColumn("seq", F.lit(2)))
    return score.last_cells(two).select("doc", "rule", F.round("probability", 9).alias("probability"))


def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id") % 13, F.col("doc_id") % 29 + 13
    w = stats.wilson(k, n)
    return documents(spark, d).select("doc_id", w["low"].alias("low"), w["high"].alias("high"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    bar = (F.col("doc_id") % 10) / 10
    return documents(spark, d).select("doc_id", F.array_join(F.transform(score.thresholds_column(bar), lambda x: F.round(x * 10).cast("int").cast("string")), ",").alias("bars"))


# --- judgments ---------------------------------------------------------------


def readings(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic judge on every document as one paragraph; a tenth have no answer to a rule."""
    ids = ("r2", "r3")
    p = F.map_from_entries(F.array(*[F.struct(F.lit(r).alias("k"), judge.synthetic(F.col("doc_id"), F.lit(i + 2)).alias("v")) for i, r in enumerate(ids)]))
    p = F.map_filter(p, lambda k, v: ~((F.col("doc_id") % 10 == 0) & (k == "r3")))
    answers = documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.lit(1).alias("line"), p.alias("nouls"))
    return flags.readings_of(answers, spark.createDataFrame([(r, f"message {r}") for r in ids], "rule string, message string"))


READINGS = """
readings AS (
  SELECT 'doc-' || doc_id AS file, CAST(1 AS INTEGER) AS line, r.rule, ((doc_id * 7919 + r.ord * 104729) % 10007) / 10006.0::DOUBLE AS probability, 'message ' || r.rule AS message
  FROM documents, (VALUES ('r2', 2), ('r3', 3)) r(rule, ord) WHERE NOT (doc_id % 10 = 0 AND r.rule = 'r3')),
banded AS (SELECT *, probability BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE AS no_judgment FROM readings)"""


def judgment_readings(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d)


def judgment_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags.flags_from(readings(spark, d), 0.7)


def judgment_tally(spark: SparkSession, d: str) -> DataFrame:
    chunks = documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.lit(1).alias("line"), (F.col("doc_id") % 5 != 0).alias("is_prose"))
    asked = chunks.where("is_prose").withColumn("rule", F.explode(F.array(F.lit("r2"), F.lit("r3"))))
    return flags.tally(chunks, readings(spark, d), asked)


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    asked, answered, undecided = n % 4, n % 3, n % 2
    v = flags.verdict(asked, answered, undecided, n % 7 != 0, n % 11 == 0)
    return documents(spark, d).select("doc_id", v.alias("verdict"), flags.exit_code(n % 5, asked, answered, n % 13 != 0).alias("code"))


def degradation_lines(spark: SparkSession, d: str) -> DataFrame:
    skipped = documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.lit(1).alias("line"), F.concat(F.lit("reason "), (F.col("doc_id") % 4).cast("string")).alias("reason"))
    return flags.degradation(skipped)


QUESTION = '{"r2":"x"}'


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", cache.cache_key(F.lit("m-1"), F.lit(QUESTION), F.col("text")).alias("key"), cache.wording(F.lit(QUESTION)).alias("wording"))


NOW_MS = 1_800_000_000_000


def stored(spark: SparkSession, d: str) -> DataFrame:
    """events as stored answers: some of another version, model or wording, some old, some undecided, some not covering."""
    e = F.col("event_id")
    nouls = F.when(e % 9 == 0, F.create_map(F.lit("r2"), F.lit(0.5))).when(e % 9 == 1, F.create_map(F.lit("r9"), F.lit(0.9))).when(e % 9 == 2, F.create_map(F.lit("r2"), F.lit(1.5))).otherwise(F.create_map(F.lit("r2"), F.lit(0.9)))
    return table(spark, d, "events").select(
        F.concat(F.lit("k"), e.cast("string")).alias("key"), F.when(e % 5 == 0, 1).otherwise(2).alias("v"), (F.lit(NOW_MS) - (e % 20) * 86_400_000).alias("at"),
        F.when(e % 7 == 0, "m-2").otherwise("m-1").alias("model"), F.when(e % 8 == 0, "w-2").otherwise("w-1").alias("wording"), nouls.alias("nouls"),
    )


def asked_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") + 5).cast("string")).alias("key"), F.lit("w-1").alias("wording"), F.array(F.lit("r2")).alias("rules"))


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = cache.look_up(asked_keys(spark, d), stored(spark, d), NOW_MS, "m-1")
    return hits.select("key", "model")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    _, miss = cache.look_up(asked_keys(spark, d), stored(spark, d), NOW_MS, "m-1")
    return miss.select("key")


STORED = f"""
stored AS (
  SELECT 'k' || event_id AS key FROM events
  WHERE event_id % 5 <> 0 AND event_id % 20 <= 14 AND event_id % 7 <> 0 AND event_id % 8 <> 0 AND event_id % 9 NOT IN (0, 1, 2)),
asked AS (SELECT 'k' || (event_id + 5) AS key FROM events)"""


def call_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 97 == 0, "refused").when(F.col("event_type").isin("error", "click"), "transient").otherwise("ok")
    return table(spark, d, "events").select("user_id", "ts", "event_id", "value", kind.alias("outcome"))


def breaker_runs(spark: SparkSession, d: str) -> DataFrame:
    return judge.breaker_log(call_log(spark, d), ["user_id"], ["ts", "event_id"]).select("event_id", "outcome", F.col("run").cast("long").alias("run"), "halted")


CALLS = """
calls AS (SELECT user_id, ts, event_id, value, CASE WHEN event_id % 97 = 0 THEN 'refused' WHEN event_type IN ('error', 'click') THEN 'transient' ELSE 'ok' END AS outcome FROM events)"""


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id")
    return e.agg(stats.p95(F.col("value")).alias("p95"), F.round(stats.median(F.col("value")), 6).alias("median"), F.count(F.lit(1)).alias("n"))


def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.when(F.col("event_type") == "error", "failed").otherwise("answered").alias("outcome"), (F.col("event_id") % 500).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), (F.col("event_id") % 300).alias("latency_ms"), (F.col("event_id") % 4 + 1).alias("attempts"))
    return judge.usage(rows).withColumn("cost_usd", F.round("cost_usd", 6))


def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    after = F.when(F.col("doc_id") % 3 == 0, None).otherwise((F.col("doc_id") % 20) * 500)
    w = judge.wait_ms(F.col("doc_id") % 3 + 1, after)
    kind = F.element_at(F.array(*map(F.lit, ("http", "refused", "timeout", "missing key"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, d).select("doc_id", w.alias("wait_ms"), judge.transient(kind, F.when(F.col("doc_id") % 8 == 0, 503).otherwise(401)).alias("transient"))


# --- draws -------------------------------------------------------------------


def rule_hashes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", prng.key_of(F.concat(F.col("doc_id").cast("string"), F.lit(":tricolon"))).alias("hash"))


def prng_draws(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit(prng.key_py("1:tricolon")).cast("long")
    return documents(spark, d).select("doc_id", prng.draw(key, F.col("doc_id") + 1).alias("r"))


DRAWS = f"""
k AS (SELECT doc_id, (({prng.key_py("1:tricolon")}::HUGEINT + (doc_id + 1) * {prng.STEP}) % 4294967296)::HUGEINT AS s FROM documents),
a AS (SELECT doc_id, (xor(s, s >> 15) * (s | 1::HUGEINT)) % 4294967296 AS t FROM k),
b AS (SELECT doc_id, xor(t, (t + (xor(t, t >> 7) * (t | 61::HUGEINT)) % 4294967296) % 4294967296) AS u FROM a)"""


# --- twins, replay, bank --------------------------------------------------------


def twin_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents by line, and copies with a benchmark sentence behind line 1; every ninth copy has a line more."""
    x = documents(spark, d).select(F.col("doc_id").alias("pair"), F.split("text", "\n").alias("l"))
    passages = table(spark, d, "benchmark")
    n = passages.count()
    s = x.select("pair", (F.col("pair") % n).alias("item_id")).join(F.broadcast(passages), "item_id").select("pair", F.col("text").alias("sentence"))
    y = x.join(s, "pair")
    lines = F.when(F.col("pair") % 9 == 0, F.concat("l", F.array(F.lit("more")))).otherwise(F.col("l"))
    y = y.select("pair", F.posexplode(lines).alias("seq", "text"), "sentence").select("pair", "seq", F.when(F.col("seq") == 0, F.concat_ws(" ", "text", "sentence")).otherwise(F.col("text")).alias("text"))
    return x.select("pair", F.posexplode("l").alias("seq", "text")), y, s


def twin_readings(spark: SparkSession, d: str) -> DataFrame:
    a, b, s = twin_chunks(spark, d)
    paired, _ = twins.pair_chunks(a, b)
    base = paired.select("pair", "seq").withColumn("rule", F.explode(F.array(F.lit("r2"), F.lit("r3"))))
    ord_ = F.when(F.col("rule") == "r2", 2).otherwise(3)
    one = base.withColumn("probability", judge.synthetic(F.col("pair") + F.col("seq"), ord_))
    moved = F.when((F.col("pair") + F.col("seq")) % 6 == 0, F.lit(0.3)).otherwise(0.0)
    two = base.withColumn("probability", F.when(F.col("pair") % 17 == 0, F.lit(None)).otherwise(judge.synthetic(F.col("pair") + F.col("seq"), ord_) * 0.7 + moved))
    return twins.readings(paired, s, one, two)


def twin_deltas(spark: SparkSession, d: str) -> DataFrame:
    return twin_readings(spark, d).select("pair", "paragraph", "rule", "delta", "injected", "over_bar")


def twin_findings(spark: SparkSession, d: str) -> DataFrame:
    return twins.findings(twin_readings(spark, d)).select("pair", "paragraph", "rule")


def twin_unusable(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = twin_chunks(spark, d)
    return twins.pair_chunks(a, b)[1]


TWINS = """
n AS (SELECT count(*) AS n FROM benchmark),
x AS (SELECT doc_id AS pair, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents WHERE doc_id % 9 <> 0),
p AS (SELECT x.pair, x.seq, contains(CASE WHEN x.seq = 0 THEN concat_ws(' ', x.text, b.text) ELSE x.text END, b.text) AS injected FROM x JOIN benchmark b ON b.item_id = x.pair % (SELECT n FROM n)),
r AS (
  SELECT p.pair, CAST(p.seq AS INTEGER) AS paragraph, v.rule, p.injected, (((p.pair + p.seq) * 7919 + v.ord * 104729) % 10007) / 10006.0::DOUBLE AS o,
         CASE WHEN p.pair % 17 <> 0 THEN (((p.pair + p.seq) * 7919 + v.ord * 104729) % 10007) / 10006.0::DOUBLE * 0.7::DOUBLE + CASE WHEN (p.pair + p.seq) % 6 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END END AS a
  FROM p, (VALUES ('r2', 2), ('r3', 3)) v(rule, ord)),
d AS (SELECT *, floor(abs(a - o) * 10000 + 0.5::DOUBLE) / 10000 AS delta FROM r),
t AS (SELECT pair, paragraph, rule, delta, injected, coalesce(delta > 0.1::DOUBLE, false) AS over_bar FROM d)"""


def replay_answers(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as recorded phrases; the last that a document contains answers."""
    from ..operators import replay

    recorded = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("match"))
    return replay.match_states(documents(spark, d).select("doc_id", "text"), recorded)


def host_fault_order(spark: SparkSession, d: str) -> DataFrame:
    faults = spark.createDataFrame([(0, ["the"]), (1, []), (2, ["EIN", "der"]), (3, ["zzz"])], "ord int, hosts array<string>")
    rows = documents(spark, d).crossJoin(F.broadcast(faults))
    return rows.select("doc_id", "ord", seed.fault_order(F.col("text"), F.col("hosts")).alias("rank"))


# --- rules and panel ----------------------------------------------------------------


def _two_rulesets() -> tuple[Ruleset, Ruleset]:
    j = {"kind": "judgment", "what": "w", "criteria": ("a", "b")}
    base = Ruleset((Rule("a", "regex", "base a", builtin="dash_present"), Rule("b", message="base b", tags=("m",), **j), Rule("c", message="base c", tags=("s",), **j)), 0.7, ("m",))
    child = Ruleset((Rule("c", message="own c", tags=("s",), **j), Rule("d", message="own d", **j)), None, None)
    return base, child


def ruleset_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = merge(*_two_rulesets())
    return rules_frame(spark, merged).select("ord", "id", "message", F.lit(merged.bar).alias("threshold"))


def rule_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name, only, skip in (("default", None, None), ("only s", ["s"], None), ("skip s", None, ["s"]), ("both", ["m"], ["s"])):
        kept, dropped = select(_two_rulesets()[0], only, skip)
        rows += [(name, r.id, None) for r in kept.rules] + [(name, r, why) for r, why in dropped]
    return spark.createDataFrame(rows, "selection string, rule string, reason string")


PANEL = "ord int, model_id string, provider string, match string, prefer array<string>, alternates array<string>"
PANEL_ROWS = [
    (0, "small", "p1", "^small-", ["small-2"], []), (1, "large", "p1", "^large", ["large-9"], ["large-8"]), (2, "any", "p1", "-1$", [], []),
    (3, "gone", "p1", "^small", ["small-7"], []), (4, "none", "p1", "^nothing", [], []), (5, "unread", "p3", ".", [], []),
]
CATALOG = "provider string, id string, input_usd double, output_usd double, json_mode boolean"
CATALOG_ROWS = [("p1", "small-1", 1e-6, 2e-6, True), ("p1", "small-2", None, None, True), ("p1", "large-8", 3e-6, 9e-6, False), ("p1", "large-1", 3e-6, 9e-6, False), ("p2", "other", 1e-6, 1e-6, True)]
PRICES = [(0, "small-2", 5e-7, 1e-6), (1, "small", 9e-7, 9e-7)]


def panel(spark: SparkSession) -> DataFrame:
    return bench.resolve_panel(spark.createDataFrame(PANEL_ROWS, PANEL), spark.createDataFrame(CATALOG_ROWS, CATALOG), "2026-01-01")


def panel_resolution(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark).select("ord", "model_id", "slug", "available", F.array_join("candidates", ",").alias("candidates"))


def price_lookup(spark: SparkSession, d: str) -> DataFrame:
    priced = bench.first_price(panel(spark).where("available"), spark.createDataFrame(PRICES, "ord int, match string, input double, output double"))
    p = bench.price(F.col("input_usd"), F.col("output_usd"), F.col("file_input"), F.col("file_output"))
    return priced.select("model_id", p["input"].alias("input"), p["output"].alias("output"), p["source"].alias("source"))


def bench_calls(spark: SparkSession, d: str) -> DataFrame:
    """events as calls of three models, one without a price."""
    model = F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))
    outcome = bench.outcome_of(F.col("event_type") == "error", F.col("event_id") % 50 == 1, F.col("event_id") % 40 != 3)
    e = table(spark, d, "events").select("event_id", model.alias("model_id"), (F.col("event_id") % 4 + 1).alias("repeat"), outcome.alias("outcome"), F.col("value").alias("latency_ms"), (F.col("event_id") % 3 + 1).alias("attempts"), (F.col("event_id") % 900).alias("tin"), (F.col("event_id") % 90).alias("tout"))
    usd = F.when(F.col("model_id") != "m2", F.lit(1e-6))
    return e.withColumn("cost_usd", bench.call_cost(F.col("tin"), F.col("tout"), usd, usd * 5))


BENCH = """
calls AS (
  SELECT event_id, 'm' || (event_id % 3) AS model_id, event_id % 4 + 1 AS repeat, value,
         CASE WHEN event_type = 'error' THEN 'failure' WHEN event_id % 50 = 1 THEN 'truncated' WHEN event_id % 40 = 3 THEN 'parse failure' ELSE 'answered' END AS outcome,
         event_id % 3 + 1 AS attempts, CASE WHEN event_id % 3 <> 2 THEN ((event_id % 900) + (event_id % 90) * 5) / 1000000.0::DOUBLE END AS usd
  FROM events)"""


def bench_cost(spark: SparkSession, d: str) -> DataFrame:
    return bench.totals(bench_calls(spark, d)).select("calls", "failures", "retries", F.round("priced_usd", 6).alias("priced_usd"), F.array_join("unpriced", ",").alias("unpriced"))


def bench_latency(spark: SparkSession, d: str) -> DataFrame:
    return bench.latency(bench_calls(spark, d)).withColumn("p95_ms", F.round("p95_ms", 6))


def repeat_spread(spark: SparkSession, d: str) -> DataFrame:
    c = bench_calls(spark, d)
    return bench.repeat_spread(c.groupBy("model_id", "repeat").agg(F.count_if(F.col("outcome") == "answered").alias("hits"), F.count(F.lit(1)).alias("positives")))


def call_slots(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", F.col("doc_id").alias("doc_index"))
    m = spark.createDataFrame([("m0", 0), ("m1", 1), ("m2", 2)], "model_id string, ord int")
    return bench.call_plan(m, docs, 2).select("repeat", "doc_id", "model_id", "slot")


REPLIES = [
    '{"r2": {"flag": true, "p": 0.9}, "r3": {"flag": false, "p": 0.1}}', '```json\n{"r2": {"flag": true, "p": 1}}\n```', '{"r2": {"flag": "true", "p": 0.9}, "x": 1}',
    '{"r2": {"flag": true, "p": 1.5}, "r3": {"p": 0.2, "flag": false}}', "I think yes", "[1, 2]",
]


def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("doc_id") % len(REPLIES) + 1).cast("int"))
    r = documents(spark, d).select("doc_id", F.explode(F.array(bench.parse_reply(reply, ["r2", "r3"]))).alias("r"))
    got = F.array_join(F.transform("r.readings", lambda x: F.format_string("%s %s %.2f", x["rule"], x["flag"].cast("string"), x["p"])), ";")
    return r.select("doc_id", F.col("r.ok").alias("ok"), got.alias("got"), F.array_join("r.missing", ",").alias("missing"), F.array_join("r.extra", ",").alias("extra"))


def seeded_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Faults planted in clean documents by rule, exact shuffle, three a rule."""
    bases = documents(spark, d).where("text is not null").select(F.concat(F.lit("C"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("doc-"), "doc_id").alias("file"), F.lit(1).alias("line"), "text")
    rules_ = (
        Rule("dash_present", "regex", "m", builtin="dash_present", seed=Seed("insert_em_dash", 1)), Rule("sentence_rhythm", "regex", "m", builtin="sentence_rhythm", seed=Seed("equalize_sentences")),
        Rule("slop_vocab", "regex", "m", builtin="slop_vocab", seed=Seed("insert_slop_word", 1)), Rule("tricolon", "judgment", "m", what="w", criteria=("a", "b"), seed=Seed(splice=("Fast, calm, kind.", "We plan, we build, we learn."))),
    )
    made, _ = seed.seed_corpus(bases, Ruleset(rules_))
    return made.select("id", "base_id", "rule", "transform", "words")


QUERIES = [
    per_rule_scores, overall_scores, class_scores, multi_grain_scores, calibration, unanswered_cells, misses, false_positives, arm_summary, post_odds, duplicate_cells,
    wilson_intervals, threshold_sweep, judgment_readings, judgment_flags, judgment_tally, verdicts, degradation_lines, cache_keys, cache_hits, cache_misses, breaker_runs,
    latency_p95, usage_ledger, retry_waits, rule_hashes, prng_draws, twin_deltas, twin_findings, twin_unusable, replay_answers, host_fault_order, ruleset_merge, rule_selection,
    panel_resolution, price_lookup, bench_cost, bench_latency, repeat_spread, call_slots, reply_parse, seeded_corpus,
]

_OVERALL = f"""
t AS (SELECT g.*, b.threshold, p >= threshold AS o FROM grid g, bars b),
byd AS (SELECT arm, threshold, doc, kind, count(*) FILTER (o) AS o, count(*) FILTER (own AND o) AS hit, count(*) FILTER (o AND NOT own) AS off, count(*) AS cells FROM t GROUP BY ALL),
f AS (SELECT arm, count(DISTINCT rule) AS fireable FROM grid WHERE answered AND rule <> 'r1' GROUP BY arm),
s AS (
  SELECT arm, threshold, CAST(coalesce(sum(hit) FILTER (kind = 'seeded'), 0) AS BIGINT) AS hits, count(*) FILTER (kind = 'seeded') AS positives,
         CAST(coalesce(sum(o) FILTER (kind = 'clean'), 0) AS BIGINT) AS fp_cells, count(*) FILTER (kind = 'clean' AND o > 0) AS fp_docs, count(*) FILTER (kind = 'clean') AS n_clean,
         CAST(coalesce(sum(cells) FILTER (kind = 'clean'), 0) AS BIGINT) AS clean_cells, CAST(coalesce(sum(off) FILTER (kind = 'seeded'), 0) AS BIGINT) AS off_rule_flags,
         CAST(coalesce(sum(cells - 1) FILTER (kind = 'seeded'), 0) AS BIGINT) AS off_cells
  FROM byd GROUP BY arm, threshold),
overall AS (
  SELECT arm, threshold, hits, positives, {ratio_sql('hits', 'positives')} AS recall, fp_docs, n_clean, {ratio_sql('fp_docs', 'n_clean')} AS fp_doc_rate, {wilson_sql('fp_docs', 'n_clean', 'fp_doc_low', 'fp_doc_high')},
         fp_cells, clean_cells, {ratio_sql('fp_cells', 'clean_cells')} AS fp_cell_rate, n_clean * fireable AS fireable_cells, {ratio_sql('fp_cells', '(n_clean * fireable)')} AS fp_fireable_rate,
         off_rule_flags, {ratio_sql('off_rule_flags', 'off_cells')} AS off_rule_rate, {ratio_sql('(fp_cells + off_rule_flags)', '(clean_cells + off_cells)')} AS fp_negative_rate
  FROM s JOIN f USING (arm))"""

SQL = {
    "per_rule_scores": f"""WITH {GRID}, t AS (SELECT g.*, b.threshold, p >= threshold AS o FROM grid g, bars b),
        s AS (SELECT arm, rule, threshold, count(*) FILTER (own) AS n_positive, count(*) FILTER (kind = 'clean') AS n_clean, count(*) FILTER (own AND o) AS hits, count(*) FILTER (kind = 'clean' AND o) AS fps FROM t GROUP BY arm, rule, threshold)
        SELECT arm, rule, threshold, n_positive, n_clean, hits, {ratio_sql('hits', 'n_positive')} AS recall, {wilson_sql('hits', 'n_positive', 'low', 'high')}, fps, {ratio_sql('fps', 'n_clean')} AS fp_rate_clean FROM s""",
    "overall_scores": f"WITH {GRID}, {_OVERALL} SELECT * FROM overall",
    "class_scores": f"""WITH {GRID}, t AS (SELECT g.*, b.threshold, p >= threshold AS o, CASE WHEN countable THEN 'countable' ELSE 'judgment' END AS class FROM grid g, bars b),
        s AS (SELECT arm, class, threshold, count(DISTINCT rule) AS rules, count(*) FILTER (own AND o) AS hits, count(*) FILTER (own) AS positives FROM t GROUP BY ALL)
        SELECT arm, class, threshold, rules, hits, positives, {ratio_sql('hits', 'positives')} AS recall, {wilson_sql('hits', 'positives', 'low', 'high')}, positives > 0 AND class = 'countable' AS by_construction FROM s""",
    "multi_grain_scores": f"""WITH {GRID}, t AS (SELECT *, CASE WHEN countable THEN 'countable' ELSE 'judgment' END AS class, p >= 0.7::DOUBLE AS o FROM grid)
        SELECT arm, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN class IS NOT NULL THEN 'class' ELSE 'all' END AS grain, class, rule, count(*) FILTER (own AND o) AS hits, count(*) FILTER (own) AS positives,
               count(*) FILTER (kind = 'clean' AND o) AS fps, count(*) FILTER (kind = 'clean') AS clean_cells
        FROM t GROUP BY GROUPING SETS ((arm, class, rule), (arm, class), (arm))""",
    "calibration": f"""WITH {GRID}, e AS (SELECT arm, bucket FROM (VALUES ('A'), ('C')) a(arm), range(10) b(bucket)),
        s AS (SELECT arm, least(CAST(floor(p * 10) AS BIGINT), 9) AS bucket, count(*) AS n, count(*) FILTER (own) AS defective FROM grid WHERE answered GROUP BY ALL)
        SELECT arm, CAST(bucket AS INTEGER) AS bucket, coalesce(n, 0) AS n, coalesce(defective, 0) AS defective, {ratio_sql('defective', 'n')} AS fraction_defective FROM e LEFT JOIN s USING (arm, bucket)""",
    "unanswered_cells": f"WITH {GRID} SELECT arm, count(*) FILTER (NOT answered) AS unanswered FROM grid GROUP BY arm",
    "misses": f"WITH {GRID} SELECT arm, doc, rule, p AS probability FROM grid WHERE own AND p < 0.7::DOUBLE",
    "false_positives": f"WITH {GRID} SELECT arm, doc, rule, p AS probability FROM grid WHERE kind = 'clean' AND p >= 0.7::DOUBLE",
    "arm_summary": f"""WITH {GRID}, n AS (SELECT arm, count(*) AS documents, count(*) AS requests, CAST(sum(CASE WHEN retried THEN 1 ELSE 0 END) AS BIGINT) AS retries, CAST(0 AS BIGINT) AS unanswered,
          CAST(sum(tokens) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, {round4_sql('avg(ms)')} AS mean_ms, {round4_sql('median(ms)')} AS median_ms,
          list_sort(list(ms))[greatest(1, CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT))] AS p95_ms, sum(tokens * 0.042e-6::DOUBLE) AS usd FROM docs GROUP BY arm)
        SELECT * EXCLUDE (usd), CAST(floor(usd * 1e8::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS usd_e8, CAST(floor(usd / documents * 1e10::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS usd_per_100_e8 FROM n""",
    "post_odds": f"""WITH {GRID}, {_OVERALL}, r AS (SELECT threshold, arm, fp_docs / CAST(n_clean AS DOUBLE) AS rate FROM overall WHERE fp_docs > 0),
        w AS (SELECT threshold, arg_max(arm, rate) AS arm, max(rate) AS rate FROM r GROUP BY threshold)
        SELECT threshold, arm, {round4_sql('rate')} AS rate, {round4_sql('1 - pow(1 - rate, 8)')} AS odds FROM w""",
    "duplicate_cells": f"WITH {GRID} SELECT doc, rule, round(1 - p, 9) AS probability FROM grid WHERE arm = 'C' AND answered",
    "wilson_intervals": f"SELECT doc_id, {wilson_sql('(doc_id % 13)', '(doc_id % 29 + 13)', 'low', 'high')} FROM documents",
    "threshold_sweep": "SELECT doc_id, array_to_string(list_sort(list_distinct([5, 7, 9, CAST(doc_id % 10 AS INTEGER)])), ',') AS bars FROM documents",
    "judgment_readings": f"WITH {READINGS} SELECT * FROM banded",
    "judgment_flags": f"WITH {READINGS} SELECT file, line, rule, 'judgment' AS kind, probability, message FROM banded WHERE NOT no_judgment AND probability >= 0.7::DOUBLE",
    "judgment_tally": f"""WITH {READINGS}, c AS (SELECT 'doc-' || doc_id AS file, doc_id % 5 <> 0 AS prose FROM documents), a AS (SELECT file, r.rule FROM c, (VALUES ('r2'), ('r3')) r(rule) WHERE prose)
        SELECT count(*) AS asked, count(*) FILTER (no_judgment = false) AS answered, count(*) FILTER (no_judgment) AS no_judgment, count(*) FILTER (no_judgment IS NULL) AS unanswered,
               (SELECT count(*) FROM c WHERE NOT prose) AS structure FROM a LEFT JOIN banded b ON a.file = b.file AND a.rule = b.rule""",
    "verdicts": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not run' WHEN doc_id % 4 > 0 AND doc_id % 3 + doc_id % 2 = 0 THEN 'answered nothing' WHEN doc_id % 11 = 0 OR doc_id % 3 + doc_id % 2 < doc_id % 4 THEN 'degraded' ELSE 'answered' END AS verdict,
        CAST(CASE WHEN doc_id % 13 = 0 THEN 3 WHEN doc_id % 4 > 0 AND doc_id % 3 = 0 THEN 2 WHEN doc_id % 5 > 0 THEN 1 ELSE 0 END AS INTEGER) AS code FROM documents""",
    "degradation_lines": "SELECT 'reason ' || (doc_id % 4) AS reason, count(*) AS n, min('doc-' || doc_id) AS file, CAST(1 AS INTEGER) AS line FROM documents GROUP BY doc_id % 4",
    "cache_keys": f"SELECT doc_id, sha256('v2' || chr(0) || 'm-1' || chr(0) || '{QUESTION}' || chr(0) || text) AS key, sha256('{QUESTION}') AS wording FROM documents",
    "cache_hits": f"WITH {STORED} SELECT a.key, 'm-1' AS model FROM asked a JOIN stored s ON a.key = s.key",
    "cache_misses": f"WITH {STORED} SELECT a.key FROM asked a ANTI JOIN stored s ON a.key = s.key",
    "breaker_runs": f"""WITH {CALLS}, r AS (SELECT *, count(*) FILTER (outcome = 'ok') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM calls),
        n AS (SELECT *, count(*) FILTER (outcome = 'transient') OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS run FROM r)
        SELECT event_id, outcome, run, coalesce(max(CASE WHEN run >= 3 AND outcome = 'transient' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS halted FROM n""",
    "latency_p95": "SELECT user_id, list_sort(list(value))[greatest(1, CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT))] AS p95, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY user_id",
    "usage_ledger": """SELECT count(*) AS requests, CAST(sum(event_id % 500) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, round(sum((event_id % 500) * 0.042e-6::DOUBLE), 6) AS cost_usd,
        CAST(sum(event_id % 300) AS BIGINT) AS latency_ms, CAST(sum(event_id % 4) AS BIGINT) AS retries FROM events""",
    "retry_waits": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1000.0::DOUBLE * pow(2, doc_id % 3) WHEN (doc_id % 20) * 500 <= 8000 THEN CAST(greatest((doc_id % 20) * 500, 1000) AS DOUBLE) END AS wait_ms,
        CASE doc_id % 4 WHEN 1 THEN false WHEN 3 THEN false WHEN 0 THEN doc_id % 8 = 0 ELSE true END AS transient FROM documents""",
    "rule_hashes": f"SELECT doc_id, CAST(list_reduce(list_prepend({prng.FNV_OFFSET}::HUGEINT, list_transform(string_split(doc_id || ':tricolon', ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (xor(h, c) * {prng.FNV_PRIME}) % 4294967296) AS BIGINT) AS hash FROM documents",
    "prng_draws": f"WITH {DRAWS} SELECT doc_id, CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296.0::DOUBLE AS r FROM b",
    "twin_deltas": f"WITH {TWINS} SELECT * FROM t",
    "twin_findings": f"WITH {TWINS} SELECT pair, paragraph, rule FROM t WHERE over_bar AND NOT injected",
    "twin_unusable": "SELECT doc_id AS pair, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_original, CAST(len(string_split(text, chr(10))) + 1 AS BIGINT) AS n_adversarial FROM documents WHERE doc_id % 9 = 0",
    "replay_answers": "SELECT d.doc_id, max(b.item_id) AS ord FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id",
    "host_fault_order": """SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(CASE WHEN len(list_filter(hosts, lambda h: contains(lower(text), lower(h)))) > 0 THEN 0 WHEN len(hosts) = 0 THEN 1 ELSE 2 END AS INTEGER) AS rank
        FROM documents, (VALUES (0, ['the']), (1, []::VARCHAR[]), (2, ['EIN', 'der']), (3, ['zzz'])) f(ord, hosts)""",
    "ruleset_merge": """WITH base(ord, id, message) AS (VALUES (0, 'a', 'base a'), (1, 'b', 'base b'), (2, 'c', 'base c')), child(ord, id, message) AS (VALUES (0, 'c', 'own c'), (1, 'd', 'own d'))
        SELECT CAST(row_number() OVER (ORDER BY b.ord NULLS LAST, c.ord) - 1 AS INTEGER) AS ord, id, coalesce(c.message, b.message) AS message, 0.7::DOUBLE AS threshold FROM base b FULL JOIN child c USING (id)""",
    "rule_selection": """SELECT * FROM (VALUES ('default', 'a', NULL), ('default', 'c', NULL), ('default', 'b', 'off by default: m'), ('only s', 'a', NULL), ('only s', 'c', NULL), ('only s', 'b', 'only s'),
        ('skip s', 'a', NULL), ('skip s', 'c', 'skip s'), ('skip s', 'b', 'off by default: m'), ('both', 'a', NULL), ('both', 'b', NULL), ('both', 'c', 'skip s')) t(selection, rule, reason)""",
    "panel_resolution": """SELECT CAST(ord AS INTEGER) AS ord, model_id, slug, available, candidates FROM (VALUES (0, 'small', 'small-2', true, 'small-1,small-2'), (1, 'large', 'large-8', true, 'large-1,large-8'),
        (2, 'any', 'large-1', true, 'large-1,small-1'), (3, 'gone', NULL, false, 'small-1,small-2'), (4, 'none', NULL, false, ''), (5, 'unread', NULL, false, '')) t(ord, model_id, slug, available, candidates)""",
    "price_lookup": """WITH m(model_id, slug, i, o) AS (VALUES ('small', 'small-2', NULL, NULL), ('large', 'large-8', 3e-6::DOUBLE, 9e-6::DOUBLE), ('any', 'large-1', 3e-6::DOUBLE, 9e-6::DOUBLE)),
        p(ord, match, i, o) AS (VALUES (0, 'small-2', 5e-7::DOUBLE, 1e-6::DOUBLE), (1, 'small', 9e-7::DOUBLE, 9e-7::DOUBLE))
        SELECT m.model_id, coalesce(m.i, arg_min(p.i, p.ord)) AS input, coalesce(m.o, arg_min(p.o, p.ord)) AS output, CASE WHEN m.i IS NOT NULL THEN 'catalogue' ELSE 'price file' END AS source
        FROM m LEFT JOIN p ON contains(m.slug, p.match) GROUP BY m.model_id, m.i, m.o""",
    "bench_cost": f"WITH {BENCH} SELECT count(*) AS calls, count(*) FILTER (outcome = 'failure') AS failures, CAST(sum(attempts - 1) AS BIGINT) AS retries, round(sum(usd), 6) AS priced_usd, 'm2' AS unpriced FROM calls",
    "bench_latency": f"""WITH {BENCH} SELECT model_id, count(*) AS calls, {round4_sql('median(value)')} AS median_ms, round(list_sort(list(value))[greatest(1, CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT))], 6) AS p95_ms
        FROM calls WHERE outcome <> 'failure' GROUP BY model_id""",
    "repeat_spread": f"""WITH {BENCH}, r AS (SELECT model_id, repeat, count(*) FILTER (outcome = 'answered') / CAST(count(*) AS DOUBLE) AS recall FROM calls GROUP BY ALL)
        SELECT model_id, {round4_sql('avg(recall)')} AS mean, {round4_sql('min(recall)')} AS least, {round4_sql('max(recall)')} AS most, count(*) AS repeats FROM r GROUP BY model_id""",
    "call_slots": "SELECT CAST(r.repeat AS INTEGER) AS repeat, doc_id, 'm' || m.place AS model_id, CAST(((m.place - doc_id) % 3 + 3) % 3 AS INTEGER) AS slot FROM documents, range(1, 3) r(repeat), range(3) m(place)",
    "reply_parse": """SELECT doc_id, ok, got, missing, extra FROM documents JOIN (VALUES (0, true, 'r2 true 0.90;r3 false 0.10', '', ''), (1, true, 'r2 true 1.00', 'r3', ''), (2, true, '', 'r2,r3', 'x'),
        (3, true, 'r3 false 0.20', 'r2', ''), (4, false, '', 'r2,r3', ''), (5, false, '', 'r2,r3', '')) t(k, ok, got, missing, extra) ON doc_id % 6 = k""",
}
