import pytest
from pyspark.sql import functions as F

from quillworks.functions import prng
from quillworks.functions import text as T
from quillworks.operators import cache, chunk, countable, flags, judge, live, scrub, seed
from quillworks.operators.consent import ConsentError, request
from quillworks.plans.check import check
from quillworks.sources.ruleset import Rule, Ruleset, Seed, default_ruleset

DASH = Rule("dash", "regex", "m", builtin="dash_present")
COLON = Rule("colon", "regex", "m", builtin="colon_count")


def chunks(spark, text, cap=None):
    df = chunk.chunk_drafts(spark.createDataFrame([("f", text)], "file string, text string"), cap)
    return [(r.line, r.text, r.kind) for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("text,expected", [
    ("one\n\n\n\ntwo\n   \n", [(1, "one", "prose"), (5, "two", "prose")]),
    ("", []), ("\n \n", []), ("a\r\nb\r\rc", [(1, "a\nb", "prose"), (4, "c", "prose")]),
    ("---\ntitle: x\n---\n\nbody", [(1, "---\ntitle: x\n---", "front_matter"), (5, "body", "prose")]),
    ("# h\n\n- a\n- b\n\n> q\n\n<!-- c -->\n\na | b\n--- | ---\n\n[l]: http://x", [(1, "# h", "heading"), (3, "- a\n- b", "list"), (6, "> q", "block_quote"), (8, "<!-- c -->", "html_comment"), (10, "a | b\n--- | ---", "table"), (13, "[l]: http://x", "link_definition")]),
    ("a\n```\ncode: x\n```\nb", [(1, "a", "prose"), (5, "b", "prose")]),
    ("a\n```\nopen", [(1, "a", "prose")]),
    ("- item\n\n  ```\n  x\n  ```\n\nafter", [(1, "- item", "list"), (7, "after", "prose")]),
    ("> ```\n> x\n```\n> ```\nend", [(5, "end", "prose")]),
    ("```a`b``` is a span", [(1, "```a`b``` is a span", "prose")]),
    ("    ```\n    not a fence", [(1, "    ```\n    not a fence", "prose")]),
    ("~~~\nx\n```\n~~~~\ny", [(5, "y", "prose")]),
])
def test_chunks(spark, text, expected):
    assert chunks(spark, text) == expected


def test_plain_and_folded_agree(spark):
    import random

    rnd = random.Random(5)
    rows = [(str(i), "".join(rnd.choice(["a", " ", "\n", "\n\n", "# x", "- y", "> z", "|", "--- | -", "\t", "  ", "[a]: b", "\r\n", ".", "---\n"]) for _ in range(rnd.randint(0, 25)))) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, text string")
    a, b = chunk.chunk_plain(df), chunk.chunk_folded(df)
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_long_blocks_are_cut_on_sentences(spark):
    df = chunk.chunk_drafts(spark.createDataFrame([("f", "One two. Three four.\nFive six. " + "x" * 45)], "file string, text string"), 20)
    rows = [(r.line, r.text, r.part["index"], r.part["of"]) for r in df.orderBy("seq").collect()]
    assert rows[:2] == [(1, "One two. Three four.", 1, 5), (2, "Five six.", 2, 5)] and [len(r[1]) for r in rows[2:]] == [20, 20, 5]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize("text,expected", [("a — b", [0]), ("1–2", []), ("a–2", []), ("a–b\n—", [0, 1]), ("", [])])
def test_dash(spark, text, expected):
    assert one(spark, text, countable.dash_lines) == expected


@pytest.mark.parametrize("text,expected", [
    ("a: b: c: d", [0]), ("x\ny: b: c:", [1]), ("a: b: http://x:80/", []), ("at 10:30 and 11:15:20: a: b", []), ("<!-- a: b: c: -->d: e:", []), ("<!-- x\n -->a: b: c:", [1]), ("a: <!-- b: c:", [0]),
])
def test_colons(spark, text, expected):
    assert one(spark, text, countable.colon_lines) == expected


def test_rhythm(spark):
    even = " ".join(["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."] * 4)
    assert one(spark, even, countable.rhythm_lines) == [0]
    assert one(spark, even + " Short one.", countable.rhythm_lines) == []
    assert one(spark, "Five words are in this. " * 4, countable.rhythm_lines) == []


@pytest.mark.parametrize("text,n", [("delves", 1), ("Seamlessly", 1), ("delver", 0), ("unlocks the door", 0), ("unlocks the back door", 1), ("éunlock", 1), ("landscape architecture landscape", 1), ("navigating by", 0), ("showcased", 1)])
def test_vocabulary(spark, text, n):
    assert len(one(spark, text, lambda t: countable.word_offsets(t, countable.SLOP_WORDS, countable.SLOP_SPARED))) == n


def test_offsets_of_empty_matches(spark):
    assert one(spark, "aXb", lambda t: T.match_offsets(t, "(?=X)|b")) == [1, 2]


@pytest.mark.parametrize("text,masked", [("a `b` c", "a     c"), ("``a`b`` `", "        `"), ("`a\nb`", "  \n  "), ("``x`", "``x`")])
def test_code_mask(text, masked):
    assert chunk.mask_code_py(text) == masked


def test_flags_and_kinds(spark):
    text = "# A — b\n\nOne — two — three\nfour — five\n\n> said — so\n\n`a — b`\n"
    c = chunk.chunk_drafts(spark.createDataFrame([("f", text)], "file string, text string"))
    assert sorted(r.line for r in countable.countable_flags(c, Ruleset((DASH,))).collect()) == [1, 3, 4]
    rows = [("f", 1, "r", "regex", 1.0, "a"), ("f", 1, "r", "judgment", 0.9, "b"), ("f", 0, "r", "regex", 1.0, "c")]
    df = spark.createDataFrame(rows, "file string, line int, rule string, kind string, probability double, message string")
    assert [(r.line, r.message) for r in flags.sorted_flags(flags.merge_flags(df.where("kind = 'judgment'"), df.where("kind = 'regex'"))).collect()] == [(0, "c"), (1, "b")]


def test_check_with_a_recorded_judge(spark, tmp_path):
    rules = Ruleset((DASH, Rule("j", "judgment", "mj", what="w", criteria=("a", "b")), Rule("first", "judgment", "mf", what="w", criteria=("a", "b"), sentence="first")))
    drafts = spark.createDataFrame([("f", "Yes — bad.\n\nYes bad.\n\nYes bad.\n\n# head\n\nundecided here"), ("g", "fine")], "file string, text string")
    judge_ = judge.Recorded([("bad", {"j": 0.9, "first": 0.2}), ("undecided", {"j": 0.5, "first": 0.71})], {"j": 0.1, "first": 0.0})
    path = str(tmp_path / "cache")
    out = check(drafts, rules, the_judge=judge_, cache_path=path, now_ms=10**12)
    assert out.hits.count() == 0 and out.skipped.count() == 0
    got = sorted((r.file, r.line, r.rule) for r in out.flags.collect())
    assert got == [("f", 1, "dash"), ("f", 1, "j"), ("f", 3, "j"), ("f", 5, "j"), ("f", 9, "first")]
    assert out.outcomes.count() == 4  # equal paragraphs are asked about once
    again = check(drafts, rules, the_judge=judge_, cache_path=path, now_ms=10**12 + 1)
    assert again.outcomes.count() == 0 and sorted((r.file, r.line, r.rule) for r in again.flags.collect()) == got
    assert check(drafts, rules).readings is None


def test_judge_stops_and_refuses(spark):
    class Failing:
        model = "m"

        def ask(self, text, questions):
            raise judge.JudgeError("down", transient="perm" not in text)

    rows = spark.createDataFrame([(f"k{i}", t, "{}") for i, t in enumerate(["a", " ", "b", "c", "d"])], "key string, text string, questions string")
    got = [(r.outcome) for r in judge.run_judge(rows, Failing(), parallel=1).orderBy("key").collect()]
    assert got == ["failed", "refused", "failed", "failed", "not sent"]
    rows = spark.createDataFrame([("k0", "perm", "{}"), ("k1", "x", "{}")], rows.schema)
    assert [r.outcome for r in judge.run_judge(rows, Failing(), parallel=1).orderBy("key").collect()] == ["failed", "not sent"]


def test_http_judge():
    calls = []

    def post(url, body, headers, timeout):
        calls.append(url)
        return [(503, {"retry-after": "0"}, "busy"), (200, {}, '{"nouls": {"a": 0.5, "b": 7}, "usage": {"input_tokens": 3}}')][len(calls) - 1]

    answer = None
    old, judge.time.sleep = judge.time.sleep, lambda s: None
    try:
        answer = judge.Http("https://x.example", "secret-key-123", "m", post).ask("t", "{}")
        assert answer["nouls"] == {"a": 0.5} and answer["attempts"] == 2 and answer["usage_reported"]
        with pytest.raises(judge.JudgeError) as e:
            judge.Http("https://x.example", "secret-key-123456789", "m", lambda *a: (401, {}, "bad secret-key-123456789")).ask("t", "{}")
        assert not e.value.transient and "secret-key" not in str(e.value)
    finally:
        judge.time.sleep = old
    with pytest.raises(ValueError):
        judge.LocalChat("http://example.com/v1", "m")
    local = judge.LocalChat("http://127.0.0.1:1/v1", "m", lambda *a: (200, {}, '{"choices": [{"message": {"content": "<think>x</think>{\\"r\\": {\\"flag\\": true, \\"p\\": 0.8}}"}}]}'))
    assert local.ask("t", '{"r": {"instructions": {"what": "w"}, "criteria": {"true": "a", "false": "b"}}}')["nouls"] == {"r": 0.8}


@pytest.mark.parametrize("attempt,after,wait", [(1, None, 1000), (3, None, 4000), (1, 0, 1000), (2, 5000, 5000), (1, 9000, None)])
def test_waits(attempt, after, wait):
    assert judge.wait_ms_py(attempt, after) == wait


def test_cache_rules(spark):
    ok = {"key": "k", "v": 2, "at": 10**12, "model": "m", "wording": "w", "nouls": {"r": 0.9}}
    cases = [({}, 1), ({"v": 1}, 0), ({"at": 10**12 - cache.MAX_AGE_MS}, 1), ({"at": 10**12 - cache.MAX_AGE_MS - 1}, 0), ({"model": "n"}, 0), ({"wording": "x"}, 0), ({"nouls": {"r": 0.5}}, 0), ({"nouls": {"s": 0.9}}, 0), ({"nouls": {"r": 0.9, "s": 2.0}}, 0)]
    asked = spark.createDataFrame([("k", "w", ["r"])], "key string, wording string, rules array<string>")
    for change, n in cases:
        row = spark.createDataFrame([ok | change], "key string, v int, at long, model string, wording string, nouls map<string, double>")
        hits, miss = cache.look_up(asked, row, 10**12, "m")
        assert (hits.count(), miss.count()) == (n, 1 - n), change
    assert cache.location({"QUILLWORKS_CACHE": "off"}, "/h") is None and cache.location({"QUILLWORKS_CACHE": "c"}, "/h") == "/h/c" and cache.location({}, "/h") == "/h/.cache/quillworks"


def test_draws(spark):
    assert prng.key_py("1:tricolon") == 1338802902
    d = prng.Draws(prng.key_py("1:x"))
    got = spark.range(1, 9).select(prng.draw(F.lit(prng.key_py("1:x")), F.col("id")).alias("r")).collect()
    assert [r.r for r in got] == [d.next() for _ in range(8)]
    assert sorted(prng.Draws(7).shuffled(list(range(20)))) == list(range(20)) and prng.Draws(7).below(0) is None


TEXTS = ["One, two. Three, four! Five six seven, eight. Nine ten eleven twelve, end?", "No stop here", "A. B.", "x " * 40 + ". " + "y " * 30 + ".", "Long one, with more words in it than most of them have. Short. " * 3]


def test_transforms_agree_with_their_driver_forms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")

    def safe(f, *a):
        try:
            return f(*a)
        except seed.SeedError:
            return None

    got = df.select("i", seed.equalize(F.col("text")).alias("e"), seed.comma_edit(F.col("text"), 2, ": ").alias("c"), seed.splice(F.col("text"), F.lit("S."), "any", F.lit(0.4)).alias("s")).orderBy("i").collect()

    class Fixed:
        def next(self):
            return 0.4

    for r, t in zip(got, TEXTS):
        assert r.e == safe(seed.equalize_py, t) and r.c == safe(seed.comma_edit_py, t, 2, ": ") and r.s == seed.splice_py(t, "S.", "any", Fixed())[0]
    assert seed.unique_key("a, b a, c", 6, 2)[1] == "a, c" and seed.unique_key("a, b", 1, 2)[1] == ", "


@pytest.mark.parametrize("mode", ["exact", "hash"])
def test_seeding(spark, mode):
    text = "The river ran low, and the mill stood still through the dry month of August {}. Nobody in the village could say why it had come so early this year. Rain, when it fell, fell far away."
    bases = spark.createDataFrame([(f"C{i:02d}", f"f{i}", 1, text.format(i)) for i in range(12)] + [("C99", "f", 1, "Bad — one.")], "id string, file string, line int, text string")
    rules = Ruleset((Rule("dash", "regex", "m", builtin="dash_present", seed=Seed("insert_em_dash")), Rule("slop", "regex", "m", builtin="slop_vocab", seed=Seed("insert_slop_word")), Rule("j", "judgment", "m", what="w", criteria=("a", "b"), seed=Seed(splice=("Planted here.", "Planted there.")))))
    made, refused = seed.seed_corpus(bases, rules, mode=mode)
    rows = made.orderBy("id").collect()
    assert [r.id for r in rows] == [f"S{i:02d}" for i in range(1, 10)] and [r.rule for r in rows] == ["dash"] * 3 + ["slop"] * 3 + ["j"] * 3
    assert all("—" in r.text for r in rows[:3]) and {r.sentence for r in rows[6:]} <= {"Planted here.", "Planted there."}
    assert [tuple(r) for r in rows] == [tuple(r) for r in seed.seed_corpus(bases, rules, mode=mode)[0].orderBy("id").collect()]
    bank = seed.Bank({}, {"j": [("Close to it.", "why")]})
    assert seed.near_misses(spark, [("C00", "f", "One. Two. Three.")], rules, bank).first().id == "N01"


@pytest.mark.parametrize("mode", ["exact", "hash"])
def test_seeding_goes_on_until_a_rule_has_its_copies(spark, mode):
    # Five of 300 texts have a comma site, and of those that flow evenly only long ones count.
    rows = [(f"C{i:03d}", f"f{i}", 1, f"Text {i} ends, at once." if i % 60 == 7 else "Word one two three. " * (20 if i % 60 == 9 else 5)) for i in range(300)]
    bases = spark.createDataFrame(rows, "id string, file string, line int, text string")
    dash, even = Rule("dash", "regex", "m", builtin="dash_present", seed=Seed("insert_em_dash")), Rule("slop", "regex", "m", builtin="slop_vocab", words=("nowhere",), seed=Seed("insert_em_dash"))
    made, refused = seed.seed_corpus(bases, Ruleset((dash,)), mode=mode)
    assert made.count() == 3 and {int(r.base_id[1:]) % 60 for r in made.collect()} == {7} and refused.count() < 300
    none, refused = seed.seed_corpus(bases, Ruleset((even,)), mode=mode)
    assert none.count() == 0 and refused.count() == 300


def test_a_refused_fault_of_the_bank_may_be_planted_again(spark):
    """Against the sequential form: a fault counts as used only if its text was accepted."""
    base = "The river ran low, and the mill stood still through the dry month of August {}. Nobody in the village could say why it had come so early this year."
    rows = [(f"C{i:02d}", f"f{i}", 1, base.format(i)) for i in range(20)]
    rules = Ruleset((DASH, Rule("j", "judgment", "m", what="w", criteria=("a", "b"), seed=Seed(splice=("Planted here.",)))))
    bank = seed.Bank({"j": [(f, []) for f in ("A dash \u2014 here.", "Another \u2014 there.", "Planted one.", "Planted two.")]}, {})
    df = spark.createDataFrame(rows, "id string, file string, line int, text string")
    refusals = 0
    for value in (1, 2, 3):
        draws, used, want = prng.Draws(prng.key_py(f"{value}:j")), set(), []
        for id_, _, _, text in draws.shuffled(rows):
            faults = bank.ordered("j", text)
            new, fault = seed.plant(rules.rules[1], text, draws, [f for f in faults if f not in used] or faults)
            if "\u2014" in new:
                refusals += 1
                continue
            used.add(fault)
            want.append((id_, fault, new))
            if len(want) == 3:
                break
        made, refused = seed.seed_corpus(df, rules, seed=value, bank=bank)
        assert [(r.base_id, r.sentence, r.text) for r in made.orderBy("id").collect()] == want
        assert {r.reason for r in refused.collect()} <= {"also tripped dash"}
    assert refusals > 0


def test_near_misses_draw_hosts_from_all(spark):
    rows = [(f"C{i:04d}", f"f{i}", f"One {i}. Two. Three.") for i in range(1_500)]
    rules, bank = Ruleset((Rule("j", "judgment", "m", what="w", criteria=("a", "b")), Rule("k", "judgment", "m", what="w", criteria=("a", "b")))), seed.Bank({}, {"j": [(f"Near {i}.", "why") for i in range(9)], "k": [("Close.", "why")]})
    df = spark.createDataFrame(rows, "id string, file string, text string")
    got = seed.near_misses(spark, df, rules, bank).collect()
    assert got == seed.near_misses(spark, rows, rules, bank).collect() and len(got) == 10 and max(r.base_id for r in got) >= "C1000"


def test_scrub():
    key = "sk-0123456789abcdefghij"
    assert scrub.scrub(f"x {key} y {key[:17]} z {key[-16:]}", [key]) == "x [key hidden] y [key hidden] z [key hidden]"
    assert scrub.scrub("short", ["short"]) == "short" and scrub.scrub("12345678", ["12345678"]) == "[key hidden]"


def test_live(spark):
    assert one(spark, "One. Two!  three", live.sentence_prefixes) == ["One.", "One. Two!", "One. Two!  three"]
    df = spark.createDataFrame([("f", 1, "Well — done, delves", 10)], "file string, line int, text string, start int")
    got = {(r.rule, r.start, r.end, r.reaction) for r in live.page_flags(df, Ruleset((DASH, Rule("slop", "regex", "m", builtin="slop_vocab")))).collect()}
    assert got == {("dash", 10, 21, "wrinkle"), ("slop", 23, 29, "wrinkle")}
    r = spark.range(1).select(live.round_reaction(F.lit(["twitch", "recoil"])).alias("a"), live.round_reaction(F.array().cast("array<string>")).alias("b"), live.reaction(F.lit("judgment"), F.lit(0.85), F.lit(0.7)).alias("c")).first()
    assert tuple(r) == ("recoil", "approve", "recoil")


def test_consent(tmp_path):
    path = str(tmp_path / "c" / "consent.json")
    with pytest.raises(ConsentError):
        request(["a.example"], 3, path)
    assert request(["a.example"], 3, path, env={"QUILLWORKS_SEND": "a.example"}) == "env" and request(["a.example"], 3, path, yes=True) == "yes"
    assert request(["a.example"], 3, path, ask=lambda q: "always") == "asked" and request(["a.example"], 3, path) == "stored"
    with pytest.raises(ConsentError):
        request(["a.example", "b.example"], 3, path, ask=lambda q: "n")


def test_streaming(spark, tmp_path):
    from quillworks.streaming import drafts as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one — two")
    rules = Ruleset((DASH,))
    run = lambda: S.keep_latest(S.stream_drafts(spark, str(tmp_path / "in")), rules, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.md").write_text("x\n\ny — z")
    run()
    assert sorted(r.line for r in S.latest(spark, str(tmp_path / "out")).collect()) == [1, 3]


def test_default_rules_stay_quiet_on_structure(spark):
    text = "---\ntitle: a: b: c: d\n---\n\n| a: | b: |\n| --- | --- |\n| c: | d: |\n\n<!-- x: y: z: — -->\n\n> quoted — text\n\n[a]: http://x.example\n\nPages 10–20 at 10:30.\n"
    assert check(spark.createDataFrame([("s", text)], "file string, text string"), default_ruleset()).flags.count() == 0


def test_recording(spark, tmp_path):
    import json

    from quillworks.operators import replay
    from quillworks.sources.files import load_recording

    drafts = spark.createDataFrame([("f", "One bad. Two fine.")], "file string, text string")
    asked = live.recordable(drafts).select(F.sha2("text", 256).alias("key"), "text", F.lit('{"j": 1}').alias("questions"))
    done = judge.run_judge(asked, judge.Recorded([("fine", {"j": 0.2})], {"j": 0.9})).checkpoint()
    value = replay.recording_of(done, asked.select("key", "text"), "2026-01-01")
    assert [r["match"] for r in value["responses"]] == ["One bad.", "One bad. Two fine."]
    (tmp_path / "r.json").write_text(json.dumps(value))
    again = load_recording(str(tmp_path), "r").judge()
    assert [again.ask(t, '{"j": 1}')["nouls"].get("j") for t in ("One bad.", "One bad. Two fine.", "else")] == [0.9, 0.2, None]
    with pytest.raises(ValueError):
        replay.recording_of(done.withColumn("outcome", F.lit("failed")), asked.select("key", "text"))


def test_usage_and_skip_lines(spark):
    from quillworks.operators import flags, judge

    rows = [
        ("a", "answered", {"r": 0.9}, "m", 1000, 10, True, 2, 30, None),
        ("b", "failed", None, "m", 500, 0, True, 1, 20, "timed out"),
        ("c", "not sent", None, "m", 0, 0, True, 0, 0, "timed out"),
    ]
    outcomes = spark.createDataFrame(rows, judge.ANSWERS)
    got = flags.usage(outcomes, spark.range(4), 0.1).first()
    assert (got.requests, got.retries, got.input_tokens, got.latency_ms, got.cached) == (3, 1, 1500, 50, 4)
    assert abs(got.usd - 0.00015) < 1e-12 and "$0.000150 at $0.100 a million" in got.text
    free = flags.usage(outcomes).first()
    assert free.usd is None and free.cached == 0 and "no price known" in free.text
    assert flags.usage(outcomes.limit(0)).first().requests == 0
    skipped = [("f", 9, "failed", "timed out"), ("f", 3, "failed", "timed out"), ("g", 1, "failed", "refused"), ("h", 1, "not sent", "timed out"), ("h", 2, "not sent", "timed out")]
    lines = flags.skip_lines(spark.createDataFrame(skipped, "file string, line int, outcome string, reason string"))
    assert sorted(r.text for r in lines.collect()) == [
        "asking stopped (timed out), 2 paragraphs were left unsent",
        "no judgment of 2 paragraphs, timed out (the first is f:3)",
        "no judgment of g:1, refused",
    ]
