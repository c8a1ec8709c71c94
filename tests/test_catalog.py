"""Every core query against its SQL in DuckDB, over the driver's smallest tables where they are there."""

import math
import os

import pytest

from quillworks import queries as Q

DATA = os.environ.get("QUILLWORKS_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(row):
    return tuple("" if v is None else ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(plain(r[c] for c in cols) for r in df.collect())
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(plain(r[i] for i in at) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "file"
    assert set(Q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_plan_of_the_check_has_no_exchange_and_no_python(spark):
    from quillworks.operators.chunk import chunk_plain
    from quillworks.operators.countable import countable_flags
    from quillworks.sources.ruleset import Rule, Ruleset

    df = spark.createDataFrame([("f", "a — b")], "file string, text string")
    rules = Ruleset((Rule("d", "regex", "m", builtin="dash_present"), Rule("r", "regex", "m", builtin="sentence_rhythm")))
    flags = countable_flags(chunk_plain(df), rules)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" not in plan


def texts_table(spark, tmp_path, rows):
    """A folder whose only table is documents."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_call_slots_of_every_document(spark, tmp_path):
    ids = [0, 1, 199, 200, 201, 5_000, 10**9 + 1]
    got = Q.queries()["call_slots"](spark, texts_table(spark, tmp_path, [(i, "x") for i in ids])).collect()
    assert sorted(map(tuple, got)) == sorted((r, i, f"m{p}", (p - i) % 3) for r in (1, 2) for i in ids for p in range(3))


def test_sentence_prefixes_of_long_texts(spark, tmp_path):
    import re

    from pyspark.sql import functions as F

    from quillworks.functions import text as T
    from quillworks.operators import live

    ws = f"[{T.WS_SET}]"
    texts = ["One. Two!  three", "", " \n ", None, "A.\r\nB?\rC \u00a0", "no end", " x. ", "...  ...", "A.\x01b. c", "é𝄞. \u3000Z!", "One sentence here. " * 300, "x" * 4_000, ("Ab c!\n" * 9 + "d ") * 400]
    d = texts_table(spark, tmp_path, list(enumerate(texts)))
    want = []
    for i, t in enumerate(texts):
        whole = re.sub(r"\r\n?", "\n", t or "")
        ends = [m.end() for m in re.finditer(f"(?<=[.!?]){ws}+", whole)] + [len(whole)]
        lengths = list(dict.fromkeys(len(re.sub(f"{ws}+$", "", whole[:e])) for e in ends))
        want += [(i, nth, n) for nth, n in enumerate(n for n in lengths if n)]
    assert sorted(map(tuple, Q.queries()["sentence_prefixes"](spark, d).collect())) == want
    both = spark.read.parquet(f"{d}/documents.parquet").where("doc_id <> 8 and length(text) < 6000").select(live.prefix_lengths(F.col("text")).alias("n"), F.transform(live.sentence_prefixes(F.col("text")), F.length).alias("m"))
    assert all(r.n == r.m for r in both.collect())


def test_kinds_of_whole_documents(spark, tmp_path):
    from quillworks.catalog.texts import WRAPS

    two = "one two three four five six\nseven eight nine ten eleven twelve\n\nlast | one"
    texts = [two] * 8 + ["a b c\r\nd e f"] * 8 + ["\n".join(["a line of words."] * 3_000)] * 8
    d = texts_table(spark, tmp_path, list(enumerate(texts)))
    both = {"prose": "prose", "heading": "heading", "list": "list", "block_quote": "block_quote", "link_definition": "link_definition"}
    want = [(f"doc-{i}", "prose" if k == "front_matter" else k, 1) for i, k in enumerate(WRAPS)] + [(f"doc-{i}", both.get(k, "prose"), {"table": 6, "front_matter": 5}.get(k, 4)) for i, k in enumerate(WRAPS)]
    want += [(f"doc-{i}", WRAPS[i % 8], 1) for i in range(8, 24)]
    assert sorted(map(tuple, Q.queries()["chunk_kinds"](spark, d).collect())) == sorted(want)
    # Lists: one of 12 words, two shorter ones, one long one.
    mix = {r.kind: (r.n, r.n_prose_like) for r in Q.queries()["chunk_kind_mix"](spark, d).collect()}
    n = {k: sum(x[1] == k for x in want) for k in WRAPS}
    assert mix == {k: (n[k], {"prose": n[k], "block_quote": n[k], "list": 2}.get(k, 0)) for k in WRAPS}


def test_marks_of_lists_are_no_words(spark, tmp_path):
    # 11 words are too few and 12 are enough, however many lines bear a mark.
    texts = ["one two three four five six seven eight nine ten eleven", "one two three four five six\nseven eight nine ten eleven", "a\nb\nc\nd\ne\nf", "one two three four five six\nseven eight nine ten eleven twelve"]
    d = texts_table(spark, tmp_path, [(8 * i + 2, t) for i, t in enumerate(texts)])
    assert [tuple(r) for r in Q.queries()["chunk_kind_mix"](spark, d).collect()] == [("list", 4, 1)]


def test_whole_texts_are_scrubbed_and_masked(spark, tmp_path):
    from quillworks.operators.scrub import HIDDEN, scrub

    key = "sk-live-0123456789abcdef-XYZ"
    texts = [f"{'x' * 50}\n{key} and {key[:20]}.", "plain", "", f"{'long ' * 5_000}{key}"]
    d = texts_table(spark, tmp_path / "a", list(enumerate(texts)))
    got = dict(map(tuple, Q.queries()["scrubbed_messages"](spark, d).collect()))
    assert got == {i: f"error with {HIDDEN} and {HIDDEN} at {HIDDEN}: {scrub(t, [key])}" for i, t in enumerate(texts)} and key not in "".join(got.values())
    texts = ["x | y\n\n`p | q`", "plain", "`open | tick", f"{'w ' * 100}\n\nx | `y`", "``a | ` | b``"]
    d = texts_table(spark, tmp_path / "b", list(enumerate(texts)))
    flags = Q.queries()["code_masked_flags"](spark, d).collect()
    assert sorted((r.file, r.line) for r in flags) == [("doc-0", 3), ("doc-1", 1), ("doc-2", 3), ("doc-3", 1), ("doc-3", 5)]
