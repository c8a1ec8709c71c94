"""Chunking, countable rules, transforms and guards over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import countable as R
from ..operators import flags as G
from ..operators import judge, live, scrub
from ..operators import seed as S
from ..sources.ruleset import Rule, Ruleset
from .common import PARAGRAPHS, documents, drafts, duck_words, table

DASH = Rule("dash_present", "regex", "dash", builtin="dash_present")
COLON = Rule("colon_heavy", "regex", "colons", builtin="colon_count", min=3)
RHYTHM = Rule("sentence_rhythm", "regex", "rhythm", builtin="sentence_rhythm")
SLOP = Rule("slop_vocab", "regex", "slop", builtin="slop_vocab")
PIPE = Rule("pipe", "regex", "pipe", pattern=r"\|", chunks=("prose", "list", "table"))
BANNED = Rule("banned_words", "regex", "banned", builtin="banned_words", words=("ent", "the", "sur"))
FLAG_SET = Ruleset((RHYTHM, PIPE, DASH, COLON, SLOP))

#: Kinds of block that wrap a document by doc_id % 8, in Spark and in SQL.
WRAPS = ("prose", "heading", "list", "block_quote", "table", "html_comment", "link_definition", "front_matter")


def check_flags(spark: SparkSession, d: str) -> DataFrame:
    """The countable check over paragraphs: rhythm and a pattern, with the dash, colon and vocabulary rules compiled beside them."""
    return R.countable_flags(C.chunk_drafts(drafts(spark, d)), FLAG_SET)


RHYTHM_SQL = r"""
sentences AS (SELECT file, line, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM paragraphs),
counted AS (SELECT file, line, len(regexp_extract_all(s, '[^\s]+')) AS w FROM sentences),
even AS (
  SELECT file, line FROM counted WHERE w > 0 GROUP BY file, line
  HAVING count(*) >= 4 AND sum(w) >= 60 AND sqrt(CAST(count(*) * sum(w * w) - sum(w) * sum(w) AS DOUBLE)) / sum(w) < 0.25)"""


def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunk_drafts(drafts(spark, d))
    return c.select("file", "line", "seq", F.sha2("text", 256).alias("digest"), T.word_count(F.col("text")).cast("long").alias("words"))


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as the kinds of block by doc_id: marks stand before each line that is not blank."""
    body = T.normalise_newlines(F.col("text"))
    marked = lambda mark: F.regexp_replace(body, F.lit(rf"(?dm)^(?=[^\n]*{T.NOT_WS})"), mark)
    case = [
        body, marked(F.lit("## ")), marked(F.lit("- ")), marked(F.lit("> ")),
        F.concat(F.lit("a | b\n--- | ---\n"), body), F.concat(F.lit("<!-- "), body, F.lit(" -->")), marked(F.concat(F.lit("[a]: https://x.example/"), F.col("doc_id").cast("string"), F.lit(" "))),
        F.concat(F.lit("---\nkey: "), body, F.lit("\n---")),
    ]
    text = case[0]
    for i in range(1, 8):
        text = F.when(F.col("doc_id") % 8 == i, case[i]).otherwise(text)
    return documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), text.alias("text"))


#: Documents of the driver's tables hold no blank lines, so each is one block; the mark of a list counts as a word on each line.
WRAPPED = rf"""
wrapped AS (
  SELECT doc_id, 'doc-' || doc_id AS file, ['prose', 'heading', 'list', 'block_quote', 'table', 'html_comment', 'link_definition', 'front_matter'][doc_id % 8 + 1] AS kind,
         {duck_words('text')} + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s]'))) AS words FROM documents)"""


def chunk_kind_mix(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunk_drafts(wrapped(spark, d))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.prose_like(F.col("text"), F.col("kind"))).alias("n_prose_like"))


def chunk_kinds(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_drafts(wrapped(spark, d)).select("file", "kind", "line")


def sentence_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunk_drafts(drafts(spark, d))
    return c.select("file", "line", F.posexplode(T.sentence_bounds(F.col("text"))).alias("nth", "b")).select("file", "line", "nth", F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def sentence_rhythm(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunk_drafts(drafts(spark, d)).select("file", "line", F.explode(F.array(R.rhythm(F.col("text")))).alias("r"))
    return c.where("r.n > 0").select("file", "line", F.col("r.n").alias("n_sentences"), F.col("r.words").alias("n_words"), F.round("r.cv", 9).alias("cv"))


def planted(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where(F.col("text").contains(", "))


def dash_flags_planted(spark: SparkSession, d: str) -> DataFrame:
    rows = planted(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), S.comma_edit(F.col("text"), 1, " — ").alias("text"))
    return R.countable_flags(C.chunk_drafts(rows), Ruleset((DASH,))).select("file", "line", "rule", "probability")


def dash_edits(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", F.sha2(S.comma_edit(F.col("text"), 1, " — "), 256).alias("digest"))


def dash_numeral_ranges(spark: SparkSession, d: str) -> DataFrame:
    """An en dash between digits, beside one, and beside none."""
    left, right = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    text = F.concat(F.when(left, "pages 1").otherwise("pages a"), F.lit("–"), F.when(right, "2 ok").otherwise("b ok"))
    return documents(spark, d).select("doc_id", F.size(R.dash_lines(text)).cast("long").alias("hits"))


def colon_flags_planted(spark: SparkSession, d: str) -> DataFrame:
    rows = planted(spark, d).where(T.occurrences(F.col("text"), ", ") >= 3)
    rows = rows.select(F.concat(F.lit("doc-"), "doc_id").alias("file"), S.comma_edit(F.col("text"), 3, ": ").alias("text"))
    return R.countable_flags(C.chunk_drafts(rows), Ruleset((COLON,))).select("file", "line", "rule")


def colon_mask_pages(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", T.occurrences(html, ":").cast("long").alias("colons"), T.occurrences(R.without_links(F.concat(F.col("url"), F.lit(" 12:30 "), html)), ":").cast("long").alias("counted"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a listed word in some inflection, or a literal sense of it, at their end."""
    forms = ["It delves.", "We unlock the door now.", "Landscaping.", "A landscape architect.", "Navigated to it.", "navigates well", "seamlessly", "MYRIAD ways", "realmish", "showcasing"]
    word = F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % len(forms) + 1).cast("int"))
    return documents(spark, d).select("doc_id", F.concat("text", F.lit("\n"), word).alias("text"))


def slop_flags_planted(spark: SparkSession, d: str) -> DataFrame:
    rows = vocabulary(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), "text")
    return R.countable_flags(C.chunk_drafts(rows), Ruleset((SLOP,))).select("file", "line", "rule")


def banned_word_flags(spark: SparkSession, d: str) -> DataFrame:
    return R.countable_flags(C.chunk_drafts(drafts(spark, d)), Ruleset((BANNED,))).select("file", "line", "rule")


def pattern_rule_flags(spark: SparkSession, d: str) -> DataFrame:
    return R.countable_flags(C.chunk_drafts(drafts(spark, d)), Ruleset((PIPE,))).select("file", "line", "rule")


def whole(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), "text")


def pattern_cap_notes(spark: SparkSession, d: str) -> DataFrame:
    return R.pattern_notes(C.chunk_drafts(whole(spark, d)), Ruleset((PIPE,)))


def merged_flags(spark: SparkSession, d: str) -> DataFrame:
    """Three arms over the same paragraphs; the first arm's flag wins."""
    first = check_flags(spark, d)
    second = first.withColumn("probability", F.lit(0.9)).withColumn("message", F.lit("second"))
    third = C.chunk_drafts(drafts(spark, d)).where("line = 1").select("file", "line", F.lit("pipe").alias("rule"), F.lit("judgment").alias("kind"), F.lit(0.8).alias("probability"), F.lit("third").alias("message"))
    return G.merge_flags(first, second, third)


def equalized_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", S.equalize(F.col("text")).alias("e")).where("e is not null")
    return rows.select("doc_id", F.sha2("e", 256).alias("digest"), F.size(F.split("e", r"\. ")).cast("long").alias("n"))


def splice_positions(spark: SparkSession, d: str) -> DataFrame:
    r = F.lit(0.5)
    cols = [F.sha2(S.splice(F.col("text"), F.lit("A planted line."), p, r), 256).alias(p) for p in ("start", "end", "any")]
    return documents(spark, d).select("doc_id", *cols)


def clean_base_split(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunk_drafts(drafts(spark, d)).select("file", "line", R.trips((RHYTHM, PIPE, DASH), F.col("text")).alias("t"))
    return c.select("file", "line", (F.size("t") == 0).alias("clean"), F.when(F.size("t") > 0, F.concat(F.lit("already trips "), F.array_join("t", ", "))).alias("reason"))


def state_guard(spark: SparkSession, d: str) -> DataFrame:
    """Documents, some blanked, some with a data address or a long base64 run."""
    bad = F.when(F.col("doc_id") % 7 == 1, F.lit("  ")).when(F.col("doc_id") % 7 == 2, F.concat(F.lit("see data:image/png;base64,AAAA "), "text")).when(F.col("doc_id") % 7 == 3, F.concat(F.repeat(F.lit("Ab1+"), 70), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", judge.refusal(bad).alias("reason"))


def sentence_prefixes(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", F.posexplode(live.prefix_lengths(F.col("text"))).alias("nth", "chars"))
    return rows.select("doc_id", "nth", F.col("chars").cast("long").alias("chars"))


def scrubbed_messages(spark: SparkSession, d: str) -> DataFrame:
    key = "sk-live-0123456789abcdef-XYZ"
    note = F.concat(F.lit("error with "), F.substring(F.lit(key), 1, 28 - 0), F.lit(" and "), F.lit(key[:18]), F.lit(" at "), F.lit(key[-17:]), F.lit(": "), F.col("text"))
    return documents(spark, d).select("doc_id", scrub.scrub_column(note, [key]).alias("message"))


def page_reactions(spark: SparkSession, d: str) -> DataFrame:
    p = judge.synthetic(F.col("doc_id"), F.lit(1))
    return documents(spark, d).select("doc_id", live.reaction(F.lit("judgment"), p, F.lit(0.7)).alias("reaction"))


def chunk_places(spark: SparkSession, d: str) -> DataFrame:
    x = drafts(spark, d)
    return C.place_chunks(C.chunk_drafts(x), x).select("file", "line", "start")


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


def fenced(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their second line fenced, in a list item or a quote for some."""
    lead = F.element_at(F.array(F.lit(""), F.lit("> "), F.lit("  ")), (F.col("doc_id") % 3 + 1).cast("int"))
    first = F.when(F.col("doc_id") % 3 == 2, F.lit("- ")).when(F.col("doc_id") % 3 == 1, F.lit("> ")).otherwise(F.lit(""))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 1, F.concat(lead, F.lit("```\n"), lead, x, F.lit("\n"), lead, F.lit("```"))).when(i == 0, F.concat(first, x)).otherwise(x))
    return documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.array_join(lines, "\n").alias("text"))


def fenced_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_drafts(fenced(spark, d)).select("file", "line", "kind", F.sha2("text", 256).alias("digest"))


def code_masked_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.concat(F.lit("`a | b` and "), F.when(F.col("doc_id") % 2 == 0, F.lit("``c | d``")).otherwise(F.lit("c | d")), F.lit(" end\n\n"), F.col("text")).alias("text"))
    return R.countable_flags(C.chunk_drafts(rows), Ruleset((PIPE,))).select("file", "line", "rule")


def long_splits(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunk_drafts(whole(spark, d), 2000)
    return c.select("file", "line", "seq", F.col("part.index").alias("piece"), F.col("part.of").alias("of"), F.length("text").cast("long").alias("chars"))


QUERIES = [
    check_flags, chunk_paragraphs, chunk_kind_mix, chunk_kinds, sentence_bounds, sentence_rhythm, dash_flags_planted, dash_edits, dash_numeral_ranges,
    colon_flags_planted, colon_mask_pages, slop_flags_planted, banned_word_flags, pattern_rule_flags, pattern_cap_notes, merged_flags,
    equalized_sentences, splice_positions, clean_base_split, state_guard, sentence_prefixes, scrubbed_messages, page_reactions, chunk_places, excerpts,
    fenced_chunks, code_masked_flags, long_splits,
]

FLAGS_SQL = f"""
flags AS (
  SELECT file, line, 'sentence_rhythm' AS rule, 'regex' AS kind, 1.0::DOUBLE AS probability, 'rhythm' AS message FROM even
  UNION ALL SELECT file, line, 'pipe', 'regex', 1.0::DOUBLE, 'pipe' FROM paragraphs WHERE contains(text, '|'))"""

#: Bounds of sentences: cut behind white space that follows a terminator.
BOUNDS = r"""
cut AS (SELECT {keys}, text, regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g') AS m FROM {source}),
part AS (SELECT {keys}, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) - 1 AS nth FROM cut),
sized AS (SELECT {keys}, p, nth, sum(length(p)) OVER (PARTITION BY {keys} ORDER BY nth) AS e FROM part),
bounds AS (SELECT {keys}, CAST(nth AS INTEGER) AS nth, CAST(e - length(p) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM sized WHERE length(p) > 0)"""

SQL = {
    "check_flags": f"WITH {PARAGRAPHS}, {RHYTHM_SQL}, {FLAGS_SQL} SELECT * FROM flags",
    "chunk_paragraphs": f"WITH {PARAGRAPHS} SELECT file, line, seq, sha256(text) AS digest, {duck_words('text')} AS words FROM paragraphs",
    "chunk_kind_mix": f"""WITH {WRAPPED} SELECT kind, count(*) AS n,
        count(*) FILTER (kind IN ('prose', 'block_quote') OR (kind = 'list' AND words >= 12)) AS n_prose_like FROM wrapped GROUP BY kind""",
    "chunk_kinds": f"WITH {WRAPPED} SELECT file, kind, CAST(1 AS INTEGER) AS line FROM wrapped",
    "sentence_bounds": f"WITH {PARAGRAPHS}, {BOUNDS.format(keys='file, line', source='paragraphs')} SELECT file, line, nth, start, \"end\" FROM bounds",
    "sentence_rhythm": rf"""WITH {PARAGRAPHS}, {RHYTHM_SQL} SELECT file, line, count(*) AS n_sentences, CAST(sum(w) AS BIGINT) AS n_words,
        round(stddev_pop(w) / avg(w), 9) AS cv FROM counted WHERE w > 0 GROUP BY file, line""",
    "dash_flags_planted": """SELECT 'doc-' || doc_id AS file,
        CAST(1 + length(substr(text, 1, length(text) - instr(reverse(text), ' ,') - 1)) - length(replace(substr(text, 1, length(text) - instr(reverse(text), ' ,') - 1), chr(10), '')) AS INTEGER) AS line,
        'dash_present' AS rule, 1.0::DOUBLE AS probability FROM documents WHERE contains(text, ', ')""",
    "dash_edits": """SELECT doc_id, sha256(substr(text, 1, length(text) - instr(reverse(text), ' ,') - 1) || ' — ' || substr(text, length(text) - instr(reverse(text), ' ,') + 2)) AS digest
        FROM documents WHERE contains(text, ', ')""",
    "dash_numeral_ranges": "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS hits FROM documents",
    "colon_flags_planted": """WITH s AS (SELECT doc_id, string_split(text, ', ') AS p FROM documents WHERE (length(text) - length(replace(text, ', ', ''))) / 2 >= 3)
        SELECT 'doc-' || doc_id AS file, CAST(1 + length(array_to_string(p[1:len(p) - 3], '')) - length(replace(array_to_string(p[1:len(p) - 3], ''), chr(10), '')) AS INTEGER) AS line, 'colon_heavy' AS rule FROM s""",
    "colon_mask_pages": r"""WITH m AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url || ' 12:30 ' || html, '[a-zA-Z][a-zA-Z0-9+.-]*://[^\s]+', ' ', 'g'), '\b\d{1,2}:\d{2}(:\d{2})?\b', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages)
        SELECT page_id, length(html) - length(replace(html, ':', '')) AS colons, length(t) - length(replace(t, ':', '')) AS counted FROM m""",
    "slop_flags_planted": """SELECT 'doc-' || doc_id AS file, CAST(2 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS line, 'slop_vocab' AS rule
        FROM documents WHERE doc_id % 10 IN (0, 2, 5, 6, 7, 9)""",
    "banned_word_flags": rf"""WITH {PARAGRAPHS} SELECT file, line, 'banned_words' AS rule FROM paragraphs
        WHERE regexp_matches(text, '(?i)\b(?:ent(?:s|es|ed|ing|ly|ment|ments|ion|ions)?|the(?:s|d|ly|ment|ments)?|th(?:es|ed|ing|ion|ions)|sur(?:s|es|ed|ing|ly|ment|ments|ion|ions)?)\b')""",
    "pattern_rule_flags": f"WITH {PARAGRAPHS} SELECT file, line, 'pipe' AS rule FROM paragraphs WHERE contains(text, '|')",
    "pattern_cap_notes": "SELECT 'doc-' || doc_id AS file, CAST(1 AS INTEGER) AS line, 'pipe' AS rule FROM documents WHERE length(text) > 8000",
    "merged_flags": f"""WITH {PARAGRAPHS}, {RHYTHM_SQL}, {FLAGS_SQL}
        SELECT * FROM flags UNION ALL
        SELECT p.file, p.line, 'pipe', 'judgment', 0.8::DOUBLE, 'third' FROM paragraphs p WHERE p.line = 1 AND NOT contains(p.text, '|')""",
    "splice_positions": rf"""WITH {BOUNDS.format(keys='doc_id', source='documents')},
        n AS (SELECT doc_id, count(*) AS c FROM bounds GROUP BY doc_id),
        k AS (SELECT doc_id, CASE WHEN c <= 2 THEN greatest(0, c - 1) ELSE 1 + CAST(floor(0.5::DOUBLE * (c - 2)) AS BIGINT) END AS after FROM n),
        pl AS (SELECT d.doc_id, d.text, coalesce(b."end", 0) AS pos FROM documents d JOIN k USING (doc_id) LEFT JOIN bounds b ON b.doc_id = k.doc_id AND b.nth = k.after - 1)
        SELECT doc_id, sha256('A planted line. ' || regexp_replace(text, '^\s+', '')) AS start, sha256(regexp_replace(text, '\s+$', '') || ' A planted line.') AS "end",
               sha256(CASE WHEN pos = 0 THEN 'A planted line. ' || regexp_replace(text, '^\s+', '') ELSE regexp_replace(substr(text, 1, pos), '\s+$', '') || ' A planted line.' ||
                 CASE WHEN pos < length(text) THEN ' ' || regexp_replace(substr(text, pos + 1), '^\s+', '') ELSE '' END END) AS "any" FROM pl""",
    "clean_base_split": f"""WITH {PARAGRAPHS}, {RHYTHM_SQL},
        t AS (SELECT p.file, p.line, e.file IS NOT NULL AS r, contains(text, '|') AS q FROM paragraphs p LEFT JOIN even e ON p.file = e.file AND p.line = e.line)
        SELECT file, line, NOT (r OR q) AS clean, CASE WHEN r OR q THEN 'already trips ' || concat_ws(', ', CASE WHEN r THEN 'sentence_rhythm' END, CASE WHEN q THEN 'pipe' END) END AS reason FROM t""",
    "state_guard": """SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'blank' WHEN length(text) + CASE doc_id % 7 WHEN 2 THEN 31 WHEN 3 THEN 281 ELSE 0 END > 24000 THEN 'too long'
        WHEN doc_id % 7 = 2 THEN 'data address' WHEN doc_id % 7 = 3 THEN 'encoded run' END AS reason FROM documents""",
    "sentence_prefixes": rf"""WITH {BOUNDS.format(keys='doc_id', source='documents')},
        trimmed AS (SELECT doc_id, start + length(regexp_replace(p, '\s+$', '')) AS chars FROM (SELECT doc_id, e - length(p) AS start, p FROM sized WHERE length(p) > 0))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chars) - 1 AS INTEGER) AS nth, CAST(chars AS BIGINT) AS chars FROM (SELECT DISTINCT doc_id, chars FROM trimmed WHERE chars > 0)""",
    "page_reactions": "SELECT doc_id, CASE WHEN p + 1e-9::DOUBLE >= 0.85::DOUBLE THEN 'recoil' WHEN p >= 0.7::DOUBLE THEN 'twitch' ELSE 'approve' END AS reaction FROM (SELECT doc_id, ((doc_id * 7919 + 104729) % 10007) / 10006.0::DOUBLE AS p FROM documents)",
    "chunk_places": f"""WITH {PARAGRAPHS}, l AS (SELECT file, n, sum(length(text) + 1) OVER (PARTITION BY file ORDER BY n) - length(text) - 1 AS start FROM lines)
        SELECT p.file, p.line, CAST(l.start AS INTEGER) AS start FROM paragraphs p JOIN l ON p.file = l.file AND p.line = l.n""",
    "excerpts": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS excerpt FROM f""",
    "scrubbed_messages": "SELECT doc_id, 'error with [key hidden] and [key hidden] at [key hidden]: ' || text AS message FROM documents",
    # Documents of the driver's tables hold no blank line and no backtick: one paragraph behind the marked one, patterns read it up to their cap.
    "code_masked_flags": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) + 2 AS n FROM (SELECT doc_id, substr(text, 1, 8000) AS text FROM documents))
        SELECT 'doc-' || doc_id AS file, CAST(1 AS INTEGER) AS line, 'pipe' AS rule FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'doc-' || doc_id, CAST(n AS INTEGER), 'pipe' FROM l WHERE contains(t, '|')""",
}
