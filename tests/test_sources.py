import os

import pytest

from quillworks.sources import drafts, files, guard, yaml_subset
from quillworks.sources.ruleset import RulesetError, Rule, Ruleset, default_ruleset, dropped_by_reason, known_tags, merge, parse_ruleset, pattern_for_java, resolve, select

PAIR = """version: 1
threshold: 0.5
rules:
  - id: d
    kind: regex
    builtin: dash_present
    message: "no dash"
  - id: p
    kind: regex
    pattern: '\\bvery\\b'
    flags: i
    message: weak
"""


@pytest.mark.parametrize("text,value", [
    ("a: 1\nb: -2.5\nc: true\nd: null\ne: x y\n", {"a": 1, "b": -2.5, "c": True, "d": None, "e": "x y"}),
    ("l:\n  - a\n  - k: v\n    n: 2\n  -\n    - deep\n", {"l": ["a", {"k": "v", "n": 2}, ["deep"]]}),
    ("l:\n- a\n- b\nm: {a: [1, 'x'], b: \"y # z\"} # note\n", {"l": ["a", "b"], "m": {"a": [1, "x"], "b": "y # z"}}),
    ("t: |\n  a\n    b\n\nu: >\n  c\n  d\n\n  e\nv: |-\n  f\n\n", {"t": "a\n  b\n", "u": "c d\ne\n", "v": "f"}),
    ("# only a comment\n", None), ("'q''s': 'a: b'\n", {"q's": "a: b"}), ("u: http://x.example/#a\n", {"u": "http://x.example/#a"}),
])
def test_yaml_reads(text, value):
    assert yaml_subset.load(text) == value


@pytest.mark.parametrize("text", [
    "a: &x 1", "a: *x", "a: !t 1", "<<: b", "a: 1\na: 2", "a:\n\tb: 1", "__proto__: 1", "a: [1,", "a: {b}", "---\na: 1\n---\nb: 2", "a: b: c", "a: 'x", "a: 1\n   b: 2", "a: " + "[" * 18 + "]" * 18,
])
def test_yaml_refuses_with_the_line(text):
    with pytest.raises(yaml_subset.YamlError, match=r"f\.yaml:\d+: "):
        yaml_subset.load(text, "f.yaml")


def test_default_rules():
    r = default_ruleset()
    assert len(r.rules) == 15 and sum(x.countable for x in r.rules) == 5 and known_tags(r) == ["marketing"] and r.bar == 0.7
    kept, dropped = select(r)
    assert len(kept.rules) == 10 and list(map(len, dropped_by_reason(dropped).values())) == [5]
    assert len(select(r, only=["marketing"])[0].rules) == 10
    with pytest.raises(RulesetError):
        select(r, only=["nothing"])


def test_merge_replaces_in_place_and_keeps_settings():
    base, own = parse_ruleset(PAIR), Ruleset((Rule("p", "regex", "mine", pattern="x"), Rule("n", "regex", "new", pattern="y")))
    out = merge(base, own)
    assert [(r.id, r.message) for r in out.rules] == [("d", "no dash"), ("p", "mine"), ("n", "new")] and out.bar == 0.5


@pytest.mark.parametrize("change", [
    "version: 2", "threshold: 1.5", "    builtin: other", "    kind: sum", "    message: ''", "    chunks: [page]", "    pattern: '('", "    flags: x", "    id: p",
])
def test_rulesets_that_are_refused(change):
    key = change.strip().split(":")[0]
    lines = [change if line.strip().startswith(f"{key}:") or (key == "id" and line.strip() == "- id: d") else line for line in PAIR.split("\n")]
    if key == "id":
        lines = [line.replace("    id: p", "  - id: p") for line in lines]
    if change not in "\n".join(lines) and key != "id":
        lines.insert(5, change)
    with pytest.raises(RulesetError):
        parse_ruleset("\n".join(lines))


def test_extends(tmp_path):
    (tmp_path / "base.yaml").write_text(PAIR)
    (tmp_path / ".quillworks.yaml").write_text("version: 1\nextends: base.yaml\nother: 1\nrules:\n  - id: p\n    kind: regex\n    pattern: x\n    message: mine\n")
    r = resolve(str(tmp_path))
    assert [x.message for x in r.rules] == ["no dash", "mine"] and "other" in r.warnings[0] and len(r.sources) == 2
    (tmp_path / "base.yaml").write_text("version: 1\nextends: .quillworks.yaml\nrules: []\n")
    with pytest.raises(RulesetError, match="extends itself"):
        resolve(str(tmp_path))
    (tmp_path / ".quillworks.yaml").write_text("version: 1\nextends: ../outside.yaml\nrules: []\n")
    with pytest.raises(RulesetError, match="outside"):
        resolve(str(tmp_path))
    (tmp_path / ".quillworks.yaml").unlink()
    assert len(resolve(str(tmp_path)).rules) == 15
    os.symlink(tmp_path / "base.yaml", tmp_path / ".quillworks.yaml")
    with pytest.raises(RulesetError, match="link"):
        resolve(str(tmp_path))


@pytest.mark.parametrize("pattern", ["(a+)+", "(a*)*b", "(?:a|ab)+", "((x+)y*)+", "(a|a)*", "(a{1,8})+", "(a{0,5})*b", "("])
def test_hostile_patterns(pattern):
    with pytest.raises(RulesetError):
        guard.check_pattern(pattern, "", "w")


@pytest.mark.parametrize("pattern", [r"\bvery\b", "a+b+", "(?:ab)+", "(?:a|b)+", r"x{2,3}", r"[a-z]+\s+[0-9]+"])
def test_patterns_that_are_fine(pattern):
    guard.check_pattern(pattern, "i", "w")


def test_patterns_in_java(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("éunlock it",), ("a b",), ("x_unlock",)], "t string")
    got = rows.select(F.col("t").rlike(pattern_for_java(r"\bunlock\b")), F.col("t").rlike(pattern_for_java(r"a[\s]b"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False)]


def test_files(tmp_path, spark):
    for name, data in (("a.md", b"# hi\n"), ("b.TXT", b"x"), ("c.py", b"x"), (".h.md", b"x"), ("n.md", b"a\0b"), ("u.md", b"\xff\xfe")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.md").write_text("x")
    os.symlink(tmp_path / "a.md", tmp_path / "l.md")
    found, _ = drafts.collect_files([str(tmp_path)])
    assert [os.path.basename(f) for f in found] == ["a.md", "b.TXT", "n.md", "u.md"]
    assert drafts.collect_files([str(tmp_path / "a.md"), str(tmp_path / "l.md")])[1] == [str(tmp_path / "l.md")]
    with pytest.raises(drafts.SourceError):
        drafts.collect_files([str(tmp_path / "none")])
    good, bad = drafts.read_drafts(spark, [str(tmp_path)], str(tmp_path))
    assert sorted(map(tuple, good.collect())) == [("a.md", "# hi\n"), ("b.TXT", "x")]
    assert sorted(map(tuple, bad.collect())) == [("n.md", "holds a NUL byte"), ("u.md", "is not UTF-8")]
    (tmp_path / "l.md").unlink()  # Spark follows links
    assert drafts.read_folder(spark, str(tmp_path))[0].count() == 2


def test_panel_prices_bank_recordings(tmp_path):
    entries, prices = files.parse_panel("version: 1\nprices: {openai: p.yaml}\nmodels:\n  - {id: a, provider: openai, match: '^a', prefer: a-1, budget: 900, reasoning: low}\n")
    assert entries[0].prefer == ("a-1",) and prices == {"openai": "p.yaml"}
    for bad in ("provider: other", "match: '('", "budget: 0", "budget: yes"):
        with pytest.raises(files.FileError):
            files.parse_panel(f"version: 1\nmodels:\n  - id: a\n    provider: judge\n    match: a\n    {bad}\n".replace("    provider: judge\n" if bad.startswith("prov") else "\0", "").replace("    match: a\n" if bad.startswith("match") else "\0", ""))
    rows, cite = files.parse_prices("source: list\nverified_on: 2026-01-02\ncurrency: usd_per_million_tokens\nmodels:\n  - {match: a, input: 1, output: 5}\n", "p")
    assert rows == [(0, "a", 1e-6, 5e-6)] and "2026-01-02" in cite
    with pytest.raises(files.FileError):
        files.parse_prices("source: s\nverified_on: soon\ncurrency: usd_per_million_tokens\nmodels: []\n")
    bank = files.parse_bank({"version": 2, "rules": {"r": {"faults": [{"text": "f", "hosts": ["tea"]}, {"text": "g"}], "hard_negatives": [{"text": "n", "why": "w"}]}}})
    assert bank.ordered("r", "some TEA") == ["f", "g"] and bank.ordered("r", "milk") == ["g", "f"]
    with pytest.raises(files.FileError):
        files.parse_bank({"version": 2, "rules": {"r": {"faults": [], "hard_negatives": []}}})
    (tmp_path / "ok.json").write_text('{"default": {"nouls": {"r": 0.1}}, "responses": [{"match": "a", "nouls": {"r": 0.5}}, {"match": "ab", "nouls": {"r": 0.9}}]}')
    judge = files.load_recording(str(tmp_path), "ok").judge()
    assert [judge.ask(t, '{"r": 1}')["nouls"]["r"] for t in ("xaby", "a", "z")] == [0.9, 0.5, 0.1]
    with pytest.raises(files.FileError):
        files.load_recording(str(tmp_path / "sub"), "../ok")
