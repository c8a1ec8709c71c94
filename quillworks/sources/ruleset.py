"""Rulesets: reading, validation, inheritance and selection.

Rules are few, so they live on the driver; only the selected ones are compiled into a plan.
"""

from __future__ import annotations

import os
import re
import stat
from dataclasses import dataclass, field, replace
from typing import Any

from ..operators.chunk import KINDS
from .yaml_subset import YamlError, load

WRITING = ("prose", "block_quote", "list", "heading")
#: Which kinds of block a built-in reads unless its rule names some: fixed values.
BUILTIN_KINDS = {
    "dash_present": ("prose", "list", "heading"),
    "colon_count": ("prose", "block_quote"),
    "colon_heavy": ("prose", "block_quote"),
    "sentence_rhythm": ("prose", "block_quote"),
    "slop_vocab": WRITING,
    "banned_words": WRITING,
}
TRANSFORMS = ("insert_em_dash", "add_colons", "equalize_sentences", "insert_slop_word", "insert_banned_word")
POSITIONS = ("start", "end", "any")
THRESHOLD = 0.7
KNOWN_KEYS = ("version", "threshold", "off_by_default", "rules", "extends")
NAMES = (".quillworks.yaml", ".quillworks.yml")
MAX_DEPTH = 8


class RulesetError(ValueError):
    pass


@dataclass(frozen=True)
class Seed:
    transform: str | None = None
    count: float = 1
    splice: tuple[str, ...] = ()
    position: str = "any"


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    message: str
    builtin: str | None = None
    pattern: str | None = None
    flags: str = ""
    min: float | None = None
    floor: float | None = None
    min_sentences: float | None = None
    min_words: float | None = None
    words: tuple[str, ...] | None = None
    spared: tuple[str, ...] | None = None
    chunks: tuple[str, ...] | None = None
    what: str | None = None
    not_for: str | None = None
    examples: tuple[str, ...] = ()
    criteria: tuple[str, str] | None = None
    sentence: str | None = None
    tags: tuple[str, ...] = ()
    seed: Seed | None = None

    @property
    def countable(self) -> bool:
        return self.kind == "regex"

    @property
    def kinds(self) -> tuple[str, ...]:
        return self.chunks or BUILTIN_KINDS.get(self.builtin or "", WRITING)


@dataclass(frozen=True)
class Ruleset:
    rules: tuple[Rule, ...]
    threshold: float | None = None
    off_by_default: tuple[str, ...] | None = None
    sources: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default=())

    @property
    def bar(self) -> float:
        return THRESHOLD if self.threshold is None else self.threshold


def _strings(value: Any, what: str, where: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
        raise RulesetError(f"{where}: {what} must be a list of strings that are not empty")
    return tuple(value)


def _text(entry: dict, name: str, where: str, needed: bool = False) -> str | None:
    value = entry.get(name)
    if value is None and not needed:
        return None
    if not isinstance(value, str) or (needed and not value.strip()):
        raise RulesetError(f"{where}: {name} must be a string" + " that is not empty" * needed)
    return value


def _number(entry: dict, name: str, where: str) -> float | None:
    value = entry.get(name)
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise RulesetError(f"{where}: {name} must be a number")
    return value


def _choice(value: Any, among: tuple[str, ...], what: str, where: str) -> Any:
    if value is not None and value not in among:
        raise RulesetError(f"{where}: {what} must be one of {', '.join(among)}")
    return value


def read_seed(value: Any, where: str) -> Seed | None:
    if value is None:
        return None
    if not isinstance(value, dict) or ("transform" in value) == ("splice" in value):
        raise RulesetError(f"{where}: a seed has either transform or splice")
    if "transform" in value:
        return Seed(transform=_choice(value["transform"], TRANSFORMS, "seed.transform", where), count=_number(value, "count", where) or 1)
    return Seed(splice=_strings(value["splice"], "seed.splice", where), position=_choice(value.get("position"), POSITIONS, "seed.position", where) or "any")


def read_rule(entry: Any, file: str) -> Rule:
    if not isinstance(entry, dict):
        raise RulesetError(f"{file}: a rule must be a mapping")
    name = entry.get("id")
    if not isinstance(name, str) or not name.strip():
        raise RulesetError(f"{file}: a rule needs an id")
    where = f'{file}: rule "{name}"'
    common: dict[str, Any] = {
        "id": name, "message": _text(entry, "message", where, True), "seed": read_seed(entry.get("seed"), where),
        "tags": _strings(entry["tags"], "tags", where) if entry.get("tags") is not None else (),
    }
    kind = entry.get("kind")
    if kind == "judgment":
        criteria = entry.get("criteria")
        if not isinstance(criteria, dict):
            raise RulesetError(f"{where}: criteria must hold true and false")
        both = tuple(_text(criteria, k, f"{where}: criteria", True) for k in ("true", "false"))
        examples = _strings(entry["examples"], "examples", where) if entry.get("examples") is not None else ()
        return Rule(kind=kind, what=_text(entry, "what", where, True), not_for=_text(entry, "not_for", where), examples=examples, criteria=both, sentence=_choice(entry.get("sentence"), ("first", "last"), "sentence", where), **common)
    if kind != "regex":
        raise RulesetError(f"{where}: kind must be regex or judgment")
    builtin, pattern, flags = (entry.get(k) for k in ("builtin", "pattern", "flags"))
    if (builtin is None) == (pattern is None):
        raise RulesetError(f"{where}: exactly one of builtin and pattern")
    if flags is not None and (not isinstance(flags, str) or pattern is None):
        raise RulesetError(f"{where}: flags are a string and belong to a pattern")
    if builtin is not None and builtin not in BUILTIN_KINDS:
        raise RulesetError(f"{where}: unknown built-in {builtin!r}")
    if pattern is not None:
        from .guard import check_pattern

        if not isinstance(pattern, str):
            raise RulesetError(f"{where}: pattern must be a string")
        check_pattern(pattern, flags or "", where)
    lists = {ours: _strings(entry[k], k, where) if entry.get(k) is not None else None for k, ours in (("words", "words"), ("except", "spared"), ("chunks", "chunks"))}
    if any(k not in KINDS for k in lists["chunks"] or ()):
        raise RulesetError(f"{where}: chunks must be among {', '.join(KINDS)}")
    numbers = {k: _number(entry, k, where) for k in ("min", "floor", "min_sentences", "min_words")}
    return Rule(kind=kind, builtin=builtin, pattern=pattern, flags=flags or "", **lists, **numbers, **common)


def read_ruleset(value: Any, file: str, needs_rules: bool = True) -> Ruleset:
    if not isinstance(value, dict):
        raise RulesetError(f"{file}: a ruleset must be a mapping")
    if value.get("version") != 1:
        raise RulesetError(f"{file}: version must be 1")
    bar = _number(value, "threshold", file)
    if bar is not None and not 0 <= bar <= 1:
        raise RulesetError(f"{file}: threshold must lie between 0 and 1")
    entries = value.get("rules")
    if entries is None and not needs_rules:
        entries = []
    if not isinstance(entries, list):
        raise RulesetError(f"{file}: rules must be a list")
    rules = tuple(read_rule(x, file) for x in entries)
    ids = [r.id for r in rules]
    if twice := next((i for i in ids if ids.count(i) > 1), None):
        raise RulesetError(f"{file}: two rules have the id {twice!r}")
    off = value.get("off_by_default")
    return Ruleset(
        rules, bar, _strings(off, "off_by_default", file) if off is not None else None, (file,),
        tuple(f"{file}: unknown key {k!r}" for k in value if k not in KNOWN_KEYS),
    )


def parse_ruleset(text: str, file: str = "ruleset") -> Ruleset:
    return read_ruleset(load(text, file), file)


def merge(base: Ruleset, child: Ruleset) -> Ruleset:
    """The child's rules replace those of the same id in place, new ones follow; its own settings win."""
    own = {r.id: r for r in child.rules}
    rules = [own.pop(r.id, r) for r in base.rules]
    rules += [r for r in child.rules if r.id in own]
    return Ruleset(
        tuple(rules), base.threshold if child.threshold is None else child.threshold,
        base.off_by_default if child.off_by_default is None else child.off_by_default,
        base.sources + child.sources, base.warnings + child.warnings,
    )


def default_path() -> str:
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), "default_rules.yaml")


def default_ruleset() -> Ruleset:
    with open(default_path(), encoding="utf-8") as f:
        return parse_ruleset(f.read(), "default")


def discover(folder: str, given: str | None = None) -> tuple[str, bool]:
    """(path, found by name): a given file, a project's own, or the packaged one.  A link by a known name is refused."""
    if given:
        return os.path.join(folder, given), False
    for name in NAMES:
        path = os.path.join(folder, name)
        if os.path.lexists(path):
            if stat.S_ISLNK(os.lstat(path).st_mode):
                raise RulesetError(f"{path}: a ruleset found by name must not be a link")
            return path, True
    return default_path(), False


def resolve(folder: str = ".", given: str | None = None) -> Ruleset:
    """The ruleset with all that it extends.  Files that a discovered one extends must lie in its tree."""
    path, found = discover(folder, given)
    root = os.path.realpath(os.path.dirname(path)) if found else None

    def read(path: str, chain: tuple[str, ...]) -> Ruleset:
        real = os.path.realpath(path)
        if real in chain:
            raise RulesetError(f"{path}: extends itself")
        if len(chain) >= MAX_DEPTH:
            raise RulesetError(f"{path}: extends more than {MAX_DEPTH} files deep")
        if root and real != os.path.realpath(default_path()) and os.path.commonpath([root, real]) != root:
            raise RulesetError(f"{path}: lies outside {root}")
        try:
            with open(path, encoding="utf-8") as f:
                value = load(f.read(), path)
        except OSError as e:
            raise RulesetError(f"{path}: {e.strerror}") from None
        except YamlError as e:
            raise RulesetError(str(e)) from None
        target = value.get("extends") if isinstance(value, dict) else None
        own = read_ruleset(value, path, needs_rules=target is None)
        if target is None:
            return own
        if not isinstance(target, str) or not target.strip():
            raise RulesetError(f"{path}: extends must name a file or default")
        base = default_path() if target == "default" else os.path.join(os.path.dirname(path), target)
        return merge(read(base, (*chain, real)), own)

    return read(path, ())


def known_tags(ruleset: Ruleset) -> list[str]:
    return sorted({t for r in ruleset.rules for t in r.tags})


def select(ruleset: Ruleset, only: list[str] | None = None, skip: list[str] | None = None) -> tuple[Ruleset, list[tuple[str, str]]]:
    """The rules that run, and (rule, reason) of those that do not.

    skip beats only, only beats what is off by default.  Asking for tags leaves countable rules in and calls off
    off_by_default altogether.
    """
    tags = known_tags(ruleset)
    if unknown := [t for t in (only or []) + (skip or []) if t not in tags]:
        raise RulesetError(f"no rule has the tag {unknown[0]!r}; tags are {', '.join(tags) or 'none'}")
    kept, dropped = [], []
    for r in ruleset.rules:
        has = set(r.tags)
        if hit := [t for t in skip or [] if t in has]:
            dropped.append((r.id, f"skip {hit[0]}"))
        elif only and not r.countable and not has & set(only):
            dropped.append((r.id, f"only {', '.join(only)}"))
        elif not only and (hit := [t for t in ruleset.off_by_default or () if t in has]):
            dropped.append((r.id, f"off by default: {hit[0]}"))
        else:
            kept.append(r)
    return replace(ruleset, rules=tuple(kept)), dropped


def dropped_by_reason(dropped: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for rule, reason in dropped:
        out.setdefault(reason, []).append(rule)
    return out


def pattern_for_java(pattern: str, flags: str = "") -> str:
    """An ECMAScript pattern in Java's dialect.

    Word boundaries become ASCII, white space the wider set, and a bracket inside a class, which Java would read as a
    class of its own, is escaped.
    """
    from ..functions import text as T

    if unknown := set(flags) - set("gimsu"):
        raise RulesetError(f"the flags {''.join(sorted(unknown))} are not supported")
    outside = {r"\b": T.BOUNDARY, r"\s": T.WS, r"\S": T.NOT_WS}
    in_class = {r"\s": T.WS_SET, "[": r"\[", "&&": r"&\&"}
    out, inside = [], False
    for token in re.findall(r"\\.|&&|.", pattern, re.DOTALL):
        if inside:
            out.append(in_class.get(token, token))
            inside = token != "]"
        else:
            out.append(outside.get(token, token))
            inside = token == "["
    letters = "".join(c for c in "ims" if c in flags) + ("u" if "i" in flags and "u" in flags else "")
    return f"(?{letters}d)" + "".join(out)


def rules_frame(spark, ruleset: Ruleset):  # noqa: ANN001, ANN201
    """One row a rule, for joins and reports."""
    rows = [(i, r.id, r.kind, r.builtin, r.pattern, list(r.tags), r.message, r.sentence, r.seed.transform if r.seed else None) for i, r in enumerate(ruleset.rules)]
    return spark.createDataFrame(rows, "ord int, id string, kind string, builtin string, pattern string, tags array<string>, message string, sentence string, transform string")
