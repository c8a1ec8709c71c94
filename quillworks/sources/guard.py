"""Patterns that could backtrack without end are refused before they reach a plan.

The pattern is parsed, and its tree is read for two shapes: a repeat of no fixed count over something that holds
another such repeat, whatever their bounds; and a repeat over branches that can start with the same character.  A
timed probe on short strings of the pattern's own characters follows: a measurement, not a proof.
"""

from __future__ import annotations

import re
import subprocess
import sys

try:
    from re import _parser as parser
except ImportError:  # before 3.11
    import sre_parse as parser

PROBE_LENGTHS, PROBE_SECONDS = (4, 8, 12, 16, 20, 24), 0.025


def _repeats(tree):  # noqa: ANN001, ANN202
    """The repeats in a tree that can match more than one length."""
    for op, arg in tree:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            if high != low:
                yield body
            yield from _repeats(body)
        elif name == "SUBPATTERN":
            yield from _repeats(arg[-1])
        elif name == "BRANCH":
            for branch in arg[1]:
                yield from _repeats(branch)
        elif name in ("ASSERT", "ASSERT_NOT"):
            yield from _repeats(arg[1])


def _first(tree) -> set[int] | None:  # noqa: ANN001
    """Characters that a tree can start with; None for any."""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            return {arg, *map(ord, (chr(arg).lower(), chr(arg).upper()))} if arg < 128 else {arg}
        if name == "IN":
            out: set[int] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    out.add(x)
                elif str(kind) == "RANGE" and x[1] - x[0] < 512:
                    out |= set(range(x[0], x[1] + 1))
                else:
                    return None
            return out
        if name == "SUBPATTERN":
            return _first(arg[-1])
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            return _first(arg[2])
        if name == "AT":
            continue
        return None
    return None


def _branches(tree):  # noqa: ANN001, ANN202
    for op, arg in tree:
        if str(op) == "BRANCH":
            yield arg[1]
        elif str(op) == "SUBPATTERN":
            yield from _branches(arg[-1])


def to_python(pattern: str, flags: str) -> re.Pattern:
    names = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}
    return re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern), sum(names.get(c, 0) for c in set(flags)))


def check_pattern(pattern: str, flags: str, where: str) -> None:
    from .ruleset import RulesetError

    if set(flags) - set("gimsu"):
        raise RulesetError(f"{where}: flags may be of g, i, m, s and u")
    try:
        tree = parser.parse(to_python(pattern, flags).pattern, 0)
    except (re.error, OverflowError, RecursionError) as e:
        raise RulesetError(f"{where}: pattern is not a valid regular expression ({e})") from None
    for body in _repeats(tree):
        if next(_repeats(body), None) is not None:
            raise RulesetError(f"{where}: pattern repeats a group that repeats inside")
        for branches in _branches(body):
            firsts = [_first(b) for b in branches]
            if any(a is None or b is None or a & b for i, a in enumerate(firsts) for b in firsts[i + 1 :]):
                raise RulesetError(f"{where}: pattern repeats branches that can start alike")
    probe(pattern, flags, where)


def probe(pattern: str, flags: str, where: str) -> None:
    """In a process of its own, as a match that hangs cannot be stopped from inside."""
    from .ruleset import RulesetError

    quick = re.compile(r"[*+{]")
    if not quick.search(pattern):
        return
    letters = sorted({c for c in pattern if c.isalnum() or c in " .,-"} | {"a"})[:6]
    texts = [c * n + "\x00" for c in letters for n in PROBE_LENGTHS]
    code = "import re,sys,time,ast\np,f,ts=ast.literal_eval(sys.stdin.read())\nr=re.compile(p,f)\nfor t in ts:\n s=time.perf_counter();r.search(t)\n if time.perf_counter()-s>%r: sys.exit(3)\n" % PROBE_SECONDS
    compiled = to_python(pattern, flags)
    try:
        done = subprocess.run([sys.executable, "-c", code], input=repr((compiled.pattern, compiled.flags, texts)), text=True, capture_output=True, timeout=5)
        slow = done.returncode == 3
    except subprocess.TimeoutExpired:
        slow = True
    if slow:
        raise RulesetError(f"{where}: pattern takes too long on short texts")
