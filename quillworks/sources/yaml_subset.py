"""A reader for the part of YAML that rulesets and panels use.

Block mappings and sequences, plain and quoted scalars, literal and folded blocks, flow collections on one line, and
comments.  Whatever else YAML has is refused with the file and the line, never guessed at.
"""

from __future__ import annotations

import math
import re
from typing import Any

MAX_FLOW_DEPTH = 16
NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f"}
#: Refused as keys: they mean something to YAML or to readers of the same file in other languages.
FORBIDDEN_KEYS = ("<<", "__proto__")


class YamlError(ValueError):
    pass


def scalar(text: str) -> Any:
    """A plain scalar's value: null, boolean, number or string."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if NUMBER.fullmatch(text):
        value = float(text)
        if math.isfinite(value):
            return int(text) if re.fullmatch(r"[-+]?[0-9]+", text) else value
    return text


class Reader:
    def __init__(self, text: str, file: str):
        self.file = file
        self.lines = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.at = 0

    def fail(self, why: str, line: int | None = None) -> YamlError:
        return YamlError(f"{self.file}:{(self.at if line is None else line) + 1}: {why}")

    # Lines

    def uncomment(self, line: str) -> str:
        """Without a comment, which starts at a # outside quotes at the start or behind a space."""
        quote = ""
        i = 0
        while i < len(line):
            c = line[i]
            if quote:
                if c == "\\" and quote == '"':
                    i += 1
                elif c == quote:
                    quote = ""
            elif c in "'\"" and (i == 0 or line[i - 1] in " [{,:-"):
                quote = c
            elif c == "#" and (i == 0 or line[i - 1] in " \t"):
                return line[:i].rstrip()
            i += 1
        return line.rstrip()

    def peek(self) -> tuple[int, str] | None:
        """Indent and content of the next line that holds something."""
        while self.at < len(self.lines):
            raw = self.lines[self.at]
            if re.match(r" *\t", raw) and raw.strip():
                raise self.fail("a tab cannot indent")
            line = self.uncomment(raw)
            if line.strip():
                if line.startswith(("---", "...")) and line.strip(".- ") == "":
                    if line.strip() == "---" and not any(x.strip() and not x.lstrip().startswith("#") for x in self.lines[: self.at]):
                        self.at += 1
                        continue
                    raise self.fail("one document a file")
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    # Blocks

    def document(self) -> Any:
        head = self.peek()
        if head is None:
            return None
        value = self.block(head[0])
        if self.peek() is not None:
            raise self.fail("text that belongs to no key")
        return value

    def block(self, indent: int) -> Any:
        head = self.peek()
        if head is None:
            return None
        if head[1] == "-" or head[1].startswith("- "):
            return self.sequence(indent)
        if self.key_end(head[1]) is not None:
            return self.mapping(indent)
        value = self.value(head[1])
        self.at += 1
        return value

    def sequence(self, indent: int) -> list:
        out = []
        while (head := self.peek()) and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
            rest = head[1][1:]
            inner = rest.lstrip(" ")
            if not inner:
                self.at += 1
                below = self.peek()
                out.append(self.block(below[0]) if below and below[0] > indent else None)
                continue
            column = indent + 1 + len(rest) - len(inner)
            if inner.startswith("- ") or self.key_end(inner) is not None:
                # The item's own block starts on this line: the dash becomes a part of its indent.
                self.lines[self.at] = " " * column + inner
                out.append(self.block(column))
            else:
                out.append(self.tail(inner, indent))
        if (head := self.peek()) and head[0] > indent:
            raise self.fail("indented further than its list")
        return out

    def mapping(self, indent: int) -> dict:
        out: dict[str, Any] = {}
        while (head := self.peek()) and head[0] == indent and not head[1].startswith("- "):
            end = self.key_end(head[1])
            if end is None:
                raise self.fail("expected a key")
            key = self.key(head[1][:end].strip())
            if key in out:
                raise self.fail(f"the key {key!r} stands twice")
            rest = head[1][end + 1 :].strip()
            if rest:
                out[key] = self.tail(rest, indent)
                continue
            self.at += 1
            below = self.peek()
            own = below and (below[0] > indent or (below[0] == indent and (below[1] == "-" or below[1].startswith("- "))))
            out[key] = self.block(below[0]) if own else None
        if (head := self.peek()) and head[0] > indent:
            raise self.fail("indented further than its mapping")
        return out

    def key(self, text: str) -> str:
        if text[:1] in "'\"":
            value, end = self.quoted(text, 0)
            if end != len(text):
                raise self.fail("text behind a quoted key")
            text = value
        elif text[:1] in ("&", "*", "!", "?") or text == "<<":
            raise self.fail(f"{text[:2]!r} is not supported")
        if text in FORBIDDEN_KEYS:
            raise self.fail(f"{text!r} cannot be a key")
        return text

    def key_end(self, text: str) -> int | None:
        """Place of the colon that ends a key, outside quotes and brackets."""
        if text[:1] in "[{":
            return None
        i = 0
        if text[:1] in "'\"":
            i = self.quoted(text, 0)[1]
            while i < len(text) and text[i] == " ":
                i += 1
            return i if i < len(text) and text[i] == ":" and (i + 1 == len(text) or text[i + 1] == " ") else None
        while (i := text.find(":", i)) >= 0:
            if i + 1 == len(text) or text[i + 1] == " ":
                return i
            i += 1
        return None

    def tail(self, text: str, indent: int) -> Any:
        """A value that starts on the line of its key or dash; moves past it."""
        if m := re.fullmatch(r"([|>])([+-]?)([1-9]?)", text):
            self.at += 1
            return self.text_block(m[1], m[2], indent, int(m[3] or 0))
        value = self.value(text)
        self.at += 1
        return value

    def text_block(self, style: str, chomp: str, indent: int, given: int) -> str:
        rows: list[str] = []
        own = indent + given if given else None
        while self.at < len(self.lines):
            raw = self.lines[self.at]
            lead = len(raw) - len(raw.lstrip(" "))
            if raw.strip():
                if lead <= indent:
                    break
                own = lead if own is None else own
                if lead < own:
                    raise self.fail("a block of text changes its indent")
            rows.append(raw[own or 0 :] if raw.strip() else "")
            self.at += 1
        kept = len(rows)
        while kept and rows[kept - 1] == "":
            kept -= 1
        blank, rows = len(rows) - kept, rows[:kept]
        if style == "|":
            body = "\n".join(rows)
        else:
            body = ""
            for i, row in enumerate(rows):
                if i == 0:
                    body = row
                elif row == "":
                    body += "\n"
                elif rows[i - 1] == "" or row.startswith(" ") or rows[i - 1].startswith(" "):
                    body += row if rows[i - 1] == "" else "\n" + row
                else:
                    body += " " + row
        if not rows:
            return "\n" * blank if chomp == "+" else ""
        return body + {"-": "", "": "\n", "+": "\n" * (1 + blank)}[chomp]

    # Values on one line

    def value(self, text: str) -> Any:
        value, end = self.flow(text, 0, 0, "")
        if text[end:].strip():
            raise self.fail(f"text behind a value: {text[end:].strip()[:20]!r}")
        return value

    def quoted(self, text: str, i: int) -> tuple[str, int]:
        quote, out = text[i], []
        i += 1
        while i < len(text):
            c = text[i]
            if quote == "'" and text.startswith("''", i):
                out.append("'")
                i += 2
            elif c == quote:
                return "".join(out), i + 1
            elif c == "\\" and quote == '"':
                code = text[i + 1 : i + 2]
                if code in ("u", "x"):
                    n = 4 if code == "u" else 2
                    digits = text[i + 2 : i + 2 + n]
                    if not re.fullmatch(rf"[0-9a-fA-F]{{{n}}}", digits):
                        raise self.fail("an escape without its digits")
                    out.append(chr(int(digits, 16)))
                    i += 2 + n
                elif code in ESCAPES and code:
                    out.append(ESCAPES[code])
                    i += 2
                else:
                    raise self.fail(f"unknown escape \\{code}")
            else:
                out.append(c)
                i += 1
        raise self.fail("a quote that does not close on its line")

    def flow(self, text: str, i: int, depth: int, stops: str) -> tuple[Any, int]:
        """The value at i and where it ends; in a flow collection plain scalars end at one of stops."""
        if depth > MAX_FLOW_DEPTH:
            raise self.fail("nested too deeply")
        while i < len(text) and text[i] == " ":
            i += 1
        c = text[i : i + 1]
        if c and c in "'\"":
            return self.quoted(text, i)
        if c == "[":
            return self.collection(text, i + 1, depth, "]")
        if c == "{":
            return self.collection(text, i + 1, depth, "}")
        if c and c in "&*!%@`|>":
            raise self.fail(f"{c!r} cannot start a value here")
        end = i
        while end < len(text) and text[end] not in stops:
            if stops and text[end] == ":" and text[end + 1 : end + 2] in ("", " ", ",", "}", "]"):
                break
            end += 1
        plain = text[i:end].strip()
        if not stops and re.search(r":(?: |$)", plain):
            raise self.fail("a colon inside a plain value needs quotes")
        return scalar(plain), end

    def collection(self, text: str, i: int, depth: int, close: str) -> tuple[Any, int]:
        items: list = []
        pairs: dict[str, Any] = {}
        while True:
            while i < len(text) and text[i] == " ":
                i += 1
            if i >= len(text):
                raise self.fail("a flow collection that does not close on its line")
            if text[i] == close:
                return (items if close == "]" else pairs), i + 1
            if close == "]":
                value, i = self.flow(text, i, depth + 1, ",]}")
                items.append(value)
            else:
                if text[i] in "'\"":
                    name, i = self.quoted(text, i)
                    name = self.key(name) if name not in FORBIDDEN_KEYS else self.key(name)
                else:
                    end = i
                    while end < len(text) and text[end] not in ":,}":
                        end += 1
                    name, i = self.key(text[i:end].strip()), end
                while i < len(text) and text[i] == " ":
                    i += 1
                if text[i : i + 1] != ":":
                    raise self.fail("a flow mapping needs key: value")
                if name in pairs:
                    raise self.fail(f"the key {name!r} stands twice")
                pairs[name], i = self.flow(text, i + 1, depth + 1, ",]}")
            while i < len(text) and text[i] == " ":
                i += 1
            if text[i : i + 1] == ",":
                i += 1
            elif text[i : i + 1] != close:
                raise self.fail("expected a comma or the end of a flow collection")


def load(text: str, file: str = "yaml") -> Any:
    return Reader(text, file).document()
