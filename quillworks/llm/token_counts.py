"""Token counts by a finite-state tokenizer.

The tokenizer (byte pairs merged by rank, lower case, word ends marked) is compiled into a deterministic transducer over
the bytes of a word; each transition carries the number of tokens that it adds to the tokenization of what was read,
which may be negative.  Merges go by rank and not from left to right, yet the tokenization of a prefix is finite-state:

* Two tokens stand beside each other in a tokenization just when no merge would cross the seam between them before it
  is closed on both sides, which their left and right spines tell (``Merges.seam``).
* So the last token of a prefix is the one suffix token that may follow the last token of the prefix before it, and
  the count is that prefix's and one.  What is needed to read on is, for each place of the longest suffix that could
  still begin or continue a token, the last token up to there and how many tokens fewer it took: that is a state.
  Tokens have a greatest length, so there are finitely many.  States are made when first reached.

Words are cut by a second, small machine over the classes of characters (space, letter, number, other) with the
contractions as its look-ahead.  Texts are cut into chunks.  A first chunk is entered in the start state; the map of a
later one sends the state in which it is entered to a count and the state in which it is left: up to its first white
space by reading, behind it the same for all (white space resets both machines).  Maps compose associatively, and a
tree-shaped scan joins those of a text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Fixed values of the splitter: contractions, and the white space of its regular expressions.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Added to the last byte of a word.
END = 256
NEVER = 1 << 30

Symbols = tuple[int, ...]


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level BPE files write it."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Tokens as tuples of symbols (bytes, END added to the last of a word), and which may stand beside each other."""

    def __init__(self, model: dict):
        byte, end = {c: i for i, c in enumerate(byte_alphabet())}, model.get("end_of_word_suffix") or ""
        if not end:
            raise ValueError("no word ends")

        def symbols(token: str) -> Symbols:
            body = token.removesuffix(end)
            out = [byte[c] for c in body]
            if len(body) < len(token):
                out[-1] += END
            return tuple(out)

        self.rank: dict[tuple[Symbols, Symbols], int] = {}
        self.split: dict[Symbols, tuple[Symbols, Symbols]] = {}
        self.formed: dict[Symbols, int] = {(s,): -1 for s in range(2 * END)}
        for r, m in enumerate(model["merges"]):
            a, b = map(symbols, m if isinstance(m, list) else m.split(" "))
            if a + b in self.formed or a not in self.formed or b not in self.formed:
                raise ValueError("merges are not in the order in which tokens are formed")
            self.rank[a, b], self.split[a + b], self.formed[a + b] = r, (a, b), r
        self.begins = {t[:i] for t in self.formed for i in range(len(t))}
        self.sound: dict[Symbols, bool] = {}
        self.seams: dict[tuple[Symbols, Symbols], int] = {}

    def spine(self, token: Symbols, side: int) -> list[tuple[Symbols, int]]:
        """The parts at one edge of a token, the whole first, each with the rank at which it goes into the one before."""
        out, gone = [(token, NEVER)], NEVER
        while token in self.split:
            gone = self.formed[token]
            token = self.split[token][side]
            out.append((token, gone))
        return out

    def seam(self, a: Symbols, b: Symbols) -> int:
        """The rank of the first merge across the seam of two tokens, NEVER if there is none."""
        first = self.seams.get((a, b))
        if first is None:
            first = NEVER
            for x, x_gone in self.spine(a, 1):
                for y, y_gone in self.spine(b, 0):
                    # Among merges of one rank the left one goes first.
                    r = self.rank.get((x, y), NEVER)
                    if r < first and r < x_gone and r <= y_gone:
                        first = r
            if len(self.seams) > 1_000_000:
                self.seams.clear()
            self.seams[a, b] = first
        return first

    def is_sound(self, token: Symbols) -> bool:
        """Whether a token's own symbols are tokenized as it."""
        known = self.sound.get(token)
        if known is None:
            if token in self.split:
                a, b = self.split[token]
                known = self.is_sound(a) and self.is_sound(b) and self.seam(a, b) == self.formed[token]
            else:
                known = token in self.formed
            self.sound[token] = known
        return known


class Transducer:
    """States by number, 0 the start; transitions (state, symbol) to (state, tokens added), made when first taken.

    With more than ``keep`` states all are forgotten, between words, and made again as they are reached.
    """

    def __init__(self, merges: Merges, keep: int = 250_000):
        self.merges, self.keep = merges, keep
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple[Symbols, tuple]] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.state_of((), ((None, 0),))
        self.bits = 0
        self.resize(16)

    def state_of(self, suffix: Symbols, history: tuple) -> int:
        n = self.number.setdefault((suffix, history), len(self.states))
        if n == len(self.states):
            self.states.append((suffix, history))
        return n

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """The state reached and the tokens added; a word's last symbol leads back to the start."""
        found = self.moves.get(state << 9 | symbol)
        if found is None:
            suffix, history = self.states[state]
            merges, token = self.merges, (*suffix, symbol)
            while True:
                if merges.is_sound(token):
                    last, n = history[len(token) - 1]
                    if last is None or merges.seam(last, token) == NEVER:
                        break
                token = token[1:]
            n += 1
            reached = 0
            if symbol < END:
                rest = (*suffix, symbol)
                while rest not in merges.begins:
                    rest = rest[1:]
                reached = self.state_of(rest, ((token, 0), *((t, m - n) for t, m in history[: len(rest)])))
            found = self.moves[state << 9 | symbol] = (reached, n)
            self.insert(state << 9 | symbol, *found)
        return found

    # The same transitions in arrays, hashed with open addressing, for many words in step.

    def resize(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.goes, self.adds = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int16)
        for k, v in self.moves.items():
            self.insert(k, *v)

    def insert(self, key: int, state: int, n: int) -> None:
        if len(self.moves) * 2 > 1 << self.bits:
            self.resize(self.bits + 1)
            return
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[at] not in (-1, key):
            at = at + 1 & (1 << self.bits) - 1
        self.keys[at], self.goes[at], self.adds[at] = key, state, n

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the transitions stand; those that are missing are made first."""
        while True:
            at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
            held = self.keys[at]
            open_ = np.flatnonzero(held != keys)
            missing = [open_[:0]]
            while len(open_):
                empty = held[open_] == -1
                missing.append(open_[empty])
                open_ = open_[~empty]
                at[open_] = at[open_] + 1 & (1 << self.bits) - 1
                held[open_] = self.keys[at[open_]]
                open_ = open_[held[open_] != keys[open_]]
            missing = np.concatenate(missing)
            if not len(missing):
                return at
            for key in np.unique(keys[missing]).tolist():
                self.move(key >> 9, key & 511)

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, few: int = 32) -> np.ndarray:
        """Tokens of the words data[start : start + size], all of them in step; when few are left, one by one."""
        if len(self.states) > self.keep:
            self.forget()
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live, j = int(np.count_nonzero(size > 0)), 0
        while live > few:
            symbol = data[start[:live] + j].astype(np.int64)
            symbol[size[:live] == j + 1] += END
            at = self.slots(state[:live] << 9 | symbol)
            state[:live] = self.goes[at]
            total[:live] += self.adds[at]
            j += 1
            live = int(np.searchsorted(-size, -j, "left"))
        for i in range(live):
            q, n, word = int(state[i]), 0, data[start[i] + j : start[i] + size[i]].tolist()
            word[-1] += END
            for c in word:
                q, m = self.moves.get(q << 9 | c) or self.move(q, c)
                n += m
            total[i] += n
        out = np.empty_like(total)
        out[order] = total
        return out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kind[c] = LETTER if k == "L" else NUMBER
    kind[[ord(c) for c in SPACES]] = SPACE
    return kind


def split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, in characters, and the text's code points."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[code]
    before = np.concatenate([[SPACE], kind[:-1]])
    start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    for p in np.flatnonzero((code == 39) & start).tolist():
        for c in CONTRACTIONS:
            if text.startswith(c, p):
                start[p + 1] = False
                if p + len(c) < len(text) and kind[p + len(c)] != SPACE:
                    start[p + len(c)] = True
                break
    starts = np.flatnonzero(start)
    # A word ends where the next starts or where white space follows.
    gaps = np.flatnonzero((kind == SPACE) & (before != SPACE))
    ends = np.sort(np.concatenate([gaps, starts[1:][kind[starts[1:] - 1] != SPACE], [len(text)] if len(kind) and kind[-1] != SPACE else []]).astype(np.int64))
    if len(gaps) and gaps[0] == 0:
        ends = ends[1:]
    return starts, ends, code


class Cursor:
    """The state of both machines between two characters: the run of letters or others that is open, the transducer's
    state before its last byte, that byte, and an apostrophe with what may still become a contraction."""

    __slots__ = ("byte", "held", "kind", "state")

    def __init__(self, kind: int = SPACE, state: int = 0, byte: int = -1, held: str = ""):
        self.kind, self.state, self.byte, self.held = kind, state, byte, held


class ChunkMap:
    """Entry state to count and exit state: reads head from the entry; behind it, count tokens more and the state exit.

    exit is None if the chunk has no white space: then it is left where reading head ends.
    """

    __slots__ = ("count", "exit", "head")

    def __init__(self, head: str, count: int = 0, exit_: Cursor | None = None):
        self.head, self.count, self.exit = head, count, exit_


class TokenCounter:
    def __init__(self, path: str, chunk: int = CHUNK):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        self.machine, self.chunk = Transducer(Merges(spec["model"])), chunk
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def bulk(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, entered in the start state and ended behind it; all their words in step."""
        if not texts:
            return np.zeros(0, np.int64)
        text = "\n".join(texts)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        start, end, code = split(text)
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = self.machine.run(data, at[start], at[end] - at[start])
        return np.bincount(np.searchsorted(first, start, "right") - 1, n, len(texts)).astype(np.int64)

    # One character at a time, for what the edges of chunks cut.

    def byte_on(self, c: Cursor, kind: int, char: str) -> int:
        """Adds a character to a run, which it opens if there is none of that kind."""
        n = self.close(c) if c.kind != kind else 0
        c.kind = kind
        for b in char.encode("utf-8", "surrogatepass"):
            if c.byte >= 0:
                c.state, m = self.machine.move(c.state, c.byte)
                n += m
            c.byte = b
        return n

    def close(self, c: Cursor) -> int:
        n = self.machine.move(c.state, c.byte + END)[1] if c.byte >= 0 else 0
        c.kind, c.state, c.byte = SPACE, 0, -1
        return n

    def release(self, c: Cursor) -> int:
        """What was held is no contraction: an apostrophe and perhaps a letter."""
        held, c.held = c.held, ""
        return sum(self.byte_on(c, int(classes()[ord(x)]), x) for x in held)

    def read(self, c: Cursor, text: str) -> int:
        """Tokens that are certain while text is read from c on; c moves."""
        n, kinds = 0, classes()
        for char in text:
            if c.held:
                more = c.held + char
                if more in CONTRACTIONS:
                    for x in more:
                        n += self.byte_on(c, LETTER, x)
                    n += self.close(c)
                    c.held = ""
                    continue
                if any(x.startswith(more) for x in CONTRACTIONS):
                    c.held = more
                    continue
                n += self.release(c)
            kind = int(kinds[ord(char)])
            if kind == SPACE:
                n += self.close(c)
            elif char == "'" and c.kind != OTHER:
                n += self.close(c)
                c.held = char
            else:
                n += self.close(c) if kind == NUMBER else 0
                n += self.byte_on(c, kind, char)
                n += self.close(c) if kind == NUMBER else 0
        return n

    def finish(self, c: Cursor) -> int:
        return self.release(c) + self.close(c)

    def entered(self, text: str) -> tuple[int, Cursor]:
        """Count and exit state of a chunk that is entered in the start state."""
        last = next((i for i in range(len(text), 0, -1) if text[i - 1] in SPACES), 0)
        c = Cursor()
        return int(self.bulk([text[:last]])[0]) + self.read(c, text[last:]), c

    def map_of(self, text: str) -> ChunkMap:
        first = next((i for i, x in enumerate(text) if x in SPACES), None)
        return ChunkMap(text) if first is None else ChunkMap(text[: first + 1], *self.entered(text[first + 1 :]))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.exit is None:
            return ChunkMap(a.head + b.head, b.count, b.exit)
        c = Cursor(a.exit.kind, a.exit.state, a.exit.byte, a.exit.held)
        return ChunkMap(a.head, a.count + self.read(c, b.head) + b.count, b.exit or c)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Tree-shaped, so that each level could run on other machines."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def long(self, text: str) -> int:
        """A text of several chunks."""
        if len(self.machine.states) > self.machine.keep:
            self.machine.forget()
        keep, self.machine.keep = self.machine.keep, NEVER  # states are held between the chunks of a text
        count, c = self.entered(text[: self.chunk])
        whole = self.scan([ChunkMap("", count, c), *(self.map_of(text[i : i + self.chunk]) for i in range(self.chunk, len(text), self.chunk))])
        self.machine.keep = keep
        return whole.count + self.finish(whole.exit)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        size = 0

        def flush() -> None:
            nonlocal size
            np.add.at(out, owner, self.bulk(pieces))
            pieces.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            parts = [text]
            if self.added and "<|" in text:
                out[i] += len(self.added.findall(text))
                parts = self.added.split(text)
            for part in parts:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if len(part) > self.chunk:
                    out[i] += self.long(part)
                elif part:
                    pieces.append(part)
                    owner.append(i)
                    size += len(part)
                    if size > 4 * CHUNK:
                        flush()
        flush()
        return out


@lru_cache(maxsize=2)
def counter_of(path: str) -> TokenCounter:
    """One to each worker process: its states serve all tasks that the worker runs."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, in a narrow pass.

    Null and empty texts have 0 bytes and 0 tokens.  No begin, end or other special tokens are added; special strings
    inside texts count one each.  Very long texts are read in chunks whose maps are composed.  Repeated rows give a row
    each and ties do not arise; an empty table gives an empty table.  Only doc_id and text are read, so other columns
    may have any name.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = counter_of(tokenizer)
        for batch in batches:
            n = counter.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
