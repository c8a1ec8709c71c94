"""Secret scan with multipart credential linking.

Strong patterns are reported by themselves.  Weak candidates (account names, short or unnamed secrets, endpoints) are
common in clean text, so each is reported only when parts that complete it stand near it in the same scope.  A scope
is a block without blank lines; near means at most ``reach`` characters apart.  The join is by interval: part kinds
are sorted by place, and a part meets another if its interval, widened by the reach and clipped to its scope, overlaps
that of the other.  One pass and n log n per text, whatever number of parts it holds; no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The given patterns and least lengths of the base kinds: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

KINDS = ("assign", "access", "hex", "account", "weak", "blob", "endpoint")
ACCOUNT = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|user_?name|username|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.IGNORECASE | re.ASCII)
BLOB = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""", re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*\n")
#: What completes a candidate: any of each group must be near.
NEEDS = {
    "account": (("assign", "hex", "weak", "blob"),),
    "weak": (("access", "account"), ("endpoint", "access", "account")),
    "blob": (("access", "account"),),
    "endpoint": (("access", "account"), ("assign", "hex", "weak", "blob")),
}

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    for m in ASSIGN.finditer(text):
        found["assign" if m.end(2) - m.start(2) >= LEAST_ASSIGN else "weak"].append(m.span())
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    return found


class Intervals:
    """Spans by start, with the furthest end of each prefix: does any overlap [a, b)?"""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts, self.ends, far = [a for a, _ in spans], [], -1
        for _, b in spans:
            far = max(far, b)
            self.ends.append(far)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def link(text: str, found: dict[str, list[Span]], reach: int) -> dict[str, list[Span]]:
    """The weak candidates that parts near them complete."""
    # Every need names an identity (access, account) and a secret: without one of either nothing can be completed.
    found["account"] = [m.span() for m in ACCOUNT.finditer(text)]
    if not found["access"] and not found["account"]:
        return {}
    strong = Intervals(found["assign"] + found["access"] + found["hex"])
    found["blob"] = [m.span() for m in BLOB.finditer(text) if not strong.meets(*m.span())]
    if not any(found[k] for k in ("assign", "hex", "weak", "blob")):
        return {}
    found["endpoint"] = [m.span() for m in ENDPOINT.finditer(text)] if "=" in text or ":" in text else []
    parts = {k: Intervals(v) for k, v in found.items() if v}
    edges = [0, *(m.end() for m in BLANK.finditer(text)), len(text)]
    out: dict[str, list[Span]] = {}
    for kind, needs in NEEDS.items():
        for a, b in found[kind]:
            k = bisect_right(edges, a)
            low, high = max(a - reach, edges[k - 1]), min(b + reach, edges[k] if k < len(edges) else len(text))
            if all(any(x in parts and parts[x].meets(low, high) for x in group) for group in needs):
                out.setdefault(kind, []).append((a, b))
    return out


def joined(found: dict[str, list[Span]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    rows = sorted((a, order[k], k, b) for k, spans in found.items() for a, b in spans)
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in rows)


def scan(text: str, reach: int = 200) -> tuple[int, int, int, str, str]:
    found = base_spans(text)
    base = {k: found[k] for k in KINDS[:3]}
    listed = joined(base)
    linked = link(text, found, reach)
    spans = joined(base | linked) if linked else listed
    return len(base["assign"]), len(base["access"]), len(base["hex"]), hashlib.sha256(listed.encode()).hexdigest(), spans


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null texts count as empty: no spans and the digest of the empty string.  Spans are kind:start:end in code points,
    end exclusive, by start and then kind as in KINDS.  Repeated rows give a row each; other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [scan(t.as_py() or "", reach) for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
