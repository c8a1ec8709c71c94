"""Packing by power-of-two decomposition.

A document of n ids becomes floor(n / limit) pieces of the limit and one piece for each bit of the rest, longest
first.  Every piece is a sequence of its own of a power-of-two length, so none crosses documents and none is padded.
Sequences of equal length form a bucket, and each task cuts its share of a bucket into batches of ``batch_tokens``
tokens (the last of a task's bucket may be short).  One narrow pass, no shuffle.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
END_ID = 0


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Powers of two, longest first, that add up to n; the limit is a power of two too."""
    full, rest = divmod(n, limit)
    return [limit] * full + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def encoder(ranks_path: str, specials: dict[str, int], pattern: str):
    """Byte-level BPE over ranks; the strings in specials become their ids, as the library's added tokens do."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False, batch_tokens: int = 1 << 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id (, ids) of every piece.

    tokenizer is a byte-level BPE file of the tokenizers library; with ranks, the same vocabulary as ranks, the
    faster library gives the same ids.  A null or empty text is the end id alone, so every row has a piece.  Repeated
    rows give pieces each, very long texts are encoded whole, ties do not arise, and an empty table gives an empty
    table.  Only doc_id and text are read, so other columns may have any name.  sequence_id and batch_id are unique in
    the result, and the same whenever a lost partition is computed again, as they come from the place of the row in the
    scan.
    """
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if ranks:
            import json

            import public_tokenizers

            with open(tokenizer, encoding="utf-8") as f:
                specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            enc = encoder(ranks, specials, public_tokenizers.PATTERN)

            def encode(text: str) -> list[int]:
                return enc.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer)

            def encode(text: str) -> list[int]:
                return tok.encode(text, add_special_tokens=False).ids

        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        # Of each bucket: the batch that is open, and what it can still hold.
        open_batch: dict[int, list[int]] = {}
        n_batches = 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                start = 0
                for length in piece_lengths(len(ids), limit):
                    raw = ids[start : start + length]
                    own = open_batch.get(length)
                    if own is None or not own[1]:
                        own = open_batch[length] = [task + n_batches, max(1, batch_tokens // length)]
                        n_batches += 1
                    own[1] -= 1
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(raw.tobytes()), len(ids), own[0], raw.tolist() if with_ids else None)):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:6]] + ([pa.array(out[6], pa.list_(pa.int64()))] if with_ids else []), names=names
            )

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "batch_id"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} long" if n != "ids" else "ids array<long>" for n in names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, schema)
    return out.select(
        *names[:5], F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"), *names[5:],
    )
