"""Near-duplicates by bottom-k sketches from one hash function.

1. A document's shingles are hashed once to 64 bits, and its sketch retains the ``k`` smallest values; a set of up to k
   values is retained whole.  Documents with equal sets form a class, and its smallest doc_id stands for it.
2. Inverted lists: retained values are ordered by how many classes retain them (in powers of two), then by hash.  Two
   sets that share at least c of their retained values share one among the first r - c + 1 of each (r retained), in any
   order that both use, so only those are listed, rarest first.  Where both sets are whole c is exact; else it lies six
   standard deviations under what a linked pair shares.  Lists of the same members are one list.
3. First each list is compared with its smallest id only (long lists with two more), a star.  Its pairs pass an
   estimate from the sketch of the union, then exact Jaccard on full sets: the retained ones where both are whole, else
   sets made again from the whole texts, once for each document.  Connected components of these links follow.
4. Pairs of a list within one component need no further look.  The others are all compared: in short lists pair by
   pair, in long ones in blocks by size of the set, where what is not in the list's main component meets the members
   whose size is near enough.  Links join components, so none that could matter is left out.

Stars and components keep the work near the size of the lists for large groups of near copies; no list's pairs are
written out, no list is cut.  A long list whose members are much alike and still not linked (similarity between the
listing's bound and t) has all its pairs of near size compared, in blocks of bounded memory: that work is quadratic in
such a group, as exact answers are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Folders, tasks

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Values of the coarse sketch, the first of the sketch, and of the coarser one that is compared before it.
COARSE, COARSER = 64, 24
#: Characters that are shingled at a time.
STEP_BYTES = 2 << 20
#: Blocks that a row goes to.
PLACES = "array<struct<g:int,i:int,h:int,j:int,rest:boolean>>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start : start + size], eight bytes at a time; data ends with 16 bytes more."""
    h = mixed(size.astype(np.uint64) * MIX[2])
    eight = data[: len(data) // 8 * 8].view(np.uint64)
    at, live = start, np.arange(len(start))
    left = size
    while len(live):
        bits = ((at & 7) << 3).astype(np.uint64)
        low, high = eight[at >> 3] >> bits, eight[(at >> 3) + 1]
        chunk = np.where(bits > 0, low | (high << ((np.uint64(64) - bits) & np.uint64(63))), low)
        spare = ((8 - np.minimum(left, 8)) << 3).astype(np.uint64)
        h[live] = mixed(h[live] * MIX[2] + ((chunk << spare) >> spare))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of texts, A-Z in lower case.

    Words are maximal runs of other characters than space and U+0009 to U+000D; a text of fewer words than a shingle is
    one shingle.
    """

    def __init__(self, size: int):
        self.size = size

    def rolled(self, h: np.ndarray, width: int) -> np.ndarray:
        total = np.full(max(0, len(h) - width + 1), np.uint64(width))
        for i in range(width):
            total = mixed(total * MIX[2] + h[i : len(total) + i])
        total[total == NONE] = 0
        return total

    def together(self, texts) -> Iterator[np.ndarray]:  # noqa: ANN001
        """The sets of an array of texts (not null, beginning at no offset), all words at once."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
        data = np.zeros((len(raw) + 23) // 8 * 8, np.uint8)
        data[: len(raw)] = raw
        upper = (raw >= 65) & (raw <= 90)
        data[: len(raw)] += upper.astype(np.uint8) << 5
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        # A text's first byte begins a word even if the text before does not end with a gap.
        begins = ~gap
        begins[1:] &= gap[:-1]
        edges = ends[:-1][ends[:-1] < len(raw)]
        begins[edges] = ~gap[edges]
        start = np.flatnonzero(begins)
        stops = np.append(np.flatnonzero(gap), len(raw))
        owner = np.searchsorted(ends, start, "right") - 1
        size = np.minimum(stops[np.searchsorted(stops, start)], ends[owner + 1]) - start
        h = word_hashes(data, start, size)
        n = np.bincount(owner, minlength=len(texts))
        first = (np.cumsum(n) - n).tolist()
        total = self.rolled(h, self.size)
        for a, m in zip(first, n.tolist()):
            part = total[a : a + m - self.size + 1] if m >= self.size else self.rolled(h[a : a + m], m) if m else total[:0]
            part = np.sort(part)
            fresh = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=fresh[1:])
            yield part[fresh]

    def parts(self, ids, texts) -> Iterator[tuple]:  # noqa: ANN001
        """Runs of ids with the sets of their texts; a few megabytes of text are held at a time."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(texts):
            group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // STEP_BYTES
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for a, b in zip(edges, edges[1:]):
                at = pa.array(np.arange(a, b))  # taken, not sliced: buffers begin at no offset
                yield ids.take(at), list(self.together(texts.take(at).cast(pa.large_string()).fill_null("")))


def sketch(values: np.ndarray, k: int = COARSE) -> bytes:
    """The upper halves of the k smallest values; NONE's upper half where there are fewer."""
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    top = (values[:k] >> np.uint64(32)).astype(np.uint32)
    out[: len(top)] = top
    return out.tobytes()


def sketches(reps: DataFrame, width: int) -> DataFrame:
    """id, n, s: sketches of the retained values."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s = pa.array([sketch(unsigned(v), width) for v in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s], names=["id", "n", "s"])

    return reps.select("id", "n", "v").mapInArrow(run, "id long, n long, s binary")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of each row of two arrays of sketches: the share of common values among the k smallest of the union."""
    k = a.shape[1]
    u = np.sort(np.hstack([a, b]), axis=1)
    real = u != 0xFFFFFFFF
    again = np.zeros_like(real)
    again[:, 1:] = (u[:, 1:] == u[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    within = rank <= k
    return (again & within).sum(axis=1) / np.maximum(1, np.minimum(rank[:, -1], k))


def margin(t: float, k: int) -> float:
    """A similarity that pairs at t or more have in sketches of k, but for a chance of about one in a billion."""
    return max(1.5 / k, t - 6 * math.sqrt(t * (1 - t) / k))


def floor_share(t: float, k: int) -> float:
    """The share of common values among the k smallest of a union that pairs at t or more fall short of with a chance under one in a billion."""
    m, tail = 0, (1 - t) ** k
    while tail < 1e-9:
        m += 1
        tail += math.comb(k, m) * t**m * (1 - t) ** (k - m)
    return m / k


def similar(a: np.ndarray, whole_a: bool, b: np.ndarray, whole_b: bool, t: int, k: int) -> tuple[bool, bool]:
    """Whether two sets are linked, exactly if both are whole; else whether the sketch of their union lets them be."""
    common = np.intersect1d(a, b, assume_unique=True)
    if whole_a and whole_b:
        return 100 * len(common) >= t * (len(a) + len(b) - len(common)), True
    union = np.union1d(a, b)[:k]
    return bool(np.searchsorted(common, union[-1], "right") >= len(union) * margin(t / 100, k)), False


def list_array(sets: list[np.ndarray]):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def unsigned(value) -> np.ndarray:  # noqa: ANN001
    return value.values.to_numpy().view(np.uint64)


def signatures(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """doc_id, n, digest, retained values (sorted, as signed) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingler(shingle)
        for batch in batches:
            for ids, sets in shingles.parts(batch.column(0), batch.column(1)):
                digest = [blake2b(v.tobytes(), digest_size=16).digest() for v in sets]
                columns = [ids, pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), list_array([v[:k] for v in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "v"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, v array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, n, v: the full sets, but for empty ones, of the rows with the given ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingler(shingle)
        for batch in batches:
            for ids, sets in shingles.parts(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, sets), pa.int64()), list_array(sets)], names=["id", "n", "v"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, "id long, n long, v array<long>").where("n > 0")


def listed(n: int, r: int, t: int, k: int) -> int:
    """How many of r retained values of a set of n are listed."""
    # A linked partner of a set this small is whole too.
    c = -(-t * n // 100) if 100 * n <= t * k else math.floor(k * margin(t / 100, k))
    return max(1, r - c + 1)


def prefixes(reps: DataFrame, heavy: DataFrame, t: int, k: int) -> DataFrame:
    """value, id, extra: what of each class is listed; extra, what hash alone would not list.  heavy (value, df) is sent to every task; its caller bounds it."""
    rows = heavy.select("value", F.log2("df").cast("byte").alias("df")).toPandas()
    value, df = rows["value"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(np.int8)
    order = np.argsort(value)
    sent = reps.sparkSession.sparkContext.broadcast((value[order].tobytes(), df[order].tobytes()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, df = np.frombuffer(sent.value[0], np.uint64), np.frombuffer(sent.value[1], np.int8)
        for batch in batches:
            values, counts, extra = [], [], []
            for n, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                own = unsigned(v)
                many = listed(n, len(own), t, k)
                last = own[min(many, len(own)) - 1]
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, df[at], 0), kind="stable")]
                values.append(own[:many])
                counts.append(min(many, len(own)))
                extra.append(own[:many] > last)
            if values:
                ids = np.repeat(batch.column(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(ids), pa.array(np.concatenate(extra))], names=["value", "id", "extra"])

    return reps.select("id", "n", "v").mapInArrow(run, "value long, id long, extra boolean")


def close_sizes(a: Column, b: Column, t: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * t


def likely(pairs: DataFrame, reps: DataFrame, t: int, made: Folders, few: int) -> DataFrame:
    """The pairs (a, b) of close sizes whose union's sketches, the coarser one first, estimate enough.

    Few pairs pass the coarser one, so the wider one moves for few.  Up to ``few`` ids (16 bytes each) go to the scan of
    the sets, so that only their sketches move, and to the pairs.
    """

    def passing(width: int, limit: float):  # noqa: ANN202
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, width) for i in (2, 3))
                yield batch.filter(pa.array(estimates(a, b) >= limit)).select(["a", "b"])

        return run

    pairs = made.materialise(pairs, "near-listed")
    for width, limit in ((COARSER, floor_share(t / 100, COARSER)), (COARSE, margin(t / 100, COARSE))):
        ids = made.materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-asked")
        asked = ids.count() <= few
        s = made.materialise(sketches(reps.join(F.broadcast(ids), "id", "left_semi") if asked else reps, width), "near-sketches")
        p = pairs
        if asked:
            sizes = s.groupBy("id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
            for side in "ab":
                p = p.join(F.broadcast(sizes.select(F.col("id").alias(side), F.col("low").alias(f"l{side}"), F.col("high").alias(f"h{side}"))), side)
            p = p.where("hb * 100 >= la * %d and ha * 100 >= lb * %d" % (t, t)).select("a", "b")
        p = p.join(s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        p = p.join(s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
        p = p.where(close_sizes(F.col("na"), F.col("nb"), t)).select("a", "b", "sa", "sb").mapInArrow(passing(width, limit), "a long, b long")
        passed = made.materialise(p.distinct(), "near-likely")
        made.drop(pairs, ids, s)
        pairs = passed
    return pairs


def compare(pairs: DataFrame, sets: DataFrame, t: int, k: int, made: Folders, few: int, run_size: int = 64) -> DataFrame:
    """a, b, sure: the pairs (a, b) that are linked (sure), or that the sketch of the union lets be.

    Of a pair the one in more pairs is the center; sets (id, n, v) of the partners travel to it, in runs of about
    run_size partners, so a star of any size is spread and its center moves once a run.  Up to ``few`` pairs (24 bytes each) are broadcast to the scan of the sets; more are joined with a shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, centers = None, []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for a, salt, b, n, v in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                v = unsigned(v)
                if b is None:  # several only where a doc_id has several texts
                    if (a, salt) != key:
                        key, centers = (a, salt), []
                    centers.append((v.copy(), len(v) == n))
                    continue
                if (a, salt) != key:
                    raise ValueError("a star without its center")
                found = [sure for c, whole in centers for passes, sure in [similar(c, whole, v, len(v) == n, t, k)] if passes]
                if found:
                    for column, x in zip(out, (a, b, any(found))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "sure"])

    small = F.broadcast if pairs.count() <= few else (lambda df: df)
    degree = made.materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")), "near-degrees")
    for side in "ab":
        pairs = pairs.join(small(degree.select(F.col("id").alias(side), F.col("d").alias(f"d{side}"))), side)
    center = F.struct(F.when(F.col("db") > F.col("da"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("db") > F.col("da"), F.col("a")).otherwise(F.col("b")).alias("b"))
    pairs = pairs.select(center.alias("c"), F.greatest("da", "db").alias("d")).select("c.a", "c.b", "d")
    pairs = made.materialise(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / run_size))).drop("d"), "near-pairs")
    partners = sets.join(small(pairs), F.col("id") == F.col("b")).select("a", "salt", "b", "n", "v")
    centers = sets.join(small(pairs.select("a", "salt").distinct()), F.col("id") == F.col("a")).select("a", "salt", F.lit(None).cast("long").alias("b"), "n", "v")
    rows = partners.unionByName(centers).repartition(tasks(sets.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long, sure boolean").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, repeated: DataFrame, shingle: int, t: int, k: int, made: Folders, few: int, estimated: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b), and those estimated on retained sets before, whose full sets have 100 * intersection >= t * union.

    repeated: the ids of several rows; only their full sets are shuffled so that each different one stays once.
    """
    found = made.materialise(compare(pairs, reps.select("id", "n", "v"), t, k, made, few), "near-compared")
    links, left = found.where("sure").select("a", "b"), found.where("not sure").select("a", "b")
    if estimated is not None:
        left = made.materialise(left.union(estimated).distinct(), "near-left")
    n_left = left.count()
    if not n_left:
        return links
    made.free()
    small = F.broadcast if n_left <= few else (lambda df: df)
    ids = made.materialise(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-open")
    again = made.materialise(ids.join(repeated, "id", "left_semi"), "near-again")
    if again.isEmpty():
        full = whole_sets(docs, small(ids), shingle)
    else:
        ids = made.materialise(ids.join(again, "id", "left_anti"), "near-open")
        full = whole_sets(docs, small(ids), shingle).unionByName(whole_sets(docs, small(again), shingle).dropDuplicates(["id", "v"]))
    full = made.materialise(full, "near-full")
    return links.union(compare(left, full, t, k, made, few).where("sure").select("a", "b"))


def components(links: DataFrame, made: Folders) -> DataFrame:
    """id, comp (the smallest id reachable) of all ids in links (a, b).  Labels move to neighbours, then to the label's label."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b")
    both = made.materialise(both.distinct().toDF("id", "to"), "near-edges")
    labels = made.materialise(both.groupBy("id").agg(F.least("id", F.min("to")).alias("comp")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        moved = made.materialise(labels.join(near, "id").select("id", F.least("comp", "c").alias("comp"), F.col("comp").alias("old")), "near-labels")
        up = moved.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = made.materialise(moved.join(up, "comp").select("id", F.col("up").alias("comp"), "old"), "near-labels")
        made.drop(labels, moved)
        labels = new.select("id", "comp")
        if new.where("comp <> old").limit(1).count() == 0:
            made.drop(both)
            return labels


def stars_of(lists: DataFrame) -> DataFrame:
    """a, b: each member of a list with each of its hubs."""
    stars = lists.select("id", F.explode("hubs").alias("hub")).where("id <> hub")
    return stars.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def short_pairs(lists: DataFrame) -> DataFrame:
    """a, b of short lists, over different components."""
    g = lists.groupBy("value").agg(F.collect_list(F.struct("id", "comp")).alias("l"))
    g = g.where(F.exists("l", lambda x: x["comp"] != F.col("l")[0]["comp"]))
    p = g.select(F.explode("l").alias("x"), "l").select("x", F.explode("l").alias("y")).where("x.id < y.id and x.comp <> y.comp")
    return p.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def forest(rest: np.ndarray, others: np.ndarray, comp: dict[int, int], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (rest[i], others[j]) those that join components not joined yet."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for a, b in zip(rest[i].tolist(), others[j].tolist()):
        x, y = find(comp[a]), find(comp[b])
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return out


def common_counts(rest: list[np.ndarray], others: list[np.ndarray], step: int = 1024) -> np.ndarray:
    """Size of the intersection of each set of rest with each of others; the sets hold distinct values."""
    sizes = [len(x) for x in rest] + [len(x) for x in others]
    values, at = np.unique(np.concatenate([*rest, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    row, col = row[shared[at]], number[at[shared[at]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(rest), len(others)), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        use = slice(*np.searchsorted(col, (a, a + step)))
        matrix = np.zeros((len(sizes), step), np.float32)
        matrix[row[use], col[use] - a] = 1
        out += matrix[: len(rest)] @ matrix[len(rest) :].T
    return out


def filled(rows: list[np.ndarray], width: int) -> np.ndarray:
    """The rows as one array, filled up with NONE."""
    out = np.full((len(rows), width), NONE)
    for r, x in enumerate(rows):
        out[r, : len(x)] = x
    return out


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value that each row of a shares with that of b; rows hold distinct values and are filled up with NONE."""
    u = np.sort(np.hstack([a, b]), axis=1)
    twice = (u[:, 1:] == u[:, :-1]) & (u[:, 1:] != NONE)
    at = twice.argmax(axis=1)
    return np.where(twice.any(axis=1), u[np.arange(len(u)), at], NONE)


def in_blocks(lists: DataFrame, reps: DataFrame, t: int, block: int, made: Folders) -> DataFrame:
    """Members of lists over several components, dealt to blocks in which all are compared.

    Sizes of sets fall into bins by powers of 100 / t, so that linked sets lie in the same bin or in neighbouring ones.
    A list of up to ``block`` members is one block (i is -1), in which each stands once.  Of longer ones a block
    (value, g, i, h, j) holds a part i of bin g of what is not in the list's main component (rest), and a part j of bin h
    of the whole list.  Only ids that such a list holds bring their sets.
    """
    per = lists.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("value").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most")
    # A document stands in a bounded number of lists, no more than its listed values.
    own = lists.groupBy("id").agg(F.collect_set("value").alias("own"))
    held = made.materialise(lists.join(main.select("value", "main", "all"), "value").withColumn("other", F.col("comp") != F.col("main")).drop("main", "m"), "near-held")
    sets = made.materialise(reps.join(held.select("id").distinct(), "id", "left_semi").select("id", "n", "v", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(t, 99)) + 1e-9).cast("int").alias("bin")), "near-long-sets")
    rows = made.materialise(held.join(sets.select("id", "bin").distinct(), "id"), "near-rows")
    cells = made.materialise(rows.where(F.col("all") > block).groupBy("value", "bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.ceil(F.count_if("other") / block).cast("int").alias("parts")), "near-cells")
    left = cells.where("parts > 0").select("value", F.col("bin").alias("g"), "parts", F.explode(F.array(F.col("bin") - 1, "bin", F.col("bin") + 1)).alias("h"))
    left = left.join(cells.select("value", F.col("bin").alias("h"), "blocks"), ["value", "h"])
    # Where a row goes is settled before it brings its set, so that each set is joined once.
    as_member = left.groupBy("value", F.col("h").alias("bin")).agg(F.collect_list(F.struct("g", "parts", "blocks")).alias("below"))
    as_other = left.groupBy("value", F.col("g").alias("bin")).agg(F.collect_list(F.struct("h", "parts", "blocks")).alias("above"))
    rows = rows.join(as_member, ["value", "bin"], "left").join(as_other, ["value", "bin"], "left")

    def place(g, i, h, j, rest) -> Column:  # noqa: ANN001
        return F.struct(*[F.lit(x).cast("int").alias(name) if isinstance(x, int) else x.cast("int").alias(name) for name, x in (("g", g), ("i", i), ("h", h), ("j", j))], rest.alias("rest"))

    def turns(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    members = F.flatten(F.transform("below", lambda c: F.transform(turns(c["parts"]), lambda i: place(c["g"], i, F.col("bin"), F.pmod(F.xxhash64("id"), c["blocks"]), F.lit(False)))))
    others = F.flatten(F.transform("above", lambda c: F.transform(turns(c["blocks"]), lambda j: place(F.col("bin"), F.pmod(F.xxhash64("id", F.lit(1)), c["parts"]), c["h"], j, F.lit(True)))))
    none = F.array().cast(PLACES)
    long = F.concat(F.coalesce(members, none), F.when(F.col("other"), F.coalesce(others, none)).otherwise(none))
    rows = rows.select("value", "id", F.col("bin").alias("at"), "comp", F.when(F.col("all") <= block, F.array(place(0, -1, 0, 0, F.col("other")))).otherwise(long).alias("places"))
    # By id alone, as own is: sets move once.  An id has several only where its texts differ; each has its bin.
    rows = rows.where(F.size("places") > 0).join(sets.join(own, "id"), "id").where(F.abs(F.col("at") - F.col("bin")) < 1)
    return rows.select(F.explode("places").alias("p"), "value", "id", "n", "bin", "comp", "v", "own").select("p.*", "value", "id", "n", "bin", "comp", "v", "own")


def long_links(lists: DataFrame, reps: DataFrame, t: int, k: int, block: int, made: Folders) -> DataFrame:
    """a, b, sure over different components in long lists.

    Where both sets are retained whole exact Jaccard is taken in the block, and no more links leave it than join
    components (sure); of the others those pairs that pass the estimate, each in its first common list only.
    """
    import pyarrow as pa

    limit = margin(t / 100, k)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def run(block):  # noqa: ANN001, ANN202
        value = np.array([block.column("value")[0].as_py()]).view(np.uint64)[0]
        rest, id_, n, bin_, comp = (block.column(c).to_numpy() for c in ("rest", "id", "n", "bin", "comp"))
        v, own = ([unsigned(x) for x in block.column(c)] for c in ("v", "own"))
        alone = block.column("i")[0].as_py() < 0
        first = {(rest[x], id_[x], v[x].tobytes()): x for x in reversed(range(len(v)))}
        keep = np.sort(np.fromiter(first.values(), np.int64, len(first)))
        comps = dict(zip(id_.tolist(), comp.tolist()))
        low, high, sure = [], [], []
        for g in np.unique(bin_[keep[rest[keep]]]).tolist():
            r = keep[rest[keep] & (bin_[keep] == g)]
            e = keep[abs(bin_[keep] - g) <= 1] if alone else keep[~rest[keep]]
            if not len(e):
                continue
            nr, ne = n[r][:, None], n[e][None, :]
            common = common_counts([v[x] for x in r], [v[x] for x in e])
            apart = comp[r][:, None] != comp[e][None, :]
            whole = (nr <= k) & (ne <= k)
            linked = whole & apart & (100 * common >= t * (nr + ne - common))
            for a, b in forest(id_[r], id_[e], comps, *np.nonzero(linked)):
                low.append(a), high.append(b), sure.append(True)
            least = np.minimum(nr, ne)
            i, j = np.nonzero(~whole & apart & (common >= limit * np.minimum(k, least) - 1e-6) & (least * 100 >= np.maximum(nr, ne) * t))
            width = max(len(own[x]) for x in keep)
            wide = {side: filled([own[x] for x in at], width) for side, at in (("r", r), ("e", e))} if len(i) else {}
            for x in range(0, len(i), 4_000):
                ii, jj = i[x : x + 4_000], j[x : x + 4_000]
                here = first_common(wide["r"][ii], wide["e"][jj]) == value
                for p, q in zip(r[ii[here]].tolist(), e[jj[here]].tolist()):
                    if similar(v[p], n[p] <= k, v[q], n[q] <= k, t, k)[0]:
                        low.append(min(id_[p], id_[q])), high.append(max(id_[p], id_[q])), sure.append(False)
        return pa.table([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sure, pa.bool_())], schema=schema)

    return in_blocks(lists, reps, t, block, made).groupBy("value", "g", "i", "h", "j").applyInArrow(run, "a long, b long, sure boolean").distinct()


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: int = 80, k: int = 256, short: int = 64, block: int = 1024, max_heavy: int = 500_000, few: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are runs of other characters than space and U+0009 to U+000D, A-Z lower-cased; a set is the distinct shingles
    of that many words, the whole sequence if it is shorter.  Null and empty texts and texts of white space have no
    shingles and link with nothing.  Rows with a null doc_id link with nothing, have a null component_id and are kept.
    Rows of the same doc_id are one document's: what links one links all.  Very long texts count whole; a set that is
    too large to be retained is made again when it must be compared.  Ties do not arise: the smallest doc_id is the
    component's.  An empty table gives an empty table.  Only doc_id and text are read, so other columns may have any name.

    k values are retained of a set.  Physical bounds, without effect on the result: lists over ``short`` members are
    compared in blocks of up to ``block``; at most ``max_heavy`` of the most frequent values (9 bytes each) decide the
    order of listing; up to ``few`` pairs or ids (24 bytes each) are broadcast, more are joined with a shuffle.  Listed
    values, whose number grows with the corpus, always take the shuffle.
    """
    t, made = similarity, Folders(docs.sparkSession)
    keep = made.materialise

    def alone(make, name: str) -> DataFrame:  # noqa: ANN001
        """What make(folders) returns, written; what it wrote on its way is deleted then."""
        own = Folders(docs.sparkSession)
        out = keep(make(own), name)
        own.drop_all()
        own.free()
        return out

    sig = keep(signatures(docs, shingle, k), "near-sets")
    real = sig.where("doc_id is not null and n > 0")
    classes = keep(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1").select("digest", "rep"), "near-classes")
    own = keep(real.select("doc_id", "n", "digest").join(classes, "digest", "left"), "near-own")
    made.drop(classes)
    # Rows that another one of their class stands for, and a class's representative where its row is repeated.
    per = keep(own.where("rep is not null").groupBy("doc_id", "digest", "rep").agg(F.count(F.lit(1)).alias("c")).where("doc_id <> rep or c > 1"), "near-copies")
    repeated = per.where("doc_id = rep").select("doc_id", "digest")
    n_copies = per.count()
    small = F.broadcast if n_copies <= few else (lambda df: df)
    reps = real.join(small(per.select("doc_id", "digest")), ["doc_id", "digest"], "left_anti")
    if not repeated.isEmpty():
        reps = reps.unionByName(real.join(small(repeated), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]))
    reps = reps.select(F.col("doc_id").alias("id"), "n", "v")
    if n_copies > few:
        reps = keep(reps, "near-reps")
    # How many classes would list a value by hash alone.
    first = F.when(F.col("n") * 100 <= t * k, F.col("n") - F.ceil(F.col("n") * t / 100) + 1).otherwise(F.least("n", F.lit(k)) - math.floor(k * margin(t / 100, k)) + 1)
    counts = keep(reps.select(F.explode(F.slice("v", F.lit(1), first.cast("int"))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-often")
    made.free()
    bound = short
    while counts.where(F.col("df") > bound).count() > max_heavy:
        bound *= 2
    index = keep(prefixes(reps, counts.where(F.col("df") > bound), t, k), "near-index")
    # A value is listed by two only if hash alone lists it twice or if another order brought it up.
    shared = keep(counts.select("value").union(index.where("extra").select("value").distinct()), "near-shared")
    # Once more: just after the counts were written their shuffle files were still held.
    made.free()
    held = keep(index.join(shared.hint("merge"), "value", "left_semi").select("value", "id"), "near-held")
    made.drop(counts, index, shared)
    made.free()
    # The smallest id of a list is its hub; long lists have two more, as one may be an odd copy.
    odd = F.lit(0x2F0B4C47A95D6E13)
    hubs = held.groupBy("value").agg(
        F.count(F.lit(1)).alias("m"), F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.col("id").bitwiseXOR(odd)).alias("other"),
        F.bit_xor(F.xxhash64("id")).alias("f1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("f2"),
    ).where("low < high")
    # Of lists with the same members one is enough.
    hubs = hubs.groupBy("m", "f1", "f2", "low", "high", "other").agg(F.min("value").alias("value"))
    hubs = keep(hubs.select("value", "m", F.when(F.col("m") > short, F.array("low", "high", F.col("other").bitwiseXOR(odd))).otherwise(F.array("low")).alias("hubs")), "near-hubs")
    lists = keep(held.join(hubs, "value"), "near-lists")
    made.drop(held, hubs)
    made.free()
    stars = alone(lambda f: likely(stars_of(lists), reps, t, f, few), "near-stars")
    again = keep(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("c > 1"), "near-repeated")
    ids = again.select(F.col("doc_id").alias("id"))
    links = alone(lambda f: confirm(stars, reps, docs, ids, shingle, t, k, f, few), "near-links")
    # What links one row of a doc_id links all.
    several = again.where("x <> y").select("doc_id")
    same = own.where("rep <> doc_id").join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = keep(links.union(same), "near-joined")
    first = components(links, made)
    labelled = lists.select("value", "id", "m").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = keep(labelled, "near-labelled")
    made.drop(lists)
    blocks = alone(lambda f: long_links(labelled.where(F.col("m") > short), reps, t, k, block, f), "near-blocks")
    fresh = short_pairs(labelled.where(F.col("m") <= short)).distinct().join(stars, ["a", "b"], "left_anti")
    open_ = blocks.where("not sure").select("a", "b").join(stars, ["a", "b"], "left_anti")
    more = alone(lambda f: likely(fresh, reps, t, f, few), "near-more")
    made.drop(labelled)
    found = alone(lambda f: blocks.where("sure").select("a", "b").union(confirm(more, reps, docs, ids, shingle, t, k, f, few, open_)), "near-found")
    made.drop(stars)
    last = first if found.isEmpty() else components(links.union(found), made)
    own = own.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    out = own.join(last.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    rest = sig.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = keep(out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-out")
    made.drop_all(out)
    return out
