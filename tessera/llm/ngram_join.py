"""Operator 6: exact Jaccard similarity join of word shingle sets, with signature trees.

1. One scan adds up a count sketch of all shingles (fixed size).  It only orders shingles: those that the sketch shows
   to be very frequent come last, all others by hash.  Any order gives the right result.
2. A second scan gives each document its set's identity and its prefix, the first n - ceil(t n) + 1 shingles in that
   order.  Two sets of similarity t or more share a shingle of both prefixes.  Documents with equal sets are one class.
3. Classes that share a prefix shingle are a group; groups of the same members are kept once and groups with the same
   anchor become one.
4. Members of large groups are checked against their groups' pivots, so that most of a large group of near copies is
   linked by about as many pairs as it has members, not by their square.
5. Groups that still hold more than one component are searched by signature trees: leaves of classes of similar size, nodes
   with OR-combined (and AND-combined) bitmaps of their shingles and the range of sizes.  Two trees, or one with itself, are
   walked together and a pair of nodes is dropped when no member of one can overlap enough with any of the other, by sizes
   or by bitmaps, or when both hold just one and the same component.  Groups too large for a task are cut into blocks and
   each pair of blocks is a task of its own.
6. What is left is verified on the whole sets, and components follow from the links by minimum labels.

Shuffled are prefixes, then bitmaps of classes that share something; whole sets only for pairs that bitmaps let pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import read, written
from .shingles import mix64, text_sets

SIMILARITY = 75  # per cent
SKETCH_BITS = 21
FILTER_BITS = (20, 27)  # least and most of a filter of set identities; between, 16 an identity
BLOCK = 2048  # members of a group that one task walks at once
PIVOT_FROM = 8  # members of a group from which on it gets pivots first
PIVOTS = 6
SALTS = 64  # parts of a group
REMEMBERED = 1_000_000  # identities that a task knows again; those beyond are repeated, and made distinct later
LEAF = 16
FAN = 8


# --- sketches of fixed size ----------------------------------------------------------------------


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _summed(rows: DataFrame, bits: int) -> np.ndarray:
    """Adds up (chunk, counts) rows of zlib-packed 32-bit counts; the result has 2^bits numbers, whatever the data."""

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for b in batches:
            for c in b["counts"]:
                total = total + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        yield pd.DataFrame({"chunk": [key[0]], "counts": [packed]})

    out = np.zeros(1 << bits, np.uint32)
    for r in rows.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
        out[r["chunk"] * len(part) : (r["chunk"] + 1) * len(part)] = part
    return out


def _packed(counts: np.ndarray, chunks: int = 16) -> pa.RecordBatch:
    parts = counts.astype(np.uint32).reshape(chunks, -1)
    return pa.RecordBatch.from_pydict(
        {"chunk": pa.array(range(chunks), pa.int32()), "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())}
    )


def shingle_sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents' shingles fall in each of 2^bits slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            sets = [s for s in text_sets(b.column(0)) if len(s)]
            if sets:
                total += np.bincount(_slots(np.concatenate(sets), bits), minlength=1 << bits)
        yield _packed(total)

    return _summed(docs.select(F.col("text").cast("string")).mapInArrow(count, "chunk int, counts binary"), bits)


def frequent_slots(sketch: np.ndarray) -> np.ndarray:
    """The sketch where it is above what chance makes of shingles of one document each, else 0."""
    mean = float(sketch.mean())
    return np.where(sketch > mean + 3 * mean**0.5 + 8, sketch, 0).astype(np.uint32)


def set_id(s: np.ndarray) -> int:
    """A 64-bit identity of a sorted set."""
    place = mix64(np.arange(1, len(s) + 1, dtype=np.uint64))
    return int((mix64(s ^ place).sum() + np.uint64(len(s))).astype(np.int64)) if len(s) else 0


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The prefix's shingles that aren't frequent, and those that are."""
    n = len(s)
    take = n - -(-percent * n // 100) + 1 if n else 0
    often = frequent[_slots(s, SKETCH_BITS)]
    if not often.any():
        return s[:take], s[:0]
    first = np.lexsort((s, often))[:take]
    return s[first[often[first] == 0]], s[first[often[first] > 0]]


# --- bitmaps and trees ---------------------------------------------------------------------------


def bitmap(s: np.ndarray) -> np.ndarray:
    """Two bits a shingle or more (four where that is few, to tell small sets apart), a power of two, as 64-bit words."""
    n = max(1, len(s))
    bits = max(64, min(4096, 1 << int(4 * n - 1).bit_length()), 1 << int(2 * n - 1).bit_length())
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    flags = np.zeros(bits, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap brought down to ``size`` words: upper halves OR-ed onto lower ones."""
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


class Node:
    """Members first..last of the size-sorted arrays, their OR and AND bitmaps, sizes and components."""

    __slots__ = ("all", "any", "children", "comp", "first", "high", "last", "low", "one")

    def __init__(self, first: int, last: int, n: np.ndarray, comp: np.ndarray, some: np.ndarray, every: np.ndarray, children: list[Node]):
        self.first, self.last, self.children = first, last, children
        self.low, self.high = int(n[first]), int(n[last - 1])
        self.any, self.all = some, every
        self.comp = int(comp[first])
        self.one = bool((comp[first:last] == comp[first]).all())


def build(n: np.ndarray, comp: np.ndarray, maps: np.ndarray) -> Node:
    """A tree over members sorted by size."""
    level = [
        Node(i, min(i + LEAF, len(n)), n, comp, np.bitwise_or.reduce(maps[i : i + LEAF]), np.bitwise_and.reduce(maps[i : i + LEAF]), [])
        for i in range(0, len(n), LEAF)
    ]
    while len(level) > 1:
        level = [
            Node(c[0].first, c[-1].last, n, comp, np.bitwise_or.reduce([x.any for x in c]), np.bitwise_and.reduce([x.all for x in c]), c)
            for c in (level[i : i + FAN] for i in range(0, len(level), FAN))
        ]
    return level[0]


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1).astype(np.int64)


def may_link(a: Node, b: Node, percent: int) -> bool:
    """Whether any member of one node can reach the similarity with any of the other.

    The overlap is at most a member's size less the bits that all of its node have and none of the other node has.
    """
    if a.one and b.one and a.comp == b.comp:
        return False
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    overlap = min(a.high - int(_bits(a.all & ~b.any)), b.high - int(_bits(b.all & ~a.any)))
    # overlap >= p (x + y) / (100 + p) for the smallest sizes that the nodes have
    return (100 + percent) * overlap >= percent * (a.low + b.low)


def walk(a: Node, b: Node, left: tuple, right: tuple, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of members that may link, from two trees walked together; a tree with itself gives pairs i < j."""
    stack = [(a, b)]
    same = a is b
    (n1, c1, m1), (n2, c2, m2) = left, right
    while stack:
        x, y = stack.pop()
        if not may_link(x, y, percent):
            continue
        if x.children and (not y.children or x.last - x.first >= y.last - y.first) and not (same and x is y):
            stack += [(c, y) for c in x.children]
        elif y.children and not (same and x is y):
            stack += [(x, c) for c in y.children]
        elif x.children:
            stack += [(c, d) for i, c in enumerate(x.children) for d in x.children[i:]]
        else:
            i, j = slice(x.first, x.last), slice(y.first, y.last)
            miss1 = _bits(m1[i][:, None, :] & ~m2[j][None, :, :])
            miss2 = _bits(m2[j][None, :, :] & ~m1[i][:, None, :])
            p, q = n1[i][:, None], n2[j][None, :]
            overlap = np.minimum(p - miss1, q - miss2)
            ok = ((100 + percent) * overlap >= percent * (p + q)) & (c1[i][:, None] != c2[j][None, :])
            if same and x is y:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            u, v = np.nonzero(ok)
            if len(u):
                yield u + x.first, v + y.first


def tree_pairs(n: np.ndarray, comp: np.ndarray, maps: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may link: within side 0 if that is all there is, else between sides 0 and 1.

    Members are cut by size into bands that share a bitmap length, so small sets aren't held in long bitmaps.
    """
    order = np.lexsort((comp, n))
    groups, at = [], 0
    while at < len(order):  # bands of sizes z to z / t: a member meets its own band and the next
        end = int(np.searchsorted(n[order], n[order[at]] * 100 // percent, "right"))
        groups.append(order[at:end])
        at = end
    for k, g in enumerate(groups):
        for h in groups[k : k + 2]:
            both = g if h is g else np.r_[g, h]
            size = min(len(maps[i]) for i in both)
            for a, b in _sides(g, h, side):
                if len(a) and len(b):
                    data = []
                    for part in (a, b) if a is not b else (a,):
                        m = np.array([fold(maps[i], size) for i in part])
                        data.append((n[part], comp[part], m))
                    trees = [build(*d) for d in data]
                    for u, v in walk(trees[0], trees[-1], data[0], data[-1], percent):
                        yield a[u], b[v]


def _sides(g: np.ndarray, h: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    if not side.any():
        return [(g, h)]
    pairs = [(g[side[g] == 0], h[side[h] == 1])]
    return pairs if g is h else [*pairs, (g[side[g] == 1], h[side[h] == 0])]


# --- the join ------------------------------------------------------------------------------------


def document_prefixes(docs: DataFrame, frequent: np.ndarray, percent: int = SIMILARITY, row: Column | None = None) -> DataFrame:
    """(doc_id, row, h, n, keys, hot, bits): ``row`` as given (a binary column, null if None), the set's identity and size, its prefix (the frequent shingles of it apart) and its
    bitmap; the last three only once for equal sets that a task sees."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # 8 MB

    def lists(parts: list[np.ndarray]) -> pa.Array:
        bounds = np.r_[0, np.cumsum([len(k) for k in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(bounds, np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            ids, sizes, keys, hot, bits = [], [], [], [], []
            for s in text_sets(b.column(2)):
                h = set_id(s)
                ids.append(h)
                sizes.append(len(s))
                again = h in done or not len(s)
                bits.append(None if again else bitmap(s).tobytes())
                cold, often = prefix(s[:0] if again else s, shared.value, percent)
                keys.append(cold)
                hot.append(often)
                if len(done) < REMEMBERED:
                    done.add(h)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists(keys), lists(hot), pa.array(bits, pa.binary())],
                ["doc_id", "row", "h", "n", "keys", "hot", "bits"],
            )

    kinds = "doc_id long, row binary, h long, n long, keys array<long>, hot array<long>, bits binary"
    named = F.lit(None).cast("binary") if row is None else row
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(rows, kinds)


def marked(bits: int, keys: np.ndarray) -> np.ndarray:
    """A filter of 2^bits bits with those of ``keys`` set."""
    flags = np.zeros(1 << bits - 3, np.uint8)
    at = _slots(mix64(keys.view(np.uint64)), bits)
    np.bitwise_or.at(flags, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return flags


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, tokens) of the sets whose identity is in ``wanted`` (h), and of a few more.

    ``wanted`` becomes a filter, so that texts of no interest are dropped where they are read.  Its bits follow the number
    of identities up to 16 MB; beyond some eight million identities it passes more sets than are wanted, none less.
    """
    low, high = FILTER_BITS
    bits = min(high, max(low, (16 * wanted.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits - 3, np.uint8)
        for b in batches:
            flags |= marked(bits, np.asarray(b.column(0)))
        yield _bit_rows(flags)

    shared = docs.sparkSession.sparkContext.broadcast(_ored(wanted.select("h").mapInArrow(mark, "chunk int, bits binary"), bits))  # 16 MB at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        done: set[int] = set()
        for b in batches:
            out: list[tuple] = []
            for s in text_sets(b.column(0)):
                h = set_id(s)
                if len(s) and h not in done:
                    at = int(_slots(mix64(np.array([h], np.int64).view(np.uint64)), bits)[0])
                    if flags[at >> 3] >> (at & 7) & 1:
                        out.append((h, s.tobytes()))
                        if len(done) < REMEMBERED:
                            done.add(h)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], ["h", "tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "h long, tokens binary").dropDuplicates(["h"])


def _bit_rows(flags: np.ndarray) -> pa.RecordBatch:
    parts = flags.reshape(16, -1)
    return pa.RecordBatch.from_pydict({"chunk": pa.array(range(16), pa.int32()), "bits": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})


def _ored(rows: DataFrame, bits: int) -> np.ndarray:
    def join(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["bits"]:
                part = np.frombuffer(zlib.decompress(x), np.uint8)
                total = part if total is None else total | part
        yield pd.DataFrame({"chunk": [key[0]], "bits": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros((16, 1 << bits - 7), np.uint8)
    for r in rows.groupBy("chunk").applyInPandas(join, "chunk int, bits binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out.reshape(-1)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The (a, b) pairs whose whole sets reach the similarity."""
    one = sets.select(F.col("h").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("h").alias("b"), F.col("tokens").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def plausible(pairs: DataFrame, bitmaps: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The (a, b) pairs whose sizes and bitmaps allow the similarity."""
    one = bitmaps.select(F.col("h").alias("a"), F.col("n").alias("p"), F.col("bits").alias("x"))
    two = bitmaps.select(F.col("h").alias("b"), F.col("n").alias("q"), F.col("bits").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            sizes = zip(b.column("p").to_pylist(), b.column("q").to_pylist(), strict=True)
            for i, ((p, q), x, y) in enumerate(zip(sizes, b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                x, y = fold(x, size), fold(y, size)
                overlap = min(p - int(_bits(x & ~y)), q - int(_bits(y & ~x)))
                keep[i] = (100 + percent) * overlap >= percent * (p + q)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    near = pairs.select("a", "b").join(one, "a").join(two, "b").where(100 * F.least("p", "q") >= percent * F.greatest("p", "q"))
    return near.select("a", "b", "p", "q", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(h, comp) of all ends of (a, b) links: minimum labels over links, with jumps to the label's own label."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("least")).select("h", F.least("h", "least").alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("h", "b"), "b").groupBy(F.col("a").alias("h")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "h").select("h", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("h").alias("next"), F.col("comp").alias("far"))
        after = written(moved.join(jump, "next", "left").select("h", F.col("comp").alias("old"), F.least("next", F.coalesce("far", "next")).alias("comp")), "labels")
        labels = after.select("h", "comp")
        if not after.where("old != comp").limit(1).count():
            return labels


def tree_candidates(members: DataFrame, bitmaps: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Distinct (a, b) pairs of different components that may link, from (key, h, n, comp, size) rows of groups of ``size``."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("of", blocks).withColumn("block", F.pmod(F.xxhash64("h"), F.col("of")).cast("int"))
    # a pair of blocks (i, j), i <= j, is a task; a member of block k goes to all pairs with k
    turn = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = dealt.withColumn("at", F.explode(turn)).select("key", "at.i", "at.j", "h", "n", "comp", "block")
    rows = dealt.join(bitmaps.select("h", "bits"), "h")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (key, i, j), so a group ends where the next begins."""
        held: list[pd.DataFrame] = []
        for b in batches:
            ids = list(zip(b["key"], b["i"], b["j"], strict=True))
            ends = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
            parts = [b.iloc[s:e] for s, e in zip([0, *ends], [*ends, len(ids)], strict=True)]
            for p in parts:
                if held and tuple(held[0].iloc[0][["key", "i", "j"]]) != tuple(p.iloc[0][["key", "i", "j"]]):
                    yield from found(held)
                    held = []
                held.append(p)
        if held:
            yield from found(held)

    def found(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = held[0] if len(held) == 1 else pd.concat(held)
        n, comp, h = (g[c].to_numpy(np.int64) for c in ("n", "comp", "h"))
        if len(g) < 2 or (comp == comp[0]).all():
            return
        maps = [np.frombuffer(x, np.uint64) for x in g["bits"]]
        side = (g["block"] == g["j"]).to_numpy(np.int64) if g["i"].iloc[0] != g["j"].iloc[0] else np.zeros(len(g), np.int64)
        for u, v in tree_pairs(n, comp, maps, side, percent):
            yield pd.DataFrame({"a": np.minimum(h[u], h[v]), "b": np.maximum(h[u], h[v])})

    tasks = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tasks.select("key", "i", "j", "h", "n", "comp", "block", "bits").mapInPandas(search, "a long, b long").distinct()


def grouped(base: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(key, h, n): classes that share a prefix shingle, of each group of the same members one, without members that no
    other of the group is near to in size.

    Rows of a shingle that isn't frequent meet in one task, once; those of frequent ones are added up before they meet.
    """
    # keys are never null; said here, both uses below are the same shuffle
    cold = base.select("h", "n", F.explode("keys").alias("key")).where("key is not null").repartition("key").distinct()
    hot = base.select("h", "n", F.explode("hot").alias("key")).distinct()
    once, twice = F.xxhash64("h", F.lit(1)), F.xxhash64("h", F.lit(2))
    kept = None
    for rows in (cold, hot):
        found = rows.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(once).alias("x"), F.sum(twice % (1 << 40)).alias("y")).where("size > 1")
        kept = found if kept is None else kept.union(found)
    kept = kept.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = written(cold.join(kept, "key", "left_semi").union(hot.join(kept, "key", "left_semi")), "members")
    # Sizes of a band are near each other; a member of a band with no other has a partner only in the bands beside it.
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)) * (1 - 1e-9))).cast("int")
    banded = members.withColumn("band", band)
    bands = banded.groupBy("key", "band").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    beside = W.partitionBy("key").orderBy("band")  # a row a band, some hundred at most
    # written, so that Spark can split a key's rows in the join, which it can't beside a groupBy of the same key
    bands = written(bands.select("key", "band", "size", F.lag("high").over(beside).alias("less"), F.lead("low").over(beside).alias("more")), "bands")
    near = (F.col("size") > 1) | (100 * F.col("less") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("more"))
    return banded.join(bands, ["key", "band"]).where(F.coalesce(near, F.lit(False))).select("key", "h", "n")


def candidates(docs: DataFrame, percent: int = SIMILARITY, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The document_prefixes, the groups (key, h, n, degree) and the bitmaps (h, n, bits) of classes that share something."""
    base = written(document_prefixes(docs, frequent_slots(shingle_sketch(docs)), percent, row), "prefixes")
    members = anchored(written(grouped(base, percent), "near"))
    ends = members.select("h").distinct()
    bitmaps = written(base.where("bits is not null").select("h", "n", "bits").join(ends, "h", "left_semi").dropDuplicates(["h"]), "bitmaps")
    return base, members, bitmaps


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Null and wordless texts have no shingles and link with nothing; rows with a null doc_id lead no component (one of only
    such rows has a null component_id); repeated rows are in one component; an empty table gives no rows; other columns
    are ignored.
    """
    return near_classes(docs, percent).select("doc_id", "n_shingles", "component_id")


def near_classes(docs: DataFrame, percent: int = SIMILARITY, row: Column | None = None) -> DataFrame:
    """(doc_id, row, n_shingles, component, component_id) of every row, as :func:`near_duplicates`; ``row`` is what the caller
    names rows by, ``component`` tells the components apart (also those of null ids) and is null without a shingle."""
    base, members, bitmaps = candidates(docs, percent, row)
    starred = pivot_pairs(members, percent)
    links = _links(docs, plausible(starred, bitmaps, percent), percent)
    now = members.join(components(links), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    now = written(now, "components")
    mixed = now.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key", "size")
    rest = written(now.join(written(mixed, "mixed"), "key").select("key", "h", "n", "comp", "size"), "rest")
    labels = components(links.union(_links(docs, tree_candidates(rest, bitmaps, percent), percent)))

    classes = base.groupBy("h", "n").agg(F.min("doc_id").alias("first"))
    heads = classes.join(labels, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    least = heads.where("n > 0").groupBy("comp").agg(F.min("first").alias("component"))
    named = heads.where("n > 0").join(least, "comp").select("h", "n", F.col("comp").alias("linked"), "component")
    rows = base.select("doc_id", "row", "h", "n")
    return rows.join(named, ["h", "n"], "left").select(
        "doc_id",
        "row",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("linked")).alias("component"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def linked_classes(docs: DataFrame, percent: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The join itself: (doc_id, h, n_shingles, n_links) of every row, and all (a, b) pairs of different sets, by identity,
    that link.

    ``n_links`` counts the other rows that a row links with, those of its own class among them; pairs within a class aren't
    listed.  Odd rows are as in :func:`near_duplicates`.
    """
    base, members, bitmaps = candidates(docs, percent)
    sizes = written(members.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    alone = members.join(sizes, "key").select("key", "h", "n", F.col("h").alias("comp"), "size")
    links = _links(docs, tree_candidates(alone, bitmaps, percent), percent)
    sizes = written(base.where("n > 0").groupBy("h").agg(F.count("*").alias("rows")), "classes")
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("h", "other")
    more = ends.join(sizes.select(F.col("h").alias("other"), "rows"), "other").groupBy("h").agg(F.sum("rows").alias("more"))
    told = sizes.join(more, "h", "left").select("h", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    rows = base.select("doc_id", "h", F.col("n").alias("n_shingles"))
    return rows.join(told, "h", "left").select("doc_id", "h", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def anchored(members: DataFrame) -> DataFrame:
    """Groups with the same anchor, their member with the least hash, as one group under the anchor's name; ``degree`` is in
    how many groups a member was.

    Near copies share many shingles, so they are in many groups of almost the same members; those mostly have one anchor.
    Members that were in a group together still are.
    """
    anchors = written(members.groupBy("key").agg(F.min_by("h", F.xxhash64("h")).alias("anchor")), "anchors")
    named = members.join(anchors, "key").select(F.col("anchor").alias("key"), "h", "n").distinct()
    degrees = members.groupBy("h").agg(F.count("*").alias("degree"))
    return written(named.join(degrees, "h").select("key", "h", "n", "degree"), "groups")


def pivot_pairs(members: DataFrame, percent: int = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """(a, b) pairs of members of large groups with their groups' pivots: the members that are in most groups, as those of
    near copies are that have the fewest edits."""
    large = written(members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= PIVOT_FROM).select("key"), "large")
    first = lambda rows, *by: rows.withColumn("turn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("degree"), "h"))).where(F.col("turn") <= pivots)
    # the first of each part of a group, then of all parts of the large groups
    parts = first(members.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")), "key", "salt")
    chosen = written(first(parts.join(large, "key", "left_semi"), "key").select("key", F.col("h").alias("b"), F.col("n").alias("m")), "pivots")
    near = members.join(chosen, "key").where((F.col("h") != F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    return near.select(F.greatest("h", "b").alias("a"), F.least("h", "b").alias("b")).distinct()


def _links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Verified links among candidate (a, b) pairs."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    return written(verified(pairs, whole_sets(docs, ends), percent), "links")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
