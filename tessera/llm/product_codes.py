"""Operator 11: compressing vectors to product codes, the codebooks learned by Lloyd's rounds with partition-local heaps.

Vectors are cut into equal parts and each part position has a codebook of entries.  A part is bounded by its exact distance to
its own entry (upper) and to the next best entry (lower).  As entries move, the slack lower - upper can shrink by no more than
its own entry's drift plus the largest drift of any other; that sum is added up by entry over the rounds, so the bounds of
single parts are never touched.  The parts of each entry lie in a heap by slack, raised by what had been added up when they
went in: a round pops the parts whose key the entry's sum has reached, as only their entry may have changed, and measures those
against all entries exactly.  All others are known to stay, ties included, without being looked at.

Vectors are whole numbers, so sums and distances are exact, and an entry's sum is kept up by what came and went.

A block, one row of some megabytes, holds vectors with their heaps; blocks stay where they are, a round is a pass over them
that writes them with their new heaps to the shared folder.  What leaves a task is the change of each entry's sum and count;
the driver sees the codebooks only (``entries`` x the vectors' length), whatever the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_NUMBERS = 1 << 20  # numbers in a block: four megabytes of them
STATE = "x binary, n int, sizes binary, rows binary, keys binary, moved binary"
BEYOND = 1 << 27  # larger numbers can't be squared and added up in 64 bits


# --- one block -----------------------------------------------------------------------------------


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of whole numbers, as 64-bit integers.

    By one matrix product where all its sums are whole numbers that doubles hold, else by differences, some rows at a time.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) <= 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    step = max(1, (1 << 20) // max(1, book.size))
    for i in range(0, len(x), step):
        d = x[i : i + step, None, :].astype(np.int64) - book[None]
        out[i : i + step] = (d * d).sum(2)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack): the nearest entry, the lower of equal ones, and by how much the next best is farther, rounded down so
    that a float holds no more than the truth; without another entry the slack has no end."""
    d = distances(x, book)
    entry = d.argmin(1)
    at = np.arange(len(x))
    upper = np.sqrt(d[at, entry].astype(np.float64))
    if len(book) == 1:
        return entry, np.full(len(x), np.inf)
    d[at, entry] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64))
    return entry, (lower - upper) - 1e-12 * (lower + upper)


def key_of(slack: np.ndarray, drift: np.ndarray | float) -> np.ndarray:
    """Heap keys: slack plus what has been added up of its entry's drift, rounded down to 32 bits."""
    key = np.where(np.isinf(slack), slack, slack + drift - 1e-12 * (np.abs(slack) + drift))
    return np.nextafter(key.astype(np.float32), np.float32(-np.inf))


class Heaps:
    """The heaps of one part position in a block: the parts' places and keys, entry after entry, each in heap order."""

    def __init__(self, sizes: np.ndarray, rows: np.ndarray, keys: np.ndarray):
        self.sizes, self.rows, self.keys = sizes, rows, keys

    @classmethod
    def of(cls, entry: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, entry))  # what is sorted is a heap
        return cls(np.bincount(entry, minlength=entries).astype(np.int32), order.astype(np.int32), keys[order])

    def entries(self) -> np.ndarray:
        """Each part's entry."""
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out

    def round(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Brings the heaps up to ``book``: (places, entry before, entry now) of the parts that changed theirs."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        some = np.flatnonzero(self.sizes)
        due = some[self.keys[starts[some]] <= drift[some]]  # a heap whose least key holds is left alone
        heaps = {j: list(zip(self.keys[starts[j] : ends[j]].tolist(), self.rows[starts[j] : ends[j]].tolist(), strict=True)) for j in due.tolist()}
        popped, was = [], []
        for j, heap in heaps.items():
            limit, n = float(drift[j]), len(popped)
            while heap and heap[0][0] <= limit:
                popped.append(heappop(heap)[1])
            was += [j] * (len(popped) - n)
        places, was = np.array(popped, np.int64), np.array(was, np.int64)
        if not len(places):
            return places, was, was
        now, slack = nearest(x[places], book)
        keys = key_of(slack, drift[now])
        for row, j, key in zip(popped, now.tolist(), keys.tolist(), strict=True):
            if j not in heaps:
                heaps[j] = list(zip(self.keys[starts[j] : ends[j]].tolist(), self.rows[starts[j] : ends[j]].tolist(), strict=True))
            heappush(heaps[j], (key, row))
        new_rows, new_keys = [], []
        for j in range(len(self.sizes)):
            if j in heaps:
                self.sizes[j] = len(heaps[j])
                new_rows.append(np.array([r for _, r in heaps[j]], np.int32))
                new_keys.append(np.array([k for k, _ in heaps[j]], np.float32))
            else:
                new_rows.append(self.rows[starts[j] : ends[j]])
                new_keys.append(self.keys[starts[j] : ends[j]])
        self.rows, self.keys = np.concatenate(new_rows), np.concatenate(new_keys)
        moved = now != was
        return places[moved], was[moved], now[moved]


def added_up(x: np.ndarray, entry: np.ndarray, entries: int, sign: int = 1) -> np.ndarray:
    """(entries x (1 + width)): the count and the sum of the rows of each entry."""
    out = np.zeros((entries, 1 + x.shape[1]), np.int64)
    if len(entry):
        order = np.argsort(entry, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(entry[order]) > 0])
        out[entry[order][first], 0] = np.diff(np.r_[first, len(order)])
        out[entry[order][first], 1:] = np.add.reduceat(x[order].astype(np.int64), first, axis=0)
    return sign * out


# --- blocks on Spark -----------------------------------------------------------------------------


def kept_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): rows whose vector isn't null and has only finite components, as whole numbers."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def first_books(kept: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """(parts x entries x width): the parts of the smallest vec_ids, ties by the vector and nulls last; None without a vector.

    Raises where a vector can't be cut into ``parts`` or isn't of the first one's length, or a number is over ``BEYOND``.
    """
    first = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return None
    d = len(first[0])
    if d % parts:
        raise ValueError(f"vectors of {d} numbers can't be cut into {parts} equal parts")
    x = whole_numbers(pa.array(first, pa.list_(pa.int64())), d)
    return x.reshape(len(x), parts, d // parts).transpose(1, 0, 2).copy()


def whole_numbers(v: pa.ListArray, d: int) -> np.ndarray:
    """Vectors as rows; raises where one isn't of length ``d`` or has a number over ``BEYOND``."""
    if (np.diff(v.offsets.to_numpy()) != d).any():
        raise ValueError(f"vectors of other lengths than {d}")
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), d)
    if x.max(initial=0) > BEYOND or x.min(initial=0) < -BEYOND:
        raise ValueError(f"a number over {BEYOND} in steps of 1/{SCALE}")
    return x


def blocks(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """A row a block: vec_ids and labels as lists, the vectors, and their heaps after a first full look at all entries."""
    parts, entries, width = books.shape
    d, size = parts * width, max(1, BLOCK_NUMBERS // max(1, parts * width))
    ids, label = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    kinds = f"vec_ids array<{ids}>, labels array<{label}>, {STATE}"

    def row(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        vec_ids, labels, v = (pa.concat_arrays([b.column(c) for b in batches]) for c in ("vec_id", "label", "v"))
        x = whole_numbers(v, d)
        heaps, sums = [], []
        for p in range(parts):
            part = x[:, p * width : (p + 1) * width]
            entry, slack = nearest(part, books[p])
            heaps.append(Heaps.of(entry, key_of(slack, 0.0), entries))
            sums.append(added_up(part, entry, entries))
        one = pa.array([0, len(x)], pa.int32())
        told = {"vec_ids": pa.ListArray.from_arrays(one, vec_ids), "labels": pa.ListArray.from_arrays(one, labels), "x": pa.array([x.astype(np.int32).tobytes()]), "n": pa.array([len(x)], pa.int32())}
        return packed(told, heaps, np.array(sums))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, size):
                some = b.slice(i, size)
                if n + some.num_rows > size and held:
                    yield row(held)
                    held, n = [], 0
                held.append(some)
                n += some.num_rows
        if n:
            yield row(held)

    return kept.mapInArrow(make, kinds)


def packed(told: dict[str, pa.Array], heaps: list[Heaps], moved: np.ndarray) -> pa.RecordBatch:
    """One block as a row; ``moved``: by part and entry the change of the count and the sum."""
    state = {name: b"".join(getattr(h, name).tobytes() for h in heaps) for name in ("sizes", "rows", "keys")} | {"moved": moved.astype(np.int64).tobytes()}
    return pa.RecordBatch.from_pydict(told | {c: pa.array([v], pa.binary()) for c, v in state.items()})


def unpacked(b: pa.RecordBatch, i: int, shape: tuple[int, int, int]) -> tuple[np.ndarray, list[Heaps]]:
    """A block's vectors (rows x parts x width) and heaps."""
    parts, entries, width = shape
    n = b.column("n")[i].as_py()
    of = lambda name, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind).reshape(parts, -1)
    x = np.frombuffer(b.column("x")[i].as_buffer(), np.int32).reshape(n, parts, width)
    return x, [Heaps(s.copy(), r, k) for s, r, k in zip(of("sizes", np.int32), of("rows", np.int32), of("keys", np.float32), strict=True)]


def turned(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after a round: heaps that ``drift`` (parts x entries, added up) has reached are popped and measured anew."""
    parts, entries, _ = books.shape

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, heaps = unpacked(b, i, books.shape)
                moved = []
                for p in range(parts):
                    places, was, now = heaps[p].round(x[:, p], books[p], drift[p])
                    moved.append(added_up(x[places, p], now, entries) - added_up(x[places, p], was, entries))
                told = {c: b.column(c).slice(i, 1) for c in ("vec_ids", "labels", "x", "n")}
                yield packed(told, heaps, np.array(moved))

    return state.mapInArrow(turn, state.schema)


def changes(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """(parts x entries x (1 + width)): the change of counts and sums over all blocks.

    Each task adds up its blocks; the numbers of all tasks are added up by place.
    """
    parts, entries, width = shape
    numbers = parts * entries * (1 + width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(numbers, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                total += np.frombuffer(b.column("moved")[i].as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "change": total[at]}, schema=pa.schema([("at", pa.int64()), ("change", pa.int64())]))

    rows = state.select("moved").mapInArrow(add, "at long, change long").groupBy("at").agg(F.sum("change").alias("change")).collect()
    out = np.zeros(numbers, np.int64)
    for r in rows:
        out[r["at"]] = r["change"]
    return out.reshape(parts, entries, 1 + width)


def drifted(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(parts x entries): how far slack may shrink, an entry's own drift and the largest of any other, rounded up."""
    own = np.sqrt(((after - before).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
    if own.shape[1] == 1:
        return own
    order = np.sort(own, axis=1)
    top, second = order[:, -1:], order[:, -2:-1]
    at = np.arange(own.shape[1]) == own.argmax(1)[:, None]
    return (own + np.where(at, second, top)) * (1 + 1e-12)


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """(blocks assigned to the final codebooks, codebooks); None without a vector.

    Blocks are written after each round, so a lost executor rereads the round before and no more.
    """
    books = first_books(kept, entries, parts)
    if books is None:
        return None
    state = written(blocks(kept, books), "blocks")
    sums, drift = np.zeros((*books.shape[:2], 1 + books.shape[2]), np.int64), np.zeros(books.shape[:2])
    for _ in range(rounds):
        sums += changes(state, books.shape)
        used = sums[:, :, :1] > 0
        after = np.where(used, np.floor_divide(sums[:, :, 1:], np.maximum(sums[:, :, :1], 1)), books)
        drift += drifted(books, after)
        books = after
        state = written(turned(state, books, drift), "blocks")
    return state, books


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of all vectors in blocks that are assigned to ``books``."""
    parts, _, _ = books.shape
    ids, label = (state.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, heaps = unpacked(b, i, books.shape)
                entry = np.stack([h.entries() for h in heaps], axis=1)
                error = np.zeros(len(x), np.int64)
                for p in range(parts):
                    d = x[:, p].astype(np.int64) - books[p][entry[:, p]]
                    error += (d * d).sum(1)
                digits = entry.astype(np.uint8).tobytes().hex()
                codes = [digits[j : j + 2 * parts] for j in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([b.column("vec_ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(rows, f"vec_id {ids}, label {label}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector of finite numbers.

    Rows whose vector is null, or holds null, NaN or infinity, are left out; repeated rows are vectors each and may stand in a
    first codebook twice; null ids come last in order; null labels are one label; with fewer vectors than ``entries`` (256 at
    most) the codebooks are as short; an empty table gives no rows; other columns are ignored.  Vectors of different lengths, of one
    that ``parts`` doesn't divide, or with a number beyond 2^27/1024 raise.
    """
    if entries > 256:
        raise ValueError("a code has two digits a part: 256 entries at most")
    kept = kept_vectors(vectors, vector)
    found = learn(kept, parts, entries, rounds)
    if found is None:
        empty = kept.limit(0)
        return empty.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    state, books = found
    codes = written(coded(state, books), "codes")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))
