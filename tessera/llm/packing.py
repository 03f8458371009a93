"""Operator 1: best-fit packing of documents into sequences, by linear grouping.

How it runs on Spark:

1. Executors tokenize every text, cut the documents longer than a sequence and write
   one narrow row a piece (no token leaves the executors but through the checksum).
2. Spark counts pieces by length.  A length is at most the capacity, so this histogram has
   at most ``capacity`` rows however large the corpus is; only it reaches the driver.
3. The driver plans on the histogram (:func:`plan_bins`).  Large lengths are cut into groups of
   equal cardinality and each group is rounded up to its largest length; the linear program of all
   configurations of the few sizes left is solved by column generation and each configuration is
   used as often as its value rounded down says, what remains by one configuration after another;
   the actual lengths take the place of the rounded ones, the last of a bin being the longest that
   fits; and the small lengths go, best fit first, into what is left.  Bins that look alike are handled as one run, so the plan is bounded as the
   histogram is.
4. Spark numbers the pieces of each length, salted so that a length with a third of all rows is
   spread, and joins the plan by length and number: that is each piece's sequence and offset.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import held, read, written

CAPACITY = 2048
GROUPS = 64
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Unicode White_Space, as the tokenizer's own pattern means it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks that can be encoded apart, as the tokenizer's pattern always has a border where they begin: spaces but the last
#: one before a word; a word before a space or common sign; signs before a space; else all up to the next space.
_CHUNK = re.compile(
    f"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]?[^\\W_]+(?=[.,;:!?|#$%&*{_SPACE}]|$)|[.,;:!?|#$%&*]+(?=[{_SPACE}]|$)"
    f"|[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+"
)
_CACHE_LIMIT = 500_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others take letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to token ids (little-endian 32-bit), remembering the ids of chunks already seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}

    def ids(self, chunk: str) -> list[int]:
        """A chunk of letters alone is one piece for the model; others go through the whole tokenizer."""
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # chunks don't begin where special tokens do
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        chunks = _CHUNK.findall(text)
        known = self.known
        if len(known) > _CACHE_LIMIT:
            known.clear()
        for c in chunks:
            if c not in known:
                ids = self.ids(c)
                known[c] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, chunks))


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32): pieces of ``capacity`` tokens, the first takes the remainder."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    start, length = 0, first
    for piece in range(1 + (n - first) // capacity):
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, length = start + length, capacity


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row a piece: its place in the document, length in tokens and the CRC-32 of its ids.

    Null texts count as empty and give one piece that is the end token alone; a null doc_id stays null;
    repeated rows give repeated pieces; an empty table gives no rows; other columns are left out.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = held(vocabulary, lambda: Encoder(vocabulary))
        for b in batches:
            rows = [
                (i, *p)
                for i, t in zip(b["doc_id"], b["text"], strict=True)
                for p in cut(encoder.encode(t or "") + end, capacity)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(pieces, PIECES)


# --- planning on the histogram -------------------------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> dict[int, int]:
    """length -> rounded length: the lengths, from the longest, in groups of about equal cardinality."""
    share, rounded, seen, top = max(1, -(-sum(counts.values()) // groups)), {}, 0, 0
    for length in sorted(counts, reverse=True):
        if not top or seen >= share:
            top, seen = length, 0
        rounded[length] = top
        seen += counts[length]
    return rounded


def best_fill(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often to take each size for the most value within ``capacity``, and that value: a table row for each number of
    items and column for each room."""
    rooms = np.arange(capacity + 1)
    before = rooms[None, :] - sizes[:, None]
    fits, before = before >= 0, np.maximum(before, 0)
    best, taken = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        more = np.where(fits, best[before] + values[:, None], -1.0)
        which = more.argmax(axis=0)
        most = more[which, rooms]
        better = most > best + 1e-12
        if not better.any():
            break
        taken.append(np.where(better, which, -1))
        best = np.where(better, most, best)
    times, room = np.zeros(len(sizes), np.int64), capacity
    for which in reversed(taken):
        if which[room] >= 0:
            times[which[room]] += 1
            room -= sizes[which[room]]
    return times, float(best[capacity])


def configurations(demand: dict[int, int], capacity: int, slack: float = 1e-3, steps: int = 1000) -> list[tuple[dict[int, int], float]]:
    """(size -> times, bins) for the configurations of the linear program that covers ``demand`` with the fewest bins.

    Column generation: from the program's prices of sizes the most valuable filling of a bin is found; it enters by a simplex
    step until none is worth more than a bin, the value is within ``slack`` of the bound that prices give, or ``steps`` end.
    """
    if not demand:
        return []
    sizes = np.array(sorted(demand, reverse=True))
    wanted = np.array([demand[s] for s in sizes.tolist()], np.float64)
    columns = np.diag(capacity // sizes)
    inverse, x, bound = np.diag(1.0 / (capacity // sizes)), wanted / (capacity // sizes), 0.0
    for _ in range(steps):
        times, value = best_fill(sizes, inverse.sum(axis=0), capacity)
        bound = max(bound, x.sum() / value)
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + slack):
            break
        step = inverse @ times
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1.0), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        inverse[out] /= step[out]
        rest = step.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        columns[:, out] = times
    return [({int(s): int(n) for s, n in zip(sizes, columns[:, k], strict=True) if n}, float(x[k])) for k in np.argsort(-x)]


def fullest(sizes: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The configuration that holds the longest size left and, with it, leaves the least room: [(size, times)]."""
    first = max(sizes)
    room = capacity - first
    # reach[r]: the last size taken on one way to a sum of r; sizes from long to short, so long ones go first.
    reach: dict[int, tuple[int, int]] = {0: (0, 0)}  # sum -> (size, sum before)
    bits = 1
    for size in sorted(sizes, reverse=True):
        if size > room:
            continue
        left = min(sizes[size] - (size == first), room // size)
        for _ in range(left):
            new = (bits << size) & ~bits & ((1 << (room + 1)) - 1)
            if not new:
                break
            bits |= new
            while new:
                low = (new & -new).bit_length() - 1
                reach[low] = (size, low - size)
                new &= new - 1
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, Counter({first: 1})
    while at:
        size, at = reach[at]
        used[size] += 1
    return sorted(used.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for pieces counted by length: (length, first, count, times, bin, offset) and the number of bins.

    The pieces of ``length`` numbered ``first .. first + count - 1`` go ``times`` to a bin, into the bins from
    ``bin`` on, the first of each at ``offset``.  Lengths up to ``small`` (an eighth of the capacity) are small.
    """
    small = capacity // 8 if small is None else small
    large = {n: c for n, c in counts.items() if n > small}
    rounded = linear_groups(large, groups)
    demand: Counter = Counter()
    for n, c in large.items():
        demand[rounded[n]] += c
    alone = {size for size in demand if size + min(demand) > capacity}  # nothing goes beside these
    shapes = [({size: 1}, float(demand[size])) for size in sorted(alone)]
    shapes += configurations({size: n for size, n in demand.items() if size not in alone}, capacity)
    left, lengths, number = dict(large), sorted(large), dict.fromkeys(large, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of bins (first, count)

    def place(taken: Counter, run: int) -> None:
        nonlocal bins
        offset = 0
        for n, times in taken.items():
            rows.append((n, number[n], run * times, times, bins, offset))
            number[n] += run * times
            left[n] -= run * times
            offset += n * times
            if not left[n]:
                del left[n]
                del lengths[bisect.bisect_left(lengths, n)]
        room[capacity - offset].append((bins, run))
        bins += run

    for shape, value in shapes:
        again = int(value + 1e-6)
        slots = [size for size, times in sorted(shape.items(), reverse=True) for _ in range(times)]
        while again:  # a run: as many bins as the actual lengths stay the same
            taken: Counter = Counter()
            rest = capacity
            for k, size in enumerate(slots):
                # a document of the slot's group; the last one is the longest that fits, of that group or a longer one
                most = rest if k == len(slots) - 1 else min(size, rest)
                at = bisect.bisect_right(lengths, most) - 1
                while at >= 0 and left[lengths[at]] <= taken[lengths[at]]:
                    at -= 1
                if at < 0 or rounded[lengths[at]] < size:
                    break
                taken[lengths[at]] += 1
                rest -= lengths[at]
            else:
                k += 1
            if k < len(slots):  # other bins took its documents; what is left of its groups is filled at the end
                break
            run = min(again, *(left[n] // times for n, times in taken.items()))
            place(taken, run)
            again -= run
    while left:
        shape = fullest(left, capacity)
        place(Counter(dict(shape)), min(left[n] // times for n, times in shape))

    # Small lengths, longest first, into the run with the least room that holds them.
    open_rooms = sorted(r for r in room if r)
    for n in sorted((x for x in counts if x <= small), reverse=True):
        number, have = 0, counts[n]
        while have:
            fit = next((r for r in open_rooms if r >= n and room.get(r)), None)
            if fit is None:
                times = min(capacity // n, have)
                run = max(1, have // times)
                rows.append((n, number, run * times, times, bins, 0))
                first, bins, base = bins, bins + run, 0
                rest = capacity - n * times
            else:
                first, run = room[fit].pop()
                times = min(fit // n, have)
                whole = have // times
                if whole < run:
                    room[fit].append((first + whole, run - whole))
                    run = whole
                rows.append((n, number, run * times, times, first, capacity - fit))
                rest = fit - n * times
            number += run * times
            have -= run * times
            if rest:
                if not room.get(rest):
                    open_rooms = sorted({*open_rooms, rest})
                room[rest].append((first, run))
    return rows, bins


# --- the operator --------------------------------------------------------------------------------


def numbered(pieces: DataFrame, rows: int) -> DataFrame:
    """Adds ``number``, from 0 within each length.

    Numbers are counted within (length, salt) and moved up by the counts of the salts before, so no task gets more
    than a salt's share of a length.  Salts grow with the rows.
    """
    salts = max(256, rows // 50_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("within", F.row_number().over(within) - 1)
        .join(before, ["length", "salt"])
        .withColumn("number", F.col("before") + F.col("within"))
        .drop("salt", "before", "within")
    )


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``; no sequence is over ``capacity``.

    An empty table gives no rows; null texts are empty texts; repeated rows are packed once each; ties in length are
    broken by hash, so reruns agree; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, vocabulary, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = plan_bins(counts, capacity, groups)
    # At most a few rows for each of the `capacity` lengths: the plan's size doesn't depend on the corpus.
    places = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "length long, first long, count long, times long, bin long, offset long")
    slots = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "count", "times", "bin", "offset"))).alias("slots"))
    n = numbered(pieces, sum(counts.values()))
    placed = n.join(F.broadcast(slots), "length").withColumn(
        "slot", F.get(F.filter("slots", lambda s: (s["first"] <= F.col("number")) & (F.col("number") < s["first"] + s["count"])), F.lit(0))
    )
    turn = F.col("number") - F.col("slot.first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("slot.bin") + F.floor(turn / F.col("slot.times"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + turn % F.col("slot.times") * F.col("length")).cast("long").alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
