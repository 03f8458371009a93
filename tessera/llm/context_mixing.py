"""Operator 8: language-model scores by logistic context mixing of hashed-context bit predictors.

A token is coded as its bytes and an end mark, each byte as eight bits from the highest.  A bit's predictors are the counts
of zeros and ones that training documents had

- after the same one, two and three bytes of the token, in the same turn of the document (hashed tables),
- after the same beginning of the token, and after it in the same turn (exact, of all distinct words).

The turn is what the words before in the document speak for: which of ``TURNS`` classes of training documents (hashes of
``kind``, such as the language) they are most at home in; it moves on with each word.  Weights gated by what the longest
contexts have seen mix the predictors' logits and a table refines the mixed probability; both are learned online over all
training words, in all parts of the vocabulary at once, and the parts' updates are merged.

One more bit, before some segments of a document (they begin after words chosen by hash, every thirty-second or so): does the
segment follow here that followed the same eight words elsewhere in the training documents?  Its probability, from how often
such contexts held what they had promised, is refined as the document is coded by how often they did in it so far.

On Spark: executors count their blocks' words by turn; words meet by hash, then in ranges of the sorted vocabulary, where
the counts of all beginnings are sums over neighbours (beginnings that ranges share are summed on the driver, some hundred
numbers a range); each distinct word and turn is costed once and costs go back to the blocks that need them.  All but the
tables of short contexts, which the number of distinct words sizes up to a bound, grows with the corpus.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, remainder, written
from .shingles import mix64, words_of

TURNS = 8
ORDERS = (1, 2, 3)  # bytes before, within the token, of the hashed contexts
PREDICTORS = len(ORDERS) + 2
BITS = (14, 20)  # least and most of a hashed table; between, by the number of distinct words
EVIDENCE_BITS = 16
GATES = 16
LEVELS = (0.5, 1.5, 3.5, 10.5, 50.5, 500.5)  # of what a context has seen
CELLS = 2 * (len(LEVELS) + 1)
DEPTH = 64  # bytes of a token that exact contexts reach; those beyond have hashed contexts only
RANGE_WORDS = 60_000
BLOCK_BYTES = 32 << 20
CONTEXT = 8  # words before a segment
SEGMENT = 32  # words of one, about
STOP = 32  # the byte that ends a token
END = np.uint64(0x5DEECE66D1CE4E5B)  # the identity of the token that ends a document
_TURN = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = np.uint64(255)  # in a key, where a token has its turn
_PLACES = mix64(np.arange(1, CONTEXT + 1, dtype=np.uint64)) | np.uint64(1)


# --- documents -----------------------------------------------------------------------------------


@dataclass
class Spoken:
    """The tokens of some documents: identity, place in ``data`` (an empty one for ends), document, turn; and segments: first
    token, identity of the words before (0: none) and of those words with the segment; and the documents' bytes."""

    data: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    turns: np.ndarray
    first: np.ndarray
    before: np.ndarray
    pairs: np.ndarray
    docs: np.ndarray

    def keys(self) -> np.ndarray:
        return key_of(self.ids, self.turns)


def key_of(ids: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return mix64(ids + turns.astype(np.uint64) * _TURN)


def spoken(texts: list[str | None], evidence: np.ndarray) -> Spoken:
    """``evidence``: by slot of an identity, how much it speaks for each turn; the last row is what is held at first."""
    parts, found = [(t or "").encode("utf-8", "surrogatepass") for t in texts], []
    for at in lots([len(p) for p in parts]):
        found.append(_spoken(parts[at], evidence))
    if len(found) == 1:
        return found[0]
    if not found:
        return _spoken([], evidence)
    bytes_, tokens, docs = (np.cumsum([0, *n])[:-1] for n in ([len(s.data) for s in found], [len(s.ids) for s in found], [len(s.docs) for s in found]))
    move = {"starts": bytes_, "owner": docs, "first": tokens}
    return Spoken(**{x: np.concatenate([getattr(s, x) + move[x][i] if x in move else getattr(s, x) for i, s in enumerate(found)]) for x in Spoken.__dataclass_fields__})


def lots(lengths: list[int], size: int = 1 << 21) -> Iterator[slice]:
    """Slices of some ``size`` bytes each, or of one longer text."""
    at = 0
    while at < len(lengths):
        last, total = at + 1, lengths[at]
        while last < len(lengths) and total + lengths[last] <= size:
            total += lengths[last]
            last += 1
        yield slice(at, last)
        at = last


def _spoken(parts: list[bytes], evidence: np.ndarray) -> Spoken:
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    ids, starts, ends = words_of(data)
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    owner = np.searchsorted(bounds, starts, "right") - 1
    n = np.bincount(owner, minlength=len(parts))
    after = np.cumsum(n + 1) - 1  # where each document's end goes
    place = np.arange(len(ids)) + owner
    total = len(ids) + len(parts)
    out_ids, out_starts, out_sizes, out_owner = np.full(total, END), np.zeros(total, np.int64), np.zeros(total, np.int32), np.zeros(total, np.int32)
    out_ids[place], out_starts[place], out_sizes[place], out_owner[place] = ids, starts, ends - starts, owner
    out_owner[after] = np.arange(len(parts))
    return Spoken(data, out_ids, out_starts, out_sizes, out_owner, turns_of(out_ids, out_owner, evidence), *segments(out_ids, out_owner), np.fromiter(map(len, parts), np.int64, len(parts)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct key, which of them each key is), in order of appearance."""
    which, found = pd.factorize(keys)
    first = np.empty(len(found), np.int64)
    first[which[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, which


def turns_of(ids: np.ndarray, owner: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """The turn of each token: for which the words before it in its document speak most."""
    if not len(ids):
        return np.zeros(0, np.uint8)
    slot = (ids >> np.uint64(64 - EVIDENCE_BITS)).astype(np.intp)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    runs = np.diff(np.r_[first, len(ids)])
    most, best = np.full(len(ids), -np.inf), np.zeros(len(ids), np.uint8)
    for turn, told in enumerate(evidence.T.astype(np.float64)):
        one = told.take(slot)
        sums = np.cumsum(one)
        sums -= one
        sums -= np.repeat(sums[first], runs)
        sums += told[-1]
        more = sums > most
        np.copyto(most, sums, where=more)
        best[more] = turn
    return best


def segments(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, identity of the ``CONTEXT`` words before, of both) of each segment; a document's first has 0 for the
    words before."""
    n = len(ids)
    begins = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, bool)
    lead = np.flatnonzero(begins)
    inside = np.arange(n) - np.repeat(lead, np.diff(np.r_[lead, n])) if n else np.zeros(0, np.int64)
    cut = (inside >= CONTEXT) & np.r_[False, ids[:-1] % np.uint64(SEGMENT) == 0] if n else begins
    first = np.flatnonzero(begins | cut)
    before = np.zeros(len(first), np.uint64)
    some = cut[first]
    for back in range(CONTEXT):
        before[some] += ids[first[some] - 1 - back] * _PLACES[back]
    before[some] = mix64(before[some]) | np.uint64(1)
    step = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    sums = np.add.reduceat(mix64(ids ^ mix64(step.astype(np.uint64))), first) if n else np.zeros(0, np.uint64)
    return first, before, mix64(sums + before * _TURN)


# --- the predictor -------------------------------------------------------------------------------


def hashed_slots(data: np.ndarray, place: np.ndarray, turns: np.ndarray, bits: int) -> np.ndarray:
    """(orders, bytes, 8): slots of the contexts of each bit of ``data``, whose bytes are at ``place`` of their token."""
    before = np.zeros((len(ORDERS), len(data)), np.uint8)
    for k, order in enumerate(ORDERS):
        before[k, order:] = data[:-order]
    return context_slots(data, before, place, turns, bits)


def context_slots(data: np.ndarray, before: np.ndarray, place: np.ndarray, turns: np.ndarray, bits: int) -> np.ndarray:
    """As :func:`hashed_slots`, for bytes that needn't be neighbours: ``before`` has, by order, the byte that far before each."""
    value = data.astype(np.uint64)
    h, out = mix64(turns.astype(np.uint64) + np.uint64(1)), np.empty((len(ORDERS), len(data), 8), np.int32)
    shifts = np.arange(7, -1, -1, dtype=np.uint64)
    nodes = ((value[:, None] | np.uint64(256)) >> (shifts + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
    for k, order in enumerate(ORDERS):
        h = (h + np.where(place >= order, before[k] + np.uint64(1), np.uint64(0))) * _TURN
        x = (mix64(h + np.uint64(order))[:, None] + nodes) * np.uint64(0x9FB21C651E98DF25)
        np.right_shift(x, np.uint64(64 - bits), out=out[k], casting="unsafe")
        out[k] += np.int32(k << bits)
    return out


@dataclass
class Flat:
    """Words as one run of bytes, each with its end mark."""

    data: np.ndarray
    sizes: np.ndarray  # with the mark
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Flat:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return cls(np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8), sizes, np.cumsum(sizes) - sizes)

    def places(self) -> np.ndarray:
        return np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)

    def heads(self) -> np.ndarray:
        """(words, DEPTH): the first bytes, 0 behind the end mark."""
        out = np.zeros((len(self.sizes), DEPTH), np.uint8)
        place = self.places()
        some = place < DEPTH
        out[np.repeat(np.arange(len(self.sizes)), self.sizes)[some], place[some]] = self.data[some]
        return out


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits rows of bytes have in common at their beginning."""
    differ = a ^ b
    at = (differ != 0).argmax(axis=1)
    byte = differ[np.arange(len(at)), at]
    top = np.frexp(byte.astype(np.float64))[1]
    return np.where(byte == 0, DEPTH * 8, at * 8 + 8 - top)


@dataclass
class Beginnings:
    """The distinct beginnings, of one byte or more, of sorted rows of bytes."""

    at: np.ndarray  # of each byte of each row, the beginning that ends with it
    row: np.ndarray  # of each beginning, a row that has it
    place: np.ndarray  # and how many bytes come before its last
    zeros: np.ndarray  # (beginnings, 8): of all rows that have the same bits before a bit of the last byte, those with a zero
    ones: np.ndarray


def beginnings(heads: np.ndarray, sizes: np.ndarray, c: np.ndarray, apart: np.ndarray | None = None) -> Beginnings:
    """``c``: how often each row counts; rows from an ``apart`` one on share nothing with those before.  Bytes from ``DEPTH``
    on are beginnings of one row each and count nothing."""
    n, ends = len(c), np.minimum(sizes, DEPTH)
    start = np.cumsum(sizes) - sizes
    at = np.zeros(int(sizes.sum()), np.int64)
    common = np.r_[-1, shared_bits(heads[1:], heads[:-1])] if n else np.zeros(0, np.int64)
    if apart is not None:
        common[apart] = -1
    rows, last = np.arange(n), 0
    row, begins, weight = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0)]
    for byte in range(int(ends.max()) if n else 0):
        some = np.flatnonzero(ends[rows] > byte)
        common = np.minimum.reduceat(common[: some[-1] + 1], np.r_[0, some[:-1] + 1])  # those between are of other beginnings
        rows = rows[some]
        new = common < byte * 8 + 8
        first = np.flatnonzero(new)
        at[start[rows] + byte] = last + np.cumsum(new) - 1
        row.append(rows[first])
        begins.append(common[first] < byte * 8)
        weight.append(np.add.reduceat(c[rows], first))
        last += len(first)
    place = np.repeat(np.arange(len(row) - 1), np.array([len(x) for x in row[1:]], np.int64))
    row, begins, weight = map(np.concatenate, (row, begins, weight))
    value = heads[row, place].astype(np.int64)
    far = np.flatnonzero(sizes > DEPTH)
    rest = sizes[far] - DEPTH
    zeros, ones = np.zeros((2, last + int(rest.sum()), 8))
    for bit in range(8 if last else 0):
        top = value >> (8 - bit)
        new = begins | np.r_[True, top[1:] != top[:-1]]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        all_, set_ = np.add.reduceat(weight, first), np.add.reduceat(weight * (value >> (7 - bit) & 1), first)
        zeros[:last, bit] = (all_ - set_)[group]
        ones[:last, bit] = set_[group]
    beyond = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest) + DEPTH
    owner = np.repeat(far, rest)
    at[start[owner] + beyond] = last + np.arange(len(beyond))
    return Beginnings(at, np.r_[row, owner], np.r_[place, beyond], zeros, ones)


def coded(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Two counts as one number of 16 bits: eighths of the logarithm of each, to base 2, plus one."""
    part = lambda n: np.minimum(np.rint(8 * np.log2(1 + n.astype(np.float32))), 255).astype(np.uint16)
    return part(zeros) << np.uint16(8) | part(ones)


DECODED = np.exp2(np.arange(256) / 8) - 1


def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, level, step of the gate) of each code: as it is, less one zero, and less one one (from 65,536 and 131,072 on)."""
    n0, n1 = np.repeat(DECODED, 256), np.tile(DECODED, 256)
    n0, n1 = np.r_[n0, np.maximum(n0 - 1, 0), n0], np.r_[n1, n1, np.maximum(n1 - 1, 0)]
    level = np.searchsorted(LEVELS, n0 + n1) + (np.minimum(n0, n1) < 0.5) * (len(LEVELS) + 1)  # contexts of one value only
    return np.log((n1 + 0.1) / (n0 + 0.1)).astype(np.float32), level.astype(np.int8), np.digitize(n0 + n1, (0.5, 2.5, 20.5)).astype(np.int8)


_LOGIT, _LEVEL, _STEP = code_tables()
_CELL = (np.arange(PREDICTORS) * GATES * CELLS)[:, None]


@dataclass
class Mixer:
    """Coded counts of zeros and ones by slot, gated weights, and the table that refines."""

    codes: np.ndarray
    bits: int
    weights: np.ndarray
    biases: np.ndarray
    refine: np.ndarray

    @classmethod
    def fresh(cls, zeros: np.ndarray, ones: np.ndarray, bits: int) -> Mixer:
        steps = 1 / (1 + np.exp(-(np.arange(33) / 2 - 8)))
        return cls(coded(zeros, ones), bits, np.full(PREDICTORS * GATES * CELLS, 0.3, np.float32), np.zeros(GATES), np.tile(steps, (GATES, 1)))

    def inputs(self, codes: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits (predictors by bit), the weight cell of each, and the gate; with each bit's ``own`` value one of that value
        is taken out of all counts."""
        at = codes.astype(np.intp)
        if own is not None:
            at += (own.astype(np.intp) + 1) << 16
        gate = (_STEP.take(at[-1]) * 4 + _STEP.take(at[-2])).astype(np.intp)
        return _LOGIT.take(at), _CELL + gate * CELLS + _LEVEL.take(at), gate

    def mixed(self, x: np.ndarray, cell: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights.take(cell)).sum(axis=0) + self.biases[gate], -14, 14)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Half the mixed probability, half that of the refining table between its two nearest steps."""
        p = 1 / (1 + np.exp(-z))
        at = np.clip((z + 8) * 2, 0, 31.999)
        low = at.astype(np.int64)
        part = at - low
        t = self.refine[gate, low] * (1 - part) + self.refine[gate, low + 1] * part
        return np.clip(0.5 * p + 0.5 * t, 1e-7, 1 - 1e-7)


class Lot:
    """(word, turn) rows of a range with the exact counts of their beginnings.  All that predicts a bit follows from the turn and
    the bits before, so what rows of a turn have in common is worked out once."""

    def __init__(self, words: list[bytes], turns: np.ndarray, c: np.ndarray, edges: list[tuple[bytes, np.ndarray]]):
        """``edges``: the words at the range's borders, each with the (turns + 1, bits + 1) sums of all words that have as many
        bits in common with it, the last row for all turns."""
        names = sorted(set(words), key=lambda w: w + b" ")
        number = dict(zip(names, range(len(names)), strict=True))
        self.row = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.flat, self.turns, self.c = Flat.of(names), turns, c
        heads = self.flat.heads()
        self.all = np.bincount(self.row, c, len(names))
        near = [(shared_bits(heads, np.frombuffer(head(w), np.uint8)[None, :].repeat(len(names), 0)), w, sums) for w, sums in edges]
        self.of_all = beginnings(heads, self.flat.sizes, self.all)
        self._join(self.of_all, self.of_all.row, np.full(len(self.of_all.row), -1), near)
        self.any_codes = coded(self.of_all.zeros, self.of_all.ones)
        self.order = np.argsort(turns.astype(np.int64) * len(names) + self.row, kind="stable")
        rows, sorted_turns = self.row[self.order], turns[self.order]
        self.sizes = self.flat.sizes[self.row]
        self.start = np.empty(len(words), np.int64)
        self.start[self.order] = np.cumsum(self.sizes[self.order]) - self.sizes[self.order]
        self.of_turn = beginnings(heads[rows], self.flat.sizes[rows], c[self.order], np.flatnonzero(sorted_turns[1:] != sorted_turns[:-1]) + 1)
        self.name, self.turn = rows[self.of_turn.row], sorted_turns[self.of_turn.row]  # of each beginning
        self._join(self.of_turn, self.name, self.turn, near)
        self.own_codes = coded(self.of_turn.zeros, self.of_turn.ones)

    begin = property(lambda self: self.flat.starts * 8, doc="Where the bits of a word are in ``any``.")
    own_begin = property(lambda self: self.start * 8, doc="Where the bits of a row are in ``own``.")
    any = property(lambda self: self.any_codes[self.of_all.at].ravel(), doc="Coded counts of all bits of all words.")
    own = property(lambda self: self.own_codes[self.of_turn.at].ravel(), doc="Coded counts of all bits of all rows, in their turns.")

    def _join(self, part: Beginnings, name: np.ndarray, turn: np.ndarray, near: list) -> None:
        """Puts in the sums over all ranges where a beginning is one of a border's."""
        for common, word, sums in near:
            bits, last = np.unpackbits(np.frombuffer(head(word), np.uint8)), sums.shape[1] - 1
            some = np.flatnonzero(part.place * 8 <= np.minimum(common[name], last - 1))
            depth = part.place[some, None] * 8 + np.arange(8)
            there = (depth <= common[name[some], None]) & (depth < last)
            depth = np.where(there, depth, 0)
            same = sums[turn[some, None], depth + 1]
            rest = sums[turn[some, None], depth] - same
            one = bits[depth] == 1
            part.zeros[some] = np.where(there, np.where(one, rest, same), part.zeros[some])
            part.ones[some] = np.where(there, np.where(one, same, rest), part.ones[some])

    def counts(self, mixer: Mixer, batch: int = 8000) -> tuple[np.ndarray, np.ndarray]:
        """Coded counts (predictors, beginnings, 8) for the bits of the last byte of each turn's beginnings; and that byte."""
        at = self.flat.starts[self.name] + self.of_turn.place
        value = self.flat.data[at]
        codes = np.empty((PREDICTORS, len(at), 8), np.uint16)
        for b in range(0, len(at), batch):
            some = slice(b, b + batch)
            before = self.flat.data[np.maximum(at[some] - np.array(ORDERS)[:, None], 0)]
            codes[: len(ORDERS), some] = mixer.codes.take(context_slots(value[some], before, self.of_turn.place[some], self.turn[some], mixer.bits))
        codes[-2] = self.any_codes[self.of_all.at[at]]
        codes[-1] = self.own_codes
        return codes, value

    def costs(self, mixer: Mixer, batch: int = 4000) -> np.ndarray:
        """log10 probability of each row's word in its turn."""
        codes, value = self.counts(mixer)
        told = np.zeros(len(value))
        for b in range(0, len(value), batch):
            some = slice(b, b + batch)
            bit = np.unpackbits(value[some])
            x, cell, gate = mixer.inputs(codes[:, some].reshape(PREDICTORS, -1))
            p = mixer.refined(mixer.mixed(x, cell, gate), gate)
            told[some] = np.log10(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        out = np.zeros(len(self.row))
        if len(out):
            out[self.order] = np.add.reduceat(told[self.of_turn.at], self.start[self.order])
        return out

    def learn(self, mixer: Mixer, some: np.ndarray, passes: int = 2, batch: int = 300, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Online steps over batches of rows, each weighted by the tokens it stands for and one of its tokens taken out of all
        counts; then the refining table.  What rows of a batch have in common counts once, with the tokens of them all.  Returns
        weights, how much each was used, and the table's ones and zeros."""
        some = some[self.c[some] > 0]
        all_codes, value = self.counts(mixer)
        weights, used = mixer.weights.astype(np.float64), np.zeros(len(mixer.weights))
        own = Mixer(mixer.codes, mixer.bits, weights, mixer.biases, mixer.refine)
        mean, square = np.zeros(len(weights)), np.zeros(len(weights))
        one, zero = np.zeros((GATES, 33)), np.zeros((GATES, 33))
        step = 0
        for turn in range(passes):
            for b in range(0, len(some), batch):
                rows = some[b : b + batch]
                sizes = self.sizes[rows]
                at = np.repeat(self.start[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                these, which = np.unique(self.of_turn.at[at], return_inverse=True)
                times = np.bincount(which, np.repeat(self.c[rows], sizes), len(these))
                bit, w = np.unpackbits(value[these]), np.repeat(times, 8)
                x, cell, gate = own.inputs(all_codes[:, these].reshape(PREDICTORS, -1), bit)
                z = own.mixed(x, cell, gate)
                err = (bit - 1 / (1 + np.exp(-z))) * w
                cells = cell.ravel()
                use = np.bincount(cells, np.tile(w, PREDICTORS), len(weights))
                g = np.bincount(cells, (err * x).ravel(), len(weights)) / (use + times.sum() / len(at) * 20)
                step += 1
                mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
                weights += rate / (1 + 3 * turn / passes) * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
                used += use
                if turn == passes - 1:
                    place = gate * 33 + np.clip(np.rint((z + 8) * 2), 0, 32).astype(np.int64)
                    both, ones = (np.bincount(place, v, GATES * 33).reshape(GATES, 33) for v in (w, w * bit))
                    one += ones
                    zero += both - ones
        return weights, used, one, zero


def head(word: bytes) -> bytes:
    return (word + b" ")[:DEPTH].ljust(DEPTH, b"\0")


# --- on Spark ------------------------------------------------------------------------------------


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``block``: the file and the rows' place in it, whatever the splits of a scan are.  Documents
    that don't come from Parquet files are written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = written(docs, "documents")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    rows = max(1, int(block_bytes * size["n"] / max(1, size["bytes"] or 0)))
    return docs.withColumn("block", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)))


def packed_sums(rows: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """chunk -> sum of its zlib-packed float32 counts, from (chunk, counts) rows; what comes to the driver is of fixed size."""

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for b in batches:
            for x in b["counts"]:
                total = total + np.frombuffer(zlib.decompress(x), np.float32).astype(np.float64)
        yield pd.DataFrame({"chunk": [key[0]], "counts": [zlib.compress(total.astype(np.float32).tobytes(), 1)]})

    summed = rows.groupBy("chunk").applyInPandas(add, kind).toLocalIterator()
    return {r["chunk"]: np.frombuffer(zlib.decompress(r["counts"]), np.float32) for r in summed}


def packed_rows(chunks: Iterator[np.ndarray]) -> pa.RecordBatch:
    rows = [zlib.compress(np.asarray(x, np.float32).tobytes(), 1) for x in chunks]
    return pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(rows)), pa.int32()), "counts": pa.array(rows, pa.binary())})


PACKED = "chunk int, counts binary"


def turn_evidence(docs: DataFrame) -> np.ndarray:
    """(slots + 1, turns): by slot, how much a word speaks for each turn, from (text, class) rows with a class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TURNS << EVIDENCE_BITS, np.int64)
        for b in batches:
            texts, kinds = b.column(0), np.asarray(b.column(1))
            for at in lots([len(x.as_buffer()) for x in texts]):
                parts = [x.encode("utf-8", "surrogatepass") for x in texts[at].to_pylist()]
                ids, starts, _ = words_of(np.frombuffer(b"\n".join([*parts, b""]), np.uint8))
                owner = np.searchsorted(np.cumsum([0, *(len(p) + 1 for p in parts)]), starts, "right") - 1
                slot = (ids >> np.uint64(64 - EVIDENCE_BITS)).astype(np.int64)
                total += np.bincount((kinds[at].astype(np.int64)[owner] << EVIDENCE_BITS) + slot, minlength=len(total))
        yield packed_rows(total.reshape(TURNS, -1))

    found = packed_sums(docs.where("class is not null and text is not null").select("text", "class").mapInArrow(count, PACKED), PACKED)
    n = np.stack([found.get(k, np.zeros(1 << EVIDENCE_BITS)) for k in range(TURNS)], axis=1).astype(np.float64)
    share = n.sum(axis=0) / max(1.0, n.sum())
    held = np.where(share > 0, np.log(np.maximum(share, 1e-300)), -1e9)
    told = np.log((n + 2 * share) / (n.sum(axis=1, keepdims=True) + 2) / np.maximum(share, 1e-300), where=share > 0, out=np.zeros_like(n))
    return np.vstack([told, held]).astype(np.float32)


FOUND = "block long, turn int, word binary, pair long, before long, n long, times long"


def block_words(docs: DataFrame, evidence: np.ndarray) -> DataFrame:
    """Each word and turn of a block, with how often training documents of it have it (``n``), and with turn 255 each segment
    by the words before it; from (block, text, class) rows, of which those without a class teach nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)  # 2 MB

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        sizes: Counter = Counter()

        def out(block: int) -> Iterator[pa.RecordBatch]:
            texts, learn = held.pop(block)
            del sizes[block]
            own, words, pairs = np.array(learn, np.int64), [], []
            for at in lots([len(t or "") for t in texts]):  # so that only a lot's tokens are held at once
                s = spoken(texts[at], shared.value)
                keys = s.keys()
                first, which = distinct(keys)
                words.append((keys[first], s.turns[first], np.bincount(which, own[at][s.owner], len(first)), word_bytes(s, first)))
                some = np.flatnonzero(s.before)
                pairs.append((s.pairs[some], s.before[some], own[at][s.owner[s.first[some]]]))
            keys, turns, n = (np.concatenate(x) for x in list(zip(*words, strict=True))[:3])
            first, which = distinct(keys)
            n = np.bincount(which, n, len(first)).astype(np.int64)
            spelled = pa.concat_arrays([w for *_, w in words]).take(pa.array(first))
            order = np.argsort(leading(spelled))  # neighbours share their beginning, which packs well
            for at in range(0, len(first), 50_000):
                some = order[at : at + 50_000]
                yield batch(block, turns[first[some]], spelled.take(pa.array(some)), None, None, n[some], None)
            keys, before, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if len(keys):
                first, which = distinct(keys)
                n, times = np.bincount(which, n, len(first)).astype(np.int64), np.bincount(which, minlength=len(first)).astype(np.int64)
                yield batch(block, np.full(len(first), 255), None, key_of(keys[first], np.full(len(first), _SEGMENT)), before[first], n, times)

        for b in batches:
            for block, text, kind in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                texts, learn = held.setdefault(block, ([], []))
                texts.append(text)
                learn.append(kind is not None)
                sizes[block] += len(text or "")
            for k in [*list(held)[:-1], *(k for k in list(held)[-1:] if sizes[k] > 2 * BLOCK_BYTES)]:
                yield from out(k)  # rows of a block come together
        for k in list(held):
            yield from out(k)

    def batch(block: int, turns: np.ndarray, words: pa.Array | None, pairs: np.ndarray | None, before: np.ndarray | None, n: np.ndarray, times: np.ndarray | None) -> pa.RecordBatch:
        k = len(n)
        longs = lambda x: pa.nulls(k, pa.int64()) if x is None else pa.array(x.view(np.int64))
        columns = [pa.array(np.full(k, block, np.int64)), pa.array(turns.astype(np.int32)), pa.nulls(k, pa.binary()) if words is None else words, longs(pairs), longs(before), longs(n), longs(times)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return docs.select("block", "text", "class").mapInArrow(rows, FOUND)


def word_bytes(s: Spoken, rows: np.ndarray) -> pa.Array:
    """The words with small letters; the end of a document is a line end, which no word holds."""
    starts, sizes = s.starts[rows], s.sizes[rows]
    begin = np.cumsum(sizes) - sizes
    data = s.data[np.repeat(starts - begin, sizes) + np.arange(sizes.sum())]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    whole = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.r_[begin, sizes.sum()].astype(np.int64)), pa.py_buffer(data)])
    ends = pa.array(s.ids[rows] == END)
    return pa.compute.if_else(ends, pa.scalar(b"\n", pa.large_binary()), whole).cast(pa.binary())


def leading(words: pa.Array) -> np.ndarray:
    """The first eight bytes of each word as one number, in the words' order."""
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    out = np.zeros(len(words), np.uint64)
    for k in range(8):
        at = bounds[:-1] + k
        there = at < bounds[1:]
        out = out << np.uint64(8) | np.where(there, data[np.where(there, at, 0)] if len(data) else 0, 0).astype(np.uint64)
    return out


def bit_tables(counted: DataFrame, bits: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones by slot over (word, turn, c) rows, added up in the executors."""
    size, chunks = len(ORDERS) << bits, 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size)
        for b in batches:
            words, turns, c = b.column(0).to_pylist(), np.asarray(b.column(1)), np.asarray(b.column(2)).astype(np.float64)
            for at in range(0, len(words), 10_000):
                flat = Flat.of(words[at : at + 10_000])
                owner = np.repeat(np.arange(len(flat.sizes)) + at, flat.sizes)
                bit, times = np.unpackbits(flat.data).astype(np.intp) * size, np.repeat(c[owner], 8)
                for slot in hashed_slots(flat.data, flat.places(), turns[owner], bits):
                    np.add.at(total, slot.ravel() + bit, times)
        yield packed_rows(total.reshape(2 * chunks, -1))

    found = packed_sums(counted.where("c > 0").select("word", "turn", "c").coalesce(tasks).mapInArrow(count, PACKED), PACKED)
    if not found:
        return np.zeros(size, np.float32), np.zeros(size, np.float32)
    whole = np.concatenate([found[k] for k in range(2 * chunks)]).reshape(2, -1)
    return whole[0], whole[1]


def range_borders(counted: DataFrame, rows: int, range_words: int = RANGE_WORDS) -> list[bytes]:
    """Words that cut the sorted vocabulary into ranges of about ``range_words`` rows, from a sample of some 64 a range."""
    ranges = -(-rows // range_words)
    if ranges < 2:
        return []
    thin = max(1, rows // (64 * ranges))
    sample = counted.where(F.pmod(F.xxhash64("word"), F.lit(thin)) == 0).select(F.substring("word", 1, DEPTH).alias("w")).distinct().collect()
    words = sorted((bytes(r["w"]) for r in sample), key=head)
    heads: dict[bytes, bytes] = {}
    for i in range(1, ranges):
        if words:
            heads.setdefault(head(w := words[i * len(words) // ranges]), w)
    return list(heads.values())


def border_sums(counted: DataFrame, borders: list[bytes]) -> list[np.ndarray]:
    """For each border, (turns + 1, bits + 1): how often words that have 0, 1, ... bits in common with it are in training
    documents, by turn and in all.  A range's words tell only of its own two borders; beginnings that borders share are
    summed up here."""
    heads = [head(w) for w in borders]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [int.from_bytes(h, "big") for h in heads]
        found: Counter = Counter()
        for b in batches:
            for w, turn, c in zip(b["word"].to_pylist(), b["turn"].to_pylist(), b["c"].to_pylist(), strict=True):
                h = head(w)
                at, n = bisect.bisect_right(heads, h), int.from_bytes(h, "big")
                for border in (at - 1, at):
                    if 0 <= border < len(heads):
                        found[at, border, DEPTH * 8 - (n ^ numbers[border]).bit_length(), turn] += c
        keys = list(zip(*found, strict=True)) if found else [[]] * 4
        yield pa.RecordBatch.from_pydict({x: pa.array(k, pa.int32()) for x, k in zip(("span", "border", "common", "turn"), keys, strict=True)} | {"c": pa.array(list(found.values()), pa.int64())})

    sums: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros((TURNS + 1, DEPTH * 8 + 2)))
    told = counted.where("c > 0").select("word", "turn", "c").mapInArrow(count, "span int, border int, common int, turn int, c long")
    for r in told.groupBy("span", "border", "common", "turn").agg(F.sum("c").alias("c")).collect():
        sums[r["span"], r["border"]][[r["turn"], TURNS], r["common"]] += r["c"]
    bits = [np.unpackbits(np.frombuffer(h, np.uint8)) for h in heads]
    ends = [min(DEPTH, len(w) + 1) * 8 for w in borders]
    beginning = lambda k, d: (d, int.from_bytes(heads[k], "big") >> DEPTH * 8 - d)
    total: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(TURNS + 1))
    for span in range(len(borders) + 1):
        low = -1  # bits that the two borders have in common are told by the first
        for border in (span - 1, span):
            if 0 <= border < len(borders):
                tail = np.cumsum(sums[span, border][:, ::-1], axis=1)[:, ::-1]
                if border == span and span > 0:
                    differ = np.flatnonzero(bits[span] != bits[span - 1])
                    low = int(differ[0]) if len(differ) else DEPTH * 8
                for d in range(low + 1, ends[border] + 1):
                    total[beginning(border, d)] += tail[:, d]
    return [np.stack([total[beginning(k, d)] for d in range(ends[k] + 1)], axis=1) for k in range(len(borders))]


def learning_order(words: list[bytes], c: np.ndarray) -> np.ndarray:
    """All rows with training tokens, by hash of the word, so that neighbours in the vocabulary don't follow each other."""
    mine = np.flatnonzero(c > 0)
    return mine[np.argsort(np.array([zlib.crc32(words[i]) for i in mine], np.uint32), kind="stable")]


def vocabulary_costs(counted: DataFrame, rows: int) -> DataFrame:
    """(hash, turn, key, c, cost, first) of each (word, turn, c) row: Spark's hash of the word, the key of the word and turn, the
    word's training count in all turns, its log10 probability in this turn, and whether the row is the word's first."""
    spark = counted.sparkSession
    low, high = BITS
    bits = min(high, max(low, (2 * rows).bit_length()))
    borders = range_borders(counted, rows)
    heads = [head(w) for w in borders]
    edges = spark.sparkContext.broadcast(list(zip(borders, border_sums(counted, borders), strict=True)))  # some hundred numbers a range
    mixer = Mixer.fresh(*bit_tables(counted, bits, max(6, rows // 500_000)), bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = pa.array([bisect.bisect_right(heads, head(w)) for w in b["word"].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([spans, *b.columns], ["span", "word", "turn", "c"])

    placed = counted.select("word", "turn", "c").mapInArrow(place, "span int, word binary, turn int, c long")
    hashed = placed.withColumn("hash", F.xxhash64("word"))

    def lot(g: pd.DataFrame) -> Lot:
        span = int(g["span"].iloc[0])
        return Lot(g["word"].tolist(), g["turn"].to_numpy(np.int64), g["c"].to_numpy(np.float64), [edges.value[k] for k in (span - 1, span) if 0 <= k < len(edges.value)])

    start = spark.sparkContext.broadcast(mixer)  # tables of a bounded size, 6 MB at most

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        told = lot(g).learn(start.value, learning_order(g["word"].tolist(), g["c"].to_numpy()), passes=1)
        return pd.DataFrame({"told": [np.concatenate([x.ravel() for x in told]).astype(np.float64).tobytes()]})

    weight, used, one, zero = 0.0, 0.0, 0.0, 0.0
    for r in placed.groupBy("span").applyInPandas(learn, "told binary").collect():  # some 20 KB a range
        w, u, o, z = np.split(np.frombuffer(r["told"]), np.cumsum([len(mixer.weights), len(mixer.weights), GATES * 33]))
        weight, used, one, zero = weight + w * u, used + u, one + o, zero + z
    steps = np.tile(1 / (1 + np.exp(-(np.arange(33) / 2 - 8))), (GATES, 1))
    mixer.weights = np.where(used > 0, weight / np.maximum(used, 1e-9), mixer.weights).astype(np.float32)
    some = 4.0
    mixer.refine = (np.reshape(one, (-1, 33)) + some * steps) / (np.reshape(one + zero, (-1, 33)) + some) if np.ndim(one) else mixer.refine
    ready = spark.sparkContext.broadcast(mixer)

    def cost(g: pd.DataFrame) -> pd.DataFrame:
        part = lot(g)
        words = [b"\n" if w == b"\n" else w for w in g["word"]]
        ids = np.array([END if w == b"\n" else 0 for w in words], np.uint64)
        plain = np.flatnonzero(ids == 0)
        ids[plain] = words_of(np.frombuffer(b"\n".join([*(words[i] for i in plain), b""]), np.uint8))[0]
        first = np.zeros(len(g), bool)
        first[np.unique(part.row, return_index=True)[1]] = True
        keys = key_of(ids, part.turns).view(np.int64)
        return pd.DataFrame({"hash": g["hash"].to_numpy(), "turn": part.turns, "key": keys, "c": part.all[part.row].astype(np.int64), "cost": part.costs(ready.value), "first": first})

    return hashed.groupBy("span").applyInPandas(cost, "hash long, turn int, key long, c long, cost double, first boolean")


def promised(found: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(pair, c, total) of segments whose words before occur more than once and in a training document: how often training
    documents have the segment there, and those words at all; and the share of such promises that were held, by how many
    other training documents made them."""
    rows = found.where("turn = 255").select("pair", "before", "n", "times")
    contexts = rows.groupBy("before").agg(F.sum("n").alias("total"), F.sum("times").alias("times")).where("times > 1 and total > 0").select("before", "total")
    pairs = written(rows.join(contexts, "before").groupBy("pair", "total").agg(F.sum("n").alias("c")), "segments")
    others = F.least(F.col("total") - 1, F.lit(16))
    told = pairs.where("c > 0 and total > 1").groupBy(others.alias("k")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("held"))
    share = np.full(17, 0.5)
    for r in told.collect():
        share[r["k"]] = (r["held"] + 0.5) / (r["n"] + 1)
    return pairs, np.clip(share, 0.001, 0.999)


def documents_scored(s: Spoken, learn: np.ndarray, cost: np.ndarray, total: np.ndarray, c: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 probability of each document, from its tokens' costs and, by segment, what training documents have (total 0:
    nothing is promised)."""
    docs = len(learn)
    if not len(s.first):
        return np.zeros(docs)
    plain = np.add.reduceat(cost, s.first)
    doc = s.owner[s.first]
    of = lambda x: np.unique(key_of(x, doc), return_inverse=True, return_counts=True)
    own = [(times[which] * learn[doc]) for _, which, times in (of(s.before), of(s.pairs))]
    n, m = total - own[0], c - own[1]  # a document's own segments don't count
    told = np.flatnonzero((total > 0) & (n > 0))
    held = (m[told] > 0).astype(np.float64)
    # the promises of the document so far, and how many were held
    lead = np.flatnonzero(np.r_[True, doc[told][1:] != doc[told][:-1]]) if len(told) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[lead, len(told)])
    before = np.arange(len(told)) - np.repeat(lead, runs)
    good = np.cumsum(held) - held
    good = good - np.repeat(good[lead], runs)
    p = (good + 4 * share[np.minimum(n[told], 16)]) / (before + 4)
    rest = np.log10(1 - p) + plain[told]
    hit = np.where(held > 0, np.log10(np.maximum(p * m[told] / n[told], 1e-300)), -np.inf)
    top = np.maximum(rest, hit)
    plain[told] = top + np.log10(np.power(10.0, rest - top) + np.power(10.0, hit - top))
    return np.bincount(doc, plain, docs)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def score_documents(docs: DataFrame, learn_from: Column, kind: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of each row.

    ``learn_from`` tells which rows the model learns from.  ``kind`` (such as their language) may sort those rows into
    classes; the classes of scored rows aren't looked at.

    Null texts are empty: one token, the end.  Without any row to learn from, counts are 0.  Repeated rows are scored each
    and learned from each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    learn = F.coalesce(learn_from, F.lit(False))
    kind = F.lit("") if kind is None else F.coalesce(kind.cast("string"), F.lit(""))
    number = F.pmod(F.xxhash64(kind), F.lit(TURNS)).cast("int")
    rows = in_blocks(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(learn, number).alias("class"), "block", (~learn).alias("held_out")
    )
    evidence = turn_evidence(rows)
    found = written(block_words(rows, evidence), "words")
    counted = written(found.where("turn < 255").groupBy("word", "turn").agg(F.sum("n").alias("c")), "counts")
    priced = written(vocabulary_costs(counted, counted.count()), "costs")
    sums = priced.where("first and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, known_words = sums["n"], sums["v"]
    pairs, share = promised(found)
    shared = spark.sparkContext.broadcast((evidence, share))

    def score(key: tuple, texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        evidence, share = shared.value
        known_keys = known["key"].to_numpy(np.int64).view(np.uint64)
        once = distinct(known_keys)[0]
        c, cost, places = *(known[x].to_numpy()[once] for x in ("c", "cost")), pd.Index(known_keys[once])
        out = []
        sizes = texts["text"].str.len().fillna(0).to_numpy(np.int64)
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 21))) + 1):
            part = texts.iloc[at]
            s, held = spoken(part["text"].tolist(), evidence), part["held_out"].to_numpy(bool)
            place = places.get_indexer(s.keys())
            if (place < 0).any():
                raise ValueError("a word of the block has no cost")
            n, times = np.bincount(s.owner, minlength=len(at)), c[place]
            base = np.bincount(s.owner, np.log10((times + 1.0) / (tokens + known_words + 1)), len(at))
            pair_keys = key_of(s.pairs, np.full(len(s.pairs), _SEGMENT))
            pair = places.get_indexer(pair_keys)
            there = (pair >= 0) & (s.before > 0)
            total = np.where(there, cost[pair], 0).astype(np.int64)
            points = documents_scored(s, (~held).astype(np.int64), cost[place], total, np.where(there, c[pair], 0), share)
            known_n = np.bincount(s.owner, times > 0, len(at)).astype(np.int64)
            out.append(pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "held_out": held, "n_tokens": n, "n_known": known_n, "train_tokens": tokens, "base_score": base, "score": points, "n_bytes": s.docs}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORED.split(", ")])

    words = found.where("turn < 255").select("block", F.xxhash64("word").alias("hash"), "turn").join(priced.select("hash", "turn", "key", "c", "cost"), ["hash", "turn"])
    kept = found.where("turn = 255").select("block", "pair").join(pairs, "pair")  # a segment has its words' total in the costs' place
    back = words.select("block", "key", "c", "cost").union(kept.select("block", F.col("pair").alias("key"), "c", F.col("total").cast("double")))
    scored = rows.select("doc_id", "text", "block", "held_out").groupBy("block").cogroup(back.groupBy("block")).applyInPandas(score, SCORED)
    bits = -F.col("score") / F.lit(float(np.log10(2)))
    return scored.withColumn("bits_per_byte", bits / F.greatest(F.col("n_bytes"), F.lit(1)))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, remainder(F.col("doc_id"), 7) != 2, F.col("lang"))
