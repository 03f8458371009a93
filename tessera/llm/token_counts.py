"""Operator 13: token counts by byte-pair merging with a heap and a linked list.

A piece of text starts as a linked list of symbols, one a byte.  All adjacent pairs that the vocabulary can merge lie in a
heap by rank and place; the lowest is popped, merged in the list, and its new neighbours are pushed.  A popped pair that
has gone meanwhile is passed over.  The count is the number of first symbols less the merges: no identifiers are made, and
a piece of n bytes takes n log n steps, however long it is.

Texts are counted where they lie, with no shuffle.  Words, the runs between blanks, can't merge with each other, so each
worker remembers the counts of the words it has met (``REMEMBERED`` of them at most; it only saves repeats).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held, read

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
REMEMBERED = 1_000_000
PLACE = (1 << 32) - 1
WORD = re.compile(r"[^ \t-\r]+")
#: The vocabulary's own pieces where all characters of a word are visible ASCII (lower-cased), each its own byte symbol.
PLAIN = re.compile(r"[!-~]+")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordCounts(dict):
    """Token counts by word, found on the first look at a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.vocab, self.suffix = vocab, model["model"]["end_of_word_suffix"] or ""
        #: (left, right) as one number: the rank, above 32 bits for a place; and by rank the symbol that the pair becomes
        self.rank = {vocab[a] << 17 | vocab[b]: r << 32 for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.whole = [vocab[a + b] for a, b in pairs]
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        library = Tokenizer.from_file(path)
        self.normal, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def __missing__(self, word: str) -> int:
        parts = self.special.split(word) if self.special else [word]
        n = len(parts) // 2  # the odd ones are special tokens
        for part in parts[::2]:
            if part:
                pieces = PLAIN_PIECES.findall(part.lower()) if PLAIN.fullmatch(part) else [p for p, _ in self.pieces(self.normal(part))]
                for p in pieces:
                    n += self.merged(self.symbols(p))
        if len(word) <= 64:
            self[word] = n
        return n

    def symbols(self, piece: str) -> list[int]:
        """A piece's bytes as symbols, the last with the mark of a word's end; what isn't in the vocabulary is left out."""
        named = [*piece[:-1], piece[-1] + self.suffix]
        return [self.vocab[x] for x in named if x in self.vocab]

    def merged(self, symbols: list[int]) -> int:
        """How many symbols are left when no adjacent pair can merge any more; ``symbols`` is used up."""
        n = len(symbols)
        rank, whole = self.rank, self.whole
        pairs = [a << 17 | b for a, b in pairwise(symbols)]
        heap = [rank[p] + i for i, p in enumerate(pairs) if p in rank]  # a rank and a place in one number
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            least = heappop(heap)
            i = least & PLACE
            j = after[i]
            if symbols[i] < 0 or j >= n or rank.get(symbols[i] << 17 | symbols[j], -1) + i != least:
                continue  # a symbol of the pair has gone into another since
            symbols[i] = one = whole[least >> 32]
            symbols[j] = -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (new := one << 17 | symbols[k]) in rank:
                    heappush(heap, rank[new] + i)
            h = before[i]
            if h >= 0 and (new := symbols[h] << 17 | one) in rank:
                heappush(heap, rank[new] + h)
        return n - merges

    def of(self, text: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, WORD.findall(text)))


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """The number of tokens of ``text``, null for null; ``vocabulary``: the file, ``VOCABULARY`` of the public ones if None."""

    def counts() -> WordCounts:
        import public_tokenizers

        return WordCounts(vocabulary or public_tokenizers.path(VOCABULARY))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = held(f"word counts {vocabulary}", counts).of
        for texts in batches:
            yield pd.Series([None if t is None else of(t) for t in texts], dtype="Int64")

    return F.pandas_udf(count, "long")(text)


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row a document.

    Null texts are empty, with no bytes and no tokens; texts of any length are counted whole; repeated rows have a row each;
    an empty table gives no rows; null ids stay null; other columns are left out, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
