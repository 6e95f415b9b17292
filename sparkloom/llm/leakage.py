"""Held-out passages inside training text, by an FM-index of each shard of the corpus.

A shard is a bounded stretch of a partition's documents as a sequence of word numbers; words that no held-out item has share
one number, and runs of them shrink to one symbol. Its index is the Burrows-Wheeler transform as a wavelet matrix, with
every 16th suffix position. The items' phrases are a table made by executors, and are searched in passes of a bounded number
of them, backwards and all at once: one rank query for each end of each phrase's interval and word, for the phrases whose
words the shard has. Rows of non-empty intervals walk to the next sampled position, which gives document and place; hits of
one document and item merge into spans of characters. Documents never leave their partition. With more than one pass the
indexes are written once, and every pass reads them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir

WORD = re.compile(r"[^\W_]+")
PHRASE_WORDS = 12
SHARD_SYMBOLS = 1 << 18
SAMPLE = 16
#: Phrases of items searched in one pass (about 100 bytes each): what is sent to all executors at once.
PASS_PHRASES = 1 << 18
#: Bits of the fixed-size filter (2 MB) of the items' words. A word that passes it by chance only has a number of its own.
FILTER_BITS = 1 << 24
#: Different words whose numbers a task keeps at hand.
KNOWN_WORDS = 1 << 20
END, OTHER = 0, 1
#: Columns of a written index, one row for each shard.
INDEX = ["keys", "texts", "offsets", "vocabulary", "places", "bwt", "marked", "samples"]


class WaveletMatrix:
    """Rank of any symbol at any place of a sequence, for arrays of both."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels, seq = [], sequence
        for shift in range(bits - 1, -1, -1):
            ones = (seq >> shift) & 1
            before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((shift, before, len(seq) - int(before[-1])))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.zeros(len(at), np.int64)
        for shift, before, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            at = np.where(one, zeros + before[at], at - before[at])
        return at - low


class FMIndex:
    """Backward search and locating in one sequence of symbols, which ends with the only END."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        suffixes = suffix_array(sequence)
        sampled = suffixes % SAMPLE == 0
        self._build(sequence[suffixes - 1], symbols, sampled, suffixes[sampled])

    def _build(self, bwt: np.ndarray, symbols: int, sampled: np.ndarray, samples: np.ndarray) -> None:
        self.bwt, self.sampled, self.before, self.samples = bwt, sampled, np.cumsum(sampled) - 1, samples
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=symbols))])
        self.wavelet = WaveletMatrix(bwt, max(1, int(symbols - 1).bit_length()))

    @classmethod
    def of(cls, bwt: np.ndarray, symbols: int, marked: np.ndarray, samples: np.ndarray) -> FMIndex:
        """An index from its transform, and the rows and positions of its samples: nothing is sorted again."""
        one, sampled = cls.__new__(cls), np.zeros(len(bwt), bool)
        sampled[marked] = True
        one._build(bwt, symbols, sampled, samples)
        return one

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one row of the suffixes that start with each phrase (rows of symbols, padded at the end)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.sampled[at[todo]]
            done = todo[there]
            out[done] = self.samples[self.before[at[done]]] + steps[done]
            todo = todo[~there]
            symbol = self.bwt[at[todo]]
            at[todo] = self.first[symbol] + self.wavelet.rank(symbol, at[todo])
            steps[todo] += 1
        return out


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the compared length until all differ."""
    n, rank, step = len(sequence), sequence.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        both = rank * (int(rank.max()) + 2) + second
        order = np.argsort(both, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


def word_number(word: str) -> int:
    """A number for a word in lower case, other than END and OTHER."""
    return max(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1, 2)


def phrases(items: DataFrame, words: int) -> DataFrame:
    """(item, phrase, size): the stretches of `words` words of each of the items (item, text), or all its words if it has
    fewer, as their numbers laid end to end. An item without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in enumerate(b.column(1).to_pylist()):
                seq = np.array([word_number(w.lower()) for w in WORD.findall(text)], np.int64)
                size = min(words, len(seq))
                if size:
                    rows = np.lib.stride_tricks.sliding_window_view(seq, size)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(rows), at))), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.full(len(rows), size), pa.int32())], ["item", "phrase", "size"])

    found = items.where(F.length("text") > 0).select("item", "text")
    return found.mapInArrow(run, f"item {dict(items.dtypes)['item']}, phrase binary, size int").distinct()


def word_filter(table: DataFrame) -> np.ndarray:
    """Bits of the words in a table of phrases, of a fixed size: made by aggregates, at most 512 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64) % FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64())], ["bit"])

    # The functions count from 1.
    bit = table.select("phrase").mapInArrow(run, "bit bigint").select((F.col("bit") + 1).alias("bit"))
    rows = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out.ravel()


class Shard:
    """Documents being gathered, or stretches of long ones: their keys, texts and first character; word numbers, and the row
    and the word that each stands for."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, key, text: str, offset: int, symbols: np.ndarray) -> None:
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != OTHER) | (symbols[:-1] != OTHER)
        self.symbols.append(np.append(symbols[keep], OTHER))
        words = np.append(np.flatnonzero(keep), -1)
        self.places.append(np.column_stack([np.full(len(words), len(self.rows)), words]).astype(np.int32))
        self.rows.append((key, text, offset))
        self.size += len(words)

    def index(self) -> tuple[list, np.ndarray, np.ndarray, FMIndex]:
        """The rows, the word numbers in order (END and OTHER first), the places, and the index over the numbers' ranks."""
        whole = np.concatenate(self.symbols)
        vocabulary = np.unique(np.concatenate([whole, [END, OTHER]]))
        return self.rows, vocabulary, np.concatenate(self.places), FMIndex(np.append(np.searchsorted(vocabulary, whole), END), len(vocabulary))


def shards(batches: Iterator[pa.RecordBatch], bits: np.ndarray, words: int, most: int) -> Iterator[tuple]:
    """(rows, vocabulary, places, index) of each shard of the documents (key, text)."""
    known: dict[str, int] = {}

    def number(word: str) -> int:
        n = word_number(word.lower())
        bit = n % FILTER_BITS
        n = n if bits[bit >> 3] >> (bit & 7) & 1 else OTHER
        if len(known) >= KNOWN_WORDS:
            known.clear()
        known[word] = n
        return n

    shard = Shard()
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            symbols = np.array([known.get(w) or number(w) for w in WORD.findall(text)], np.int64)
            # A long document goes to several shards, which share what a phrase across the cut needs.
            at = [m.span() for m in WORD.finditer(text)] if len(symbols) > most else []
            for first in range(0, len(symbols), most):
                start, stop = max(0, first - words + 1), min(first + most, len(symbols))
                offset, end = (at[start][0], at[stop - 1][1]) if at else (0, len(text))
                shard.add(key, text[offset:end], offset, symbols[start:stop])
                if shard.size >= most:
                    yield shard.index()
                    shard = Shard()
    if shard.size:
        yield shard.index()


class Pass:
    """The phrases of one pass: word numbers by row, their sizes, and the items that each gives away."""

    def __init__(self, block: pa.Table, words: int):
        coded = block["phrase"].combine_chunks().dictionary_encode()
        texts = coded.dictionary.to_pylist()
        self.sizes = np.array([len(t) // 8 for t in texts], np.int64)
        self.phrases = np.zeros((len(texts), words), np.int64)
        for i, t in enumerate(texts):
            self.phrases[i, : self.sizes[i]] = np.frombuffer(t, np.int64)
        of = np.asarray(coded.indices)
        order = np.argsort(of, kind="stable")
        coded = block["item"].combine_chunks().dictionary_encode()
        self.items, self.of = coded.dictionary, np.asarray(coded.indices)[order]
        self.begin = np.searchsorted(of[order], np.arange(len(texts) + 1))

    def spans(self, rows: list[tuple], vocabulary: np.ndarray, places: np.ndarray, index: FMIndex, key_kind: pa.DataType) -> pa.RecordBatch:
        """(key, item, start, stop): the characters of the shard's documents where an item's phrases stand, overlapping ones
        of a document and item as one."""
        live, numbers = np.arange(len(self.sizes)), np.zeros_like(self.phrases)
        for back in range(1, self.phrases.shape[1] + 1):
            # Phrases with a word that the shard lacks are left out, word by word from the last.
            there = self.sizes[live] >= back
            at = np.maximum(self.sizes[live] - back, 0)
            word = self.phrases[live, at]
            rank = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            numbers[live[there], at[there]] = rank[there]
            live = live[~there | (vocabulary[rank] == word)]
        low, high = index.search(numbers[live], self.sizes[live])
        size = high - low
        found = np.repeat(high - np.cumsum(size), size) + np.arange(int(size.sum()))
        where, phrase = places[index.locate(found)], np.repeat(live, size)
        owners = self.begin[phrase + 1] - self.begin[phrase]
        item = self.of[np.repeat(self.begin[phrase + 1] - np.cumsum(owners), owners) + np.arange(int(owners.sum()))]
        first = np.repeat(where[:, 1], owners).astype(np.int64)
        hits = np.column_stack([np.repeat(where[:, 0], owners), item, first, first + np.repeat(self.sizes[phrase], owners)])
        out, at, of = [], [], -1
        for row, i, a, b in hits[np.lexsort(hits.T[::-1])].tolist():
            if row != of:
                of, at = row, [m.span() for m in WORD.finditer(rows[row][1])]
            key, _, offset = rows[row]
            start, stop = offset + at[a][0], offset + at[b - 1][1]
            if out and out[-1][:2] == [row, i] and a <= out[-1][2]:
                out[-1][2], out[-1][5] = max(b, out[-1][2]), max(stop, out[-1][5])
            else:
                out.append([row, i, b, key, start, stop])
        column = lambda k, kind: pa.array([x[k] for x in out], kind)
        return pa.RecordBatch.from_arrays([column(3, key_kind), self.items.take(column(1, pa.int64())), column(4, pa.int32()), column(5, pa.int32())], ["key", "item", "start", "stop"])


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, words: int = PHRASE_WORDS, shard: int = SHARD_SYMBOLS, pass_phrases: int = PASS_PHRASES) -> DataFrame:
    """(key, item, start, stop): the spans of characters of each document that give away each item.

    A document gives an item away if it holds `words` consecutive words of it (all, if it has fewer), in order and with nothing
    but other characters between. Words are runs of letters and digits, compared in lower case. Overlapping hits of one
    document and item are one span; rows of the same key count as one document. Null and empty texts hold nothing; items
    without words are given away by nothing. Each pass sends at most about pass_phrases phrases to all executors.
    """
    base = shared_dir(documents.sparkSession)
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    out_schema = f"key {kinds[0]}, item {kinds[1]}, start int, stop int"
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    wanted = phrases(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")), words)
    wanted, seen = materialize(wanted, f"{base}/phrases", n=F.count("*"))
    if not seen["n"]:
        return source.select(F.col("key").alias(key), F.lit(None).cast(kinds[1]).alias(item_key), F.lit(0).alias("start"), F.lit(0).alias("stop")).where("false")
    bits, passes = word_filter(wanted), -(-seen["n"] // pass_phrases)
    block_of = F.pmod(F.xxhash64("item", "phrase"), F.lit(passes))

    def searched(block: Pass):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for head in batches:
                kind = head.schema.field(0).type
                yield from (block.spans(*one, kind) for one in shards(chain([head], batches), bits, words, shard))

        return run

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        for head in batches:
            for rows, vocabulary, places, index in shards(chain([head], batches), bits, words, shard):
                parts = [*zip(*rows, strict=True)]
                numbers = [column(x, pa.int32()) for x in (places.ravel(), index.bwt, np.flatnonzero(index.sampled), index.samples)]
                yield pa.RecordBatch.from_arrays([column(parts[0], head.schema.field(0).type), column(parts[1], pa.string()), column(parts[2], pa.int32()), column(vocabulary, pa.int64()), *numbers], INDEX)

    def again(block: Pass):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    part = lambda name, i=i, b=b: b.column(name)[i].values
                    vocabulary, places, bwt, marked, samples = (part(c).to_numpy().astype(np.int64) for c in INDEX[3:])
                    rows = [*zip(*(part(c).to_pylist() for c in INDEX[:3]), strict=True)]
                    yield block.spans(rows, vocabulary, places.reshape(-1, 2), FMIndex.of(bwt, len(vocabulary), marked, samples), part("keys").type)

        return run

    if passes == 1:
        found = source.mapInArrow(searched(Pass(wanted.select("item", "phrase").toArrow(), words)), out_schema)
    else:
        index, _ = materialize(source.mapInArrow(indexed, f"keys array<{kinds[0]}>, texts array<string>, offsets array<int>, vocabulary array<bigint>, places array<int>, bwt array<int>, marked array<int>, samples array<int>"), f"{base}/index")
        for k in range(passes):
            block = Pass(wanted.where(block_of == k).select("item", "phrase").toArrow(), words)
            if len(block.sizes):
                index.mapInArrow(again(block), out_schema).write.parquet(f"{base}/hits/pass={k}")
        found = documents.sparkSession.read.schema(out_schema).parquet(f"{base}/hits/pass=*")
    return found.groupBy("key", "item").agg(F.collect_set(F.struct("start", "stop")).alias("pieces")).select(F.col("key").alias(key), F.col("item").alias(item_key), F.inline(_merged()))


def _merged():
    """The spans of the column pieces in order, overlapping and touching ones as one."""
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.array_sort("pieces"),
        F.expr("CAST(array() AS array<struct<start:int,stop:int>>)"),
        lambda acc, p: F.when(F.size(acc) == 0, F.array(p))
        .when(
            p["start"] <= last(acc)["stop"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], p["stop"]).alias("stop")))),
        )
        .otherwise(F.concat(acc, F.array(p))),
    )


def leaked_items(spans: DataFrame, key: str, item_key: str) -> DataFrame:
    """(key, item): which documents give away which items."""
    return spans.select(key, item_key).distinct()


def removal_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, stop): what to cut from each document, overlapping spans of different items merged."""
    return spans.groupBy(key).agg(F.collect_set(F.struct("start", "stop")).alias("pieces")).select(key, F.inline(_merged()))
