"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every passage of every document is a query. What scores above the threshold is verified by the overlap of the
item's question and of its answer with the passage.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, parts, table

TOKEN = re.compile(r"\w+")
K1, B = 1.2, 0.75


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def question_and_answer(text: str | None, least: int = 3) -> tuple[list[str], list[str]]:
    """The answer is the last sentence, or as many last sentences as hold ``least`` words; the question stands before.

    Where that leaves no question, the last third of the words is the answer.
    """
    parts = [p for p in map(tokens, re.split(r"(?<=[.?!])\s+|\n+", text or "")) if p]
    words, answer = [w for p in parts for w in p], 0
    while parts and answer < least:
        answer += len(parts.pop())
    cut = len(words) - (answer if answer < len(words) else max(1, len(words) // 3))
    return words[: max(0, cut)], words[max(0, cut) :]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def share(part: list[str], passage: list[str], n: int = 3, short: int = 6) -> float:
    """The share of part's word n-grams that the passage holds; of a part with fewer than ``short`` words, the share of its words."""
    n = n if len(part) >= short else 1
    own = grams(part, n)
    return len(own & grams(passage, n)) / len(own) if own else 1.0


class Lookup(dict):
    """The term numbers of the words within a run of characters without white space (-1: not in any item), remembered."""

    def __init__(self, terms: dict[str, int], most: int = 300_000):
        super().__init__()
        self.terms, self.room = terms, most

    def __missing__(self, run: str) -> tuple[int, ...]:
        found = tuple(self.terms.get(w, -1) for w in tokens(run))
        if len(self) < self.room:
            self[run] = found
        return found


class Statistics:
    """What BM25 knows of all items of the benchmark, however they are dealt to shards: their number, mean length, and in how many each word stands."""

    def __init__(self, n: int, mean: float, df: dict[str, int]):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, items: list[list[str]]) -> Statistics:
        df: Counter = Counter()
        for words in items:
            df.update(set(words))
        return cls(len(items), sum(map(len, items)) / max(1, len(items)), df)


class Index:
    """Postings of the items of one length class, with impacts as shares of the score that the item's own text gets.

    So one threshold between 0 and 1 serves items of any length. Postings are sorted by item; blocks of ``block`` items
    keep their largest impact. Of each item, the rarest words that make up more than 1 - ``rest`` of its score are its
    essential ones: a passage that reaches the threshold holds essential words for at least the threshold less the rest.
    """

    def __init__(self, items: list[tuple[int, list[str], list[str]]], terms: dict[str, int], stats: Statistics, threshold: float, half: int, block: int = 8, rest: float = 0.35):
        self.items, self.threshold, self.half, self.block, self.width = items, threshold, half, block, len(terms)
        self.postings: dict[int, tuple[array, array]] = {}
        essential: dict[int, list[tuple[int, float]]] = {}
        self.need = np.zeros(len(items))
        for item, (_, q, a) in enumerate(items):
            c, length = Counter(q + a), len(q) + len(a)
            raw = {w: math.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / stats.mean)) for w, f in c.items()}
            own, left = sum(raw.values()), 1.0
            for w in sorted(raw, key=lambda w: (stats.df[w], -raw[w], w)):
                x, t = raw[w] / own, terms[w]
                at, impact = self.postings.setdefault(t, (array("i"), array("d")))
                at.append(item)
                impact.append(x)
                if left > min(rest, threshold / 2):
                    essential.setdefault(t, []).append((item, x))
                    left -= x
            self.need[item] = threshold - left - 1e-9
        self.most = {t: max(x) for t, (_, x) in self.postings.items()}
        self.block_most: dict[int, dict[int, float]] = {}
        for t, (at, impact) in self.postings.items():
            best = self.block_most.setdefault(t, {})
            for item, x in zip(at, impact, strict=True):
                best[item // block] = max(best.get(item // block, 0.0), x)
        counts = np.zeros(self.width, np.int64)
        counts[[*essential]] = [*map(len, essential.values())]
        self.count, self.offset = counts, np.cumsum(counts) - counts
        self.essential = np.append(counts > 0, False)  # the last is for words of no item (-1)
        flat = [p for t in sorted(essential) for p in essential[t]]
        self.flat_item, self.flat_share = np.array([i for i, _ in flat], np.int64), np.array([x for _, x in flat])

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least the threshold, by block-max WAND.

        Cursors are kept in the order of their items. The pivot is the first item at which the terms' largest impacts
        reach the threshold; nothing before it can. If the largest impacts of the pivot's block can't reach it either,
        the cursors go on to the next block; else the item is scored.
        """
        limit, found = self.threshold - 1e-9, []
        # item, place, items, impacts, largest impact, blocks
        cursors = [[self.postings[t][0][0], 0, *self.postings[t], self.most[t], self.block_most[t]] for t in query if t in self.postings]

        def forward(c: list, item: int) -> bool:
            c[1] = bisect_left(c[2], item, c[1])
            if c[1] < len(c[2]):
                c[0] = c[2][c[1]]
                return True
            return False

        while cursors:
            cursors.sort(key=itemgetter(0))
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[4]
                if total >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            front, at = cursors[: pivot + 1], item // self.block
            if sum(c[5].get(at, 0.0) for c in front) < limit:
                after = (at + 1) * self.block
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                moved, after = front, max(after, item + 1)
            else:
                moved, after = [c for c in front if c[0] < item], item
                if not moved:
                    score = sum(c[3][c[1]] for c in front)
                    if score >= limit:
                        found.append((item, score))
                    moved, after = front, item + 1
            gone = {id(c) for c in moved if not forward(c, after)}
            if gone:
                cursors = [c for c in cursors if id(c) not in gone]
        return found

    def passages(self, every: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, list[int]]]:
        """(half, distinct terms) of the passages whose essential words can reach the threshold for some item.

        ``every``: a text's term numbers. Passages are two halves long and start every half, so a copy of an item, which is
        a half long at most, lies whole within one of them. Halves are taken together up to ``most`` postings.
        """
        place = np.flatnonzero(self.essential[every])
        if not len(place):
            return
        part, term = np.divmod(np.unique(place // self.half * self.width + every[place]), self.width)
        pairs, items = np.cumsum(self.count[term]), len(self.items)
        starts, lo = np.searchsorted(part, np.arange(part[-1] + 3)), 0
        last, final = int(part[-1]), max(0, -(-len(every) // self.half) - 2)
        while lo <= last:
            base = pairs[starts[lo] - 1] if starts[lo] else 0
            hi = max(lo + 1, int(part[min(len(part) - 1, np.searchsorted(pairs, base + most))]))
            hi = last if hi >= last - 1 else hi
            a, b = starts[lo], starts[hi + 1]  # the halves lo to hi, of which the last begins the next turn, too
            n = self.count[term[a:b]]
            flat = np.arange(n.sum()) + np.repeat(self.offset[term[a:b]] - np.cumsum(n) + n, n)
            key, weight, size = np.repeat(part[a:b] - lo, n) * items + self.flat_item[flat], self.flat_share[flat], (hi - lo + 1) * items
            if size <= 8 * len(key) + 4_096:  # few items: sums of halves in a table, else in a sorted list
                sums = np.bincount(key, weight, size).reshape(-1, items)
                sums[:-1] += sums[1:]
                found = np.flatnonzero((sums >= self.need).any(axis=1))
            else:
                pair, inverse = np.unique(np.concatenate([key, key - items]), return_inverse=True)
                reach = np.bincount(inverse, np.tile(weight, 2)) >= self.need[pair % items]
                found = np.unique(pair[reach] // items)
            for k in (found + lo).tolist():
                if (lo <= k < hi or k == hi == last) and k <= final:
                    query = np.unique(every[k * self.half : (k + 2) * self.half])
                    yield k, query[query >= 0].tolist()
            if hi >= last:
                break
            lo = hi


class Shard:
    """The items of one part of the benchmark, in an index for each class of lengths (16 words, 32, 64 and so on at most)."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.6, stats: Statistics | None = None, block: int = 8):
        parts_ = [(i, *question_and_answer(text)) for i, text in items]
        stats = stats or Statistics.of([q + a for _, q, a in parts_])
        terms = {w: k for k, w in enumerate(sorted({w for _, q, a in parts_ for w in q + a}))}
        classes: dict[int, list] = {}
        for x in parts_:
            if n := len(x[1]) + len(x[2]):
                classes.setdefault(16 << max(0, (n - 1).bit_length() - 4), []).append(x)
        self.indexes = [Index(x, terms, stats, threshold, half, block) for half, x in sorted(classes.items())]
        self.lookup = Lookup(terms)

    def matches(self, text: str | None, overlap: float) -> Iterator[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap): the best passage for each item that is verified."""
        every = np.array([*chain.from_iterable(map(self.lookup.__getitem__, (text or "").split()))], np.int64)
        words: list[str] = []
        for index in self.indexes:
            best: dict[int, tuple[float, float, float]] = {}
            for k, query in index.passages(every):
                for item, score in index.search(query):
                    words = words or tokens(text)
                    passage = words[max(0, k * index.half) : (k + 2) * index.half]
                    in_q, in_a = (share(x, passage) for x in index.items[item][1:])
                    if in_q >= overlap and in_a >= overlap and (item not in best or (score, in_q, in_a) > best[item]):
                        best[item] = (score, in_q, in_a)
            for item, found in sorted(best.items()):
                yield index.items[item][0], *found


def shards_of(items: DataFrame, item_id_col: str, item_text_col: str, threshold: float, shard_items: int) -> Iterator[Shard]:
    """The shards of a benchmark, one after the other; the statistics of words are those of all items."""
    words = items.select(F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").rlike(r"(?U)\w"))
    shards = max(1, math.ceil(words.count() / shard_items))
    placed = words.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [tokens(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*map(len, found)], pa.int64()), pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))], ["shard", "n", "words"])

    if shards > 1:
        counted = checkpoint(placed.select("shard", "text").mapInArrow(split, "shard long, n long, words array<string>"))
        n, mean = counted.agg(F.count("*"), F.avg("n")).first()
        each = counted.select("shard", F.explode("words").alias("word"))
        df = checkpoint(each.groupBy("word").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards")))
    for shard in range(shards):
        rows = sorted((r.item if r.item is not None else -1, r.text) for r in placed.where(F.col("shard") == shard).collect())
        stats = Statistics(n, mean, {r.word: r.df for r in df.where(F.array_contains("shards", shard)).select("word", "df").collect()}) if shards > 1 else None
        yield Shard(rows, threshold, stats)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.6,
    overlap: float = 0.5,
    shard_items: int = 100_000,
) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) for each item found in a document.

    ``threshold``: the least share of the item's own BM25 score that a passage must reach. ``overlap``: the least share
    of the word trigrams of the question, and of the answer, that the passage must hold (of words, where there are fewer than
    six). Case and punctuation are ignored. Items without words (null, empty) match nothing; null and empty texts hold
    nothing; items with a null id are shown as -1. Repeated items and documents are matched row by row; of passages that
    score the same for one item, that with the larger overlaps is shown. Extra columns are not read; an empty table on
    either side gives no rows. Texts of any length are searched whole, in turns of bounded memory.

    The index is split into shards of at most ``shard_items`` items (about 100 MB), each broadcast by itself and searched in
    a pass of its own, so that no task holds more than that whatever the benchmark's size. Scores don't depend on the split.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for shard in shards_of(items, item_id_col, item_text_col, threshold, shard_items):
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                found = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for m in sent.value.matches(t, overlap)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], ["id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, "id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.5, shard_items: int = 100_000) -> DataFrame:
    """docs without the rows that hold an item; all columns stay.

    Every row is judged by its own text where it stands, so nothing is joined or shuffled, and repeated and null ids matter to no
    other row. All shards are searched in one pass.
    """
    at, out = docs.columns.index(text_col), docs
    for shard in shards_of(items, item_id_col, item_text_col, threshold, shard_items):
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                yield b.filter(pa.array([next(sent.value.matches(t, overlap), None) is None for t in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
