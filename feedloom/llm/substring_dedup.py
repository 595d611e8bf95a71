"""Substring deduplication by repeated-phrase automata.

Recurring passages are confirmed over the whole corpus by counting hashes, which keeps one copy of each distinct passage.
These are compiled into Aho-Corasick automata, sharded by passage, and every document streams its stretches that hold an
anchor of a passage through the automata of these passages, which locate every occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, parts, salted_join, table

#: Words of an anchor; the anchor of a window is the one with the smallest hash among those in it.
ANCHOR = 16
#: Words of passages in one automaton, on average.
SHARD_WORDS = 200_000
#: Words of a block that owns the anchors in it.
OWNER_WORDS = 2_048
#: Stretches of one shard that one task streams, on average, where a shard has more.
SLICE_ROWS = 20_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 modulo 2^64, and their inverses."""
    while len(_powers[0]) < n:
        for k, by in enumerate((BASE, INVERSE)):
            old = _powers[k]
            _powers[k] = np.concatenate((old, old * np.uint64(pow(by, len(old), 1 << 64))))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """The word hashes of one text, summed up so that any word sequence has its hash in one step."""

    def __init__(self, words: list[bytes], window: int):
        n = len(words)
        self.window, self.count = window, max(0, n - window + 1)
        by, self.back = powers(n + 1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * by[:n])))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of consecutive windows with the same anchor: first window, number of windows, hash of the anchor, hash of all words that the windows cover."""
        size = min(ANCHOR, self.window)
        at = np.arange(len(self.sums) - size)
        anchors = self.of(at, at + size)
        own = sliding_window_view(anchors, self.window - size + 1).argmin(axis=1) + np.arange(self.count)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
        ends = np.append(starts[1:], self.count)
        return starts, ends - starts, anchors[own[starts]].view(np.int64), self.of(starts, ends + self.window - 1).view(np.int64)


def confirmed_passages(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct passages of which every window also starts anywhere else, and the stretches of all documents that can hold one.

    ``docs`` has (id, key, text). Passages are (id, key, at, n, owner): the place of one copy, first window and number of
    windows. Stretches are the same for every document. A window recurs only where its anchor does, and content decides
    on the anchor, so first the anchors are counted, about one for every ten words. A run of windows whose anchor recurs
    is a passage if it recurs as a whole; only where runs with one anchor differ (at the ends of what documents share) are
    single windows counted, one of each distinct run. Of those that recur, neighbours that stand in the same distinct runs
    form a passage, as whatever holds one of them holds them all. Whatever holds a passage
    holds its anchor, and an anchor is owned by the block of OWNER_WORDS words with the smallest hash among those it stands
    in, so what documents share with a block has one owner. Every count is combined before its shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            pieces_ = []
            for k, text in enumerate(b.column(2).to_pylist()):
                words = (text or b"").split()
                if len(words) >= window:
                    pieces_.append((k, *Hashed(words, window).pieces()))
            row = np.repeat([p[0] for p in pieces_], [len(p[1]) for p in pieces_]).astype(np.int64)
            columns = [np.concatenate([p[j] for p in pieces_]) if pieces_ else np.zeros(0, np.int64) for j in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *(pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int64, np.int64), strict=True))],
                ["id", "key", "at", "n", "anchor", "run"],
            )

    rows = docs.select("id", "key", F.col("text").cast("binary").alias("text")).mapInArrow(cut, "id long, key long, at int, n int, anchor long, run long")
    block = F.xxhash64("id", "key", F.floor(F.col("at") / OWNER_WORDS))
    again = materialise(rows.groupBy("anchor").agg(F.count("*").alias("of_anchor"), F.min(block).alias("owner")).where("of_anchor > 1"))
    rows = materialise(salted_join(rows, again, ["anchor"], "of_anchor").drop("of_anchor"))
    one = F.min(F.struct(F.xxhash64("id", "key", "at").alias("tag"), "id", "key", "at", "n", "owner")).alias("one")
    runs = materialise(rows.groupBy("anchor", "run").agg(F.count("*").alias("times"), one).select("anchor", "times", "one.*"))
    differ = materialise(runs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    # runs of an anchor whose runs are all alike need no look at their windows
    todo = salted_join(runs, differ, ["anchor"], "kinds").groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("at", "n", "anchor", "owner", (F.col("times") > 1).alias("whole")))).alias("todo"))
    packed = pack(docs).join(todo, ["id", "key"]).select("id", "key", "packed", "todo")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            pieces_ = []
            for k, (z, todo) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                hashed = Hashed(zstandard.decompress(z).split(), window)
                n = np.array([t["n"] for t in todo])
                at = np.repeat(np.array([t["at"] for t in todo]) - np.cumsum(n) + n, n) + np.arange(n.sum())
                anchor, owner, whole = (np.repeat(np.array([t[c] for t in todo]), n) for c in ("anchor", "owner", "whole"))
                first = np.repeat(np.array([t["at"] for t in todo]), n)
                pieces_.append((np.full(len(at), k), at.astype(np.int32), first.astype(np.int32), anchor, owner, hashed.of(at, at + window).view(np.int64), whole))
            row, *columns = (np.concatenate(c) for c in zip(*pieces_, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *map(pa.array, columns)], ["id", "key", "at", "first", "anchor", "owner", "digest", "whole"])

    single = packed.mapInArrow(windows, "id long, key long, at int, first int, anchor long, owner long, digest long, whole boolean")
    one = F.min(F.struct("id", "key", "at", "first", "owner")).alias("one")
    ends = single.groupBy("anchor", "digest").agg(
        F.sum(F.when(F.col("whole"), 2).otherwise(1)).alias("times"), F.every("whole").alias("known"), F.bit_xor(F.xxhash64("id", "key", "first")).alias("held_by"), one
    )
    ends = ends.where("times > 1 and not known").select("anchor", "times", "held_by", "one.*")
    alike = ["anchor", "times", "held_by", "id", "key", "first", "owner"]
    ends = ends.withColumn("gap", F.col("at") - F.row_number().over(Window.partitionBy(*alike).orderBy("at"))).groupBy(*alike, "gap").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"))
    columns = ["id", "key", "at", "n", "owner"]
    found = materialise(runs.where("times > 1").select("anchor", *columns).union(ends.select("anchor", *columns)))
    live = materialise(found.select("anchor").distinct().join(again, "anchor").select("anchor", "of_anchor"))
    return found.select(columns), salted_join(rows, live, ["anchor"], "of_anchor").select(columns)


def pack(docs: DataFrame) -> DataFrame:
    """(id, key, packed): the texts compressed, as they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t or b"") for t in b.column(2).to_pylist()], pa.binary())], ["id", "key", "packed"])

    return docs.select("id", "key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, key long, packed binary")


def dealt(docs: DataFrame, passages: DataFrame, stretches: DataFrame, window: int) -> DataFrame:
    """(shard, salt, what, id, key, at, words): passages (what 0) and stretches of documents (1), by the shard of their owner.

    There are as many shards as the passages take at SHARD_WORDS words each. The stretches of a shard are dealt to salts,
    one for every SLICE_ROWS of them, and its passages are sent to each, so no task gets a shard that many documents share.
    Consecutive stretches of a document that go to one shard are sent as one.
    """
    total = passages.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shard = F.pmod("owner", F.lit(total // SHARD_WORDS + 1))
    both = materialise(passages.withColumn("what", F.lit(0)).union(stretches.withColumn("what", F.lit(1))).withColumn("shard", shard).drop("owner").distinct())
    sizes = materialise(both.groupBy("shard").agg(F.count("*").alias("rows"), F.ceil(F.sum("what") / SLICE_ROWS).cast("int").alias("salts")))
    places = F.sort_array(F.collect_list(F.struct("what", "at", "n", "shard", "salts"))).alias("places")
    lists = salted_join(both, sizes, ["shard"], "rows").groupBy("id", "key").agg(places)
    packed = pack(docs).join(lists, ["id", "key"]).select("id", "key", "packed", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 200):
            row, out = [], []
            for k, (key, z, places) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                words = zstandard.decompress(z).split()
                sent: list[list] = []
                for p in places:
                    if p["what"] and sent and sent[-1][0] == p["what"] and sent[-1][3] == p["shard"] and sent[-1][2] == p["at"]:
                        sent[-1][2] += p["n"]
                    else:
                        sent.append([p["what"], p["at"], p["at"] + p["n"], p["shard"], p["salts"]])
                for what, at, end, shard, of in sent:
                    salts = (key % of,) if what else range(of)
                    text = b" ".join(words[at : end + window - 1])
                    out += [(shard, salt, what, at, text) for salt in salts]
                    row += [k] * len(salts)
            if out:
                shard, salt, what, at, text = zip(*out, strict=True)
                took = [b.column(j).take(pa.array(row)) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(salt, pa.int32()), pa.array(what, pa.int32()), *took, pa.array(at, pa.int32()), pa.array(text, pa.binary())], ["shard", "salt", "what", "id", "key", "at", "words"])

    return packed.mapInArrow(run, "shard long, salt int, what int, id long, key long, at int, words binary")


class Phrases:
    """An Aho-Corasick automaton over the words of passages; words are numbered, any other word is 0."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.made = False

    def add(self, passage: bytes) -> None:
        numbers = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in passage.split())
        self.automaton.add_word(numbers, len(numbers))

    def covered(self, text: bytes) -> list[tuple[int, int]]:
        """The first word and the number of words of each stretch that occurrences of passages cover."""
        if not self.made:
            self.automaton.make_automaton()
            self.made = True
        out: list[tuple[int, int]] = []
        numbers = tuple([self.numbers.get(w, 0) for w in text.split()])
        for first, end in sorted((end - n + 1, end + 1) for end, n in self.automaton.iter(numbers)):
            if out and first <= sum(out[-1]):
                out[-1] = (out[-1][0], max(end, sum(out[-1])) - out[-1][0])
            else:
                out.append((first, end - first))
        return out


def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, at, n): the words of documents that passages cover, from rows of dealt() in the order of shard, salt and what."""
    at_shard, phrases = None, Phrases()
    for b in parts(batches):
        row, starts, counts = [], [], []
        for k, (shard, salt, what, at, words) in enumerate(zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "what", "at", "words")), strict=True)):
            if (shard, salt) != at_shard:
                at_shard, phrases = (shard, salt), Phrases()
            if what == 0:
                phrases.add(words)
                continue
            for first, n in phrases.covered(words):
                row.append(k)
                starts.append(at + first)
                counts.append(n)
        took = [b.column(c).take(pa.array(row, pa.int64())) for c in ("id", "key")]
        yield pa.RecordBatch.from_arrays([*took, pa.array(starts, pa.int32()), pa.array(counts, pa.int32())], ["id", "key", "at", "n"])


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(id, key, runs): the stretches (first word, number of words) that passages cover, for documents that hold any."""
    sent = dealt(docs, *confirmed_passages(docs, window), window)
    found = sent.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "what").mapInArrow(located, "id long, key long, at int, n int")
    return found.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and kept_text: the kept words joined by one space).

    A word goes if a window of ``window`` consecutive words covers it whose words also start anywhere else, in the same
    document or another. Windows are judged on the input, not on what is left. Null and empty texts have no words;
    texts shorter than a window keep all. Rows with the same id are documents of their own, except that rows with the
    same id and text share one result, as the windows of both recur. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id0"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("id0", F.lit(-(1 << 62))).alias("id"), F.xxhash64("id0", "text").alias("key"), "text")
    packed = pack(rows).join(occurrences(rows, window), ["id", "key"], "left").select("id", "key", "packed", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            counts, removed, digests, kept_texts = [], [], [], []
            for z, runs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = zstandard.decompress(z).split()
                stays = np.ones(len(words), np.bool_)
                for r in runs or ():
                    stays[r["at"] : r["at"] + r["n"]] = False
                counts.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept = b" ".join([words[k] for k in np.flatnonzero(stays).tolist()] if removed[-1] else words)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts += [kept] * with_text
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.binary())] * with_text, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    out = packed.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text)
    if with_text:
        out = out.withColumn("kept_text", F.decode("kept_text", "UTF-8"))
    return out.withColumn("id", F.when(F.col("id") != -(1 << 62), F.col("id"))).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM t),
w AS (SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN
          sha256(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING), ' ')) END AS h FROM u),
again AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
marked AS (SELECT doc_id, i, word, CASE WHEN again.h IS NULL THEN 0 ELSE 1 END AS starts FROM w LEFT JOIN again USING (h)),
judged AS (SELECT doc_id, i, word, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS text FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
