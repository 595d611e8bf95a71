"""Spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

The vocabulary is sharded by its words' rarest q-grams, with their places and the words' length: each word takes so many of
them that no single edit can touch all, so two words one edit apart share one. Within a shard the postings (place, pair
of letters) are lists of word numbers in order. A word merges the shorter of its own lists with a heap, under the limits of
length and place, looks up what that brings in the longest ones, and verifies what reaches the bound.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, materialise, parts, table

#: Length of a gram, and words that one task indexes at a time; a shard with more is indexed in blocks.
Q, BLOCK = 3, 20_000
#: Letters of a word; lower-cased words have at most 90^3 grams, so their counts fit the driver and each task.
RUN = r"[A-Za-zÀ-ÿ]"


def lowered(x: Column) -> Column:
    """x with A-Z in lower case and nothing else changed."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, upper, lower))


def grams_of(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def rarest(word: str, counts: dict[str, int]) -> list[tuple[int, str]]:
    """The places and grams of word, rarest first, all places of a gram together, until no one edit can touch them all: two lie Q or more apart."""
    out, last = [], None
    for n, g, i in sorted((counts[g], g, i) for i, g in enumerate(grams_of(word))):
        if g != last and out and max(out)[0] - min(out)[0] >= Q:
            break
        out.append((i, g))
        last = g
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, differs by exactly one replaced or inserted code point."""
    if len(a) == len(b):
        return sum(map(str.__ne__, a, b)) == 1
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def merged(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """The numbers of ascending lists in order, each with how many lists hold it, by a heap of the lists' heads."""
    if len(lists) == 1:
        yield from ((x, 1) for x in lists[0])
        return
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapify(heap)
    number, times = heap[0][0], 0
    while heap:
        low, k, at = heap[0]
        if low != number:
            yield number, times
            number, times = low, 0
        times += 1
        if at + 1 < len(lists[k]):
            heapreplace(heap, (lists[k][at + 1], k, at + 1))
        else:
            heappop(heap)
    yield number, times


def reaching(lists: list[list[int]], bound: int) -> Iterator[int]:
    """The numbers in at least ``bound`` of the ascending lists.

    What is in none of the shorter lists is in bound - 1 lists at most: so only the shorter ones are merged, and the
    bound - 1 longest are searched for what that brings.
    """
    if len(lists) < bound:
        return
    lists.sort(key=len, reverse=True)
    longer = lists[: bound - 1]
    for number, times in merged(lists[bound - 1 :]):
        left = len(longer)
        for x in longer:
            if times >= bound or times + left < bound:
                break
            left -= 1
            at = bisect_left(x, number)
            times += at < len(x) and x[at] == number
        if times >= bound:
            yield number


class Shard:
    """The index of one shard: words of one length that have one gram in one place."""

    def __init__(self, length: int, place: int) -> None:
        self.length, self.words, self.postings = length, [], None
        self.open = [i for i in range(length - 1) if not place <= i < place + Q - 1]

    def add(self, word: str, n: int) -> None:
        self.words.append((word, n))
        if self.postings is not None:
            self.post(len(self.words) - 1, word)

    def post(self, number: int, word: str) -> None:
        for i, at in self.postings:
            at.setdefault(word[i : i + 2], []).append(number)

    def near(self, word: str) -> list[tuple[str, int]]:
        """Indexed words one edit from word, which has their length or one more.

        One edit leaves all pairs of letters of the longer word but two; a replaced letter moves none, an inserted one
        moves those behind it by one place. The pairs within the shard's gram are shared by all and count without lists.
        """
        if not self.words:
            return []
        if self.postings is None:  # a shard of one word needs no index
            self.postings = [(i, {}) for i in self.open]
            for number, (w, _) in enumerate(self.words):
                self.post(number, w)
        found = [x for i, at in self.postings if (x := at.get(word[i : i + 2]))]
        if len(word) > self.length:
            found += [x for i, at in self.postings if (x := at.get(word[i + 1 : i + 3]))]
        bound = len(word) - 3 - (Q - 1)
        return [self.words[k] for k in reaching(found, bound) if one_edit(self.words[k][0], word)]


def gram_counts(vocabulary: DataFrame) -> dict[str, int]:
    """How many words hold each gram: 90^3 rows at most for the letters of RUN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for b in parts(batches, 10_000):
            for w in b.column(0).to_pylist():
                seen.update(set(grams_of(w)))
        yield pa.RecordBatch.from_pydict({"gram": list(seen), "n": list(seen.values())}, schema=pa.schema([("gram", pa.string()), ("n", pa.int64())]))

    counted = vocabulary.select("word").mapInArrow(run, "gram string, n long")
    return {r["gram"]: r["n"] for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def shard_rows(vocabulary: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(gram, place, length, probe, word, n): each word under its rarest grams, to be indexed at its own length and to probe the length below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 10_000):
            rows, of = [], []
            for k, w in enumerate(b.column(0).to_pylist()):
                for i, g in rarest(w, counts):
                    rows += [(g, i, len(w), False), *((g, j, len(w) - 1, True) for j in (i - 1, i) if 0 <= j < len(w) - Q)]
                of += [k] * (len(rows) - len(of))
            grams, places, lengths, probes = zip(*rows)
            of = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.string()), pa.array(places, pa.int32()), pa.array(lengths, pa.int32()), pa.array(probes, pa.bool_()), b.column(0).take(of), b.column(1).take(of)],
                names=["gram", "place", "length", "probe", "word", "n"],
            )

    return vocabulary.select("word", "n").mapInArrow(run, "gram string, place int, length int, probe boolean, word string, n long")


def near_pairs(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, na, b, nb), once for each pair of distinct words exactly one edit apart; words have at least 2 Q letters and are distinct.

    A shard with more than ``block`` words is indexed in blocks, each in a task of its own, to which all words of the shard
    are sent as probes: no word of a crowded shard is left out, and no task holds more than one block.
    """
    shard = ["gram", "place", "length"]
    rows = materialise(shard_rows(vocabulary, gram_counts(vocabulary)))
    crowded = rows.where("not probe").groupBy(*shard).agg(F.count("*").alias("indexed")).where(F.col("indexed") > block)
    blocks = checkpoint(crowded.select(*shard, F.ceil(F.col("indexed") / block).cast("int").alias("blocks")))
    home = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, shard, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.col("probe") | (F.col("block") != home))
    ready = dealt.select(*shard, "block", "probe", "word", "n").repartition(*shard, "block").sortWithinPartitions(*shard, "block", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, out = None, None, []
        for b in parts(batches, 10_000):
            for gram, place, length, part, probe, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if (gram, place, length, part) != key:
                    key, index = (gram, place, length, part), Shard(length, place)
                out += [(*x, word, n) for x in index.near(word)]
                if not probe:
                    index.add(word, n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "na", "b", "nb"])
                out = []

    found = ready.mapInArrow(run, "a string, na long, b string, nb long")
    ordered = found.select(F.least("a", "b").alias("a"), F.expr("if(a < b, na, nb)").alias("na"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, nb, na)").alias("nb"))
    return ordered.distinct()


def spelling_forms(vocabulary: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """One row per word of vocabulary (word, n): n_near, form, form_n and root.

    The form is the near word with the largest n (of equals, the smallest in code-point order) if that is at least
    ``ratio`` times the word's n. Counts grow by the ratio along a chain of forms, so there are no cycles and few steps;
    roots double their reach each round.
    """
    vocabulary = materialise(vocabulary)
    pairs = materialise(near_pairs(vocabulary, block))
    both = pairs.select(F.col("a").alias("word"), "na", F.col("b").alias("other"), "nb").union(pairs.select("b", "nb", "a", "na"))
    best = F.min(F.struct((-F.col("nb")).alias("minus"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.any_value("na").alias("own"), best.alias("best"))
    near = materialise(near.select("word", "n_near", F.when(-F.col("best.minus") >= ratio * F.col("own"), F.struct(F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("f")))
    links = checkpoint(near.where("f is not null").select("word", F.col("f.form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links_, links = links, checkpoint(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = links.where("moved").limit(1).count()
        links = links.select("word", "root")
        if not moved:
            break
    out = vocabulary.join(near, "word", "left").join(links, "word", "left")
    return out.select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.form_n").alias("form_n"))


def vocabulary_of(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_n: int, slip: int = 0) -> DataFrame:
    """(word, n) of the lower-cased letter runs of all texts that are long and frequent enough.

    With ``slip``, a run loses one letter where slip divides the crc32 of ``id:run``, that at crc32 modulo its length.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    words = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("run"))
    if slip:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("run"))
    counted = words.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_n)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2, ratio: int = 10, slip: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per distinct word of all texts: word, form, root, n, n_near, form_n; see spelling_forms() and vocabulary_of().

    Null texts give no words, a null id counts as empty in ``slip``'s rule, repeated rows count as often as they stand,
    extra columns are not read, and an empty table gives an empty result. ``least_length`` is 2 Q or more.
    """
    return spelling_forms(vocabulary_of(docs, id_col, text_col, least_length, least_n, slip), ratio, block)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), slip=31)


#: crc32 by its rule (reflected polynomial, one table entry for each byte value); one edit by deleting one letter: of two words
#: of one length that give the same with the same letter deleted, or of a word and another with one letter deleted.
ORACLE = r"""
WITH RECURSIVE step AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) t(b) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS p, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs WHERE length(r) >= 7),
own AS MATERIALIZED (SELECT p, w, count(*) AS n, hex(encode(p || w)) AS x FROM low GROUP BY p, w),
sums AS (SELECT p, w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM own, crc),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM sums),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
del AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (SELECT a.word AS w, b.word AS o FROM del a JOIN del b USING (i, d) WHERE a.word <> b.word
  UNION SELECT word, d FROM del WHERE d IN (SELECT word FROM v) UNION SELECT d, word FROM del WHERE d IN (SELECT word FROM v)),
best AS (SELECT w, count(*) AS n_near, max(v.n) AS most FROM near JOIN v ON v.word = o GROUP BY w),
f AS MATERIALIZED (SELECT best.w, min(o) AS form, most AS form_n FROM best JOIN near USING (w) JOIN v ON v.word = o AND v.n = most JOIN v s ON s.word = best.w
  WHERE most >= 10 * s.n GROUP BY best.w, most),
chain AS (SELECT w, form AS top, 1 AS k FROM f UNION ALL SELECT chain.w, f.form, k + 1 FROM chain JOIN f ON f.w = top),
root AS (SELECT w, arg_max(top, k) AS root FROM chain GROUP BY w)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
FROM v LEFT JOIN best ON best.w = v.word LEFT JOIN f ON f.w = v.word LEFT JOIN root ON root.w = v.word
"""
