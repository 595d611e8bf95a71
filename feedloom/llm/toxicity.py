"""Toxicity by weak supervision: voters, a generative label model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, checkpoint, materialise, parts, table

WORDS = re.compile(r"\w+")
#: Words of the insult lexicon voter.
INSULTS = """
asshole bastard bitch clown coward creep cretin degenerate disgusting dumbass filth fool freak garbage idiot idiotic imbecile
jackass jerk liar loser maggot moron moronic parasite pathetic pervert pig scum scumbag slut stupid trash vermin worthless
""".split()
#: Lengths of the word beginnings that are mined as features, besides whole words.
STEMS = (3, 4, 5, 6, 7)
SHOUT = -1
#: Mined features fall into lexicons by the share of clean rows among those that hold them.
PURITY = (0.02, 0.08, 0.5)
TIERS = len(PURITY)
#: Letters of a word masked by signs (f**k, sh!t), and words that address the reader.
MASKED = re.compile(r"^\W*[^\W\d_]+[*@$!#][*@$!#\w]*[^\W\d_]\W*$")
SECOND_PERSON = frozenset("you your yours yourself u ur du dein deine dich dir euch tu toi ton ta tes vous vos tú tus te vosotros usted".split())
YOU = -100
HIDDEN = -101
#: Voters: the insult lexicon, shouting, exclamation, for each mined lexicon one word of it and two words of it, an insult to
#: the reader, masked words, many insults for the length, and two that vote clean. Their number bounds the vote patterns by
#: 2 to its power.
VOTERS = 3 + 2 * TIERS + 3 + 2


def stems(run: str) -> set[str]:
    out = set()
    for w in WORDS.findall(run.lower()):
        out.add(w + "$")
        out.update(w[:k] for k in STEMS if len(w) >= k)
    return out


class Features(dict):
    """For a run of characters without white space, remembered: the numbers of its features, SHOUT if in capitals, and
    SHOUT - 1 - k where k is the purest lexicon that it hits."""

    def __init__(self, names: list[str], tier: list[int], most: int = 300_000):
        super().__init__()
        self.number, self.tier, self.room = {n: k for k, n in enumerate(names)}, tier, most

    def __missing__(self, run: str) -> tuple[int, ...]:
        found = {self.number[s] for s in stems(run) if s in self.number}
        if found:
            found.add(SHOUT - 1 - min(self.tier[f] for f in found))
        if len(run) > 2 and run.isupper():
            found.add(SHOUT)
        if MASKED.match(run):
            found.add(HIDDEN)
        if run.lower().strip(".,;:!?\"'") in SECOND_PERSON:
            found.add(YOU)
        found = tuple(found)
        if len(self) < self.room:
            self[run] = found
        return found

    def of(self, text: str | None) -> tuple[list[int], int]:
        """The features in the text, and the voters that fire on it as bits."""
        runs = (text or "").split()
        seen = Counter(chain.from_iterable(filter(None, map(self.__getitem__, runs))))
        n = max(1, len(runs))
        shouting, hits = seen.pop(SHOUT, 0) / n, [seen.pop(SHOUT - 1 - k, 0) for k in range(TIERS)]
        masked, you = seen.pop(HIDDEN, 0), seen.pop(YOU, 0)
        fired = [any(f < len(INSULTS) for f in seen), shouting > 0.3, (text or "").count("!") / n > 0.2]
        for k in range(TIERS):
            fired += [hits[k] > 0, sum(hits[: k + 1]) > 1]
        fired += [you > 0 and sum(hits[:2]) > 0, masked > 1, sum(hits) > 0.02 * n + 1]
        fired += [not seen, not seen and shouting <= 0.3]
        return [*seen], sum(1 << k for k, x in enumerate(fired) if x)


def train_row(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def with_labels(docs: DataFrame, labelled: DataFrame, n: int, id_col: str, how: str) -> DataFrame:
    """docs joined to the labels (__id, toxic), which are broadcast only while they are few."""
    return docs.join(F.broadcast(labelled) if n <= MOST_BROADCAST else labelled, docs[id_col] == labelled["__id"], how)


def mined_features(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, least: float) -> list[tuple[str, int, int]]:
    """(feature, toxic, clean rows) of the features that lean to toxic by a likelihood ratio of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        of_run = lru_cache(300_000)(lambda run: tuple(stems(run)))

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["feature", "clean", "toxic"])
            counts.clear()
            return b

        for b in parts(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in set(chain.from_iterable(map(of_run, set((text or "").split())))):
                    counts.setdefault(s, [0, 0])[toxic] += 1
                if len(counts) > 200_000:
                    yield out()
        yield out()

    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    rows = with_labels(docs, labelled, n0 + n1, id_col, "inner").select(F.col(text_col).alias("text"), "toxic")
    if not n0 or not n1:
        return []
    got = rows.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    base = n1 / (n0 + n1)
    share = F.col("t") / (F.col("t") + F.col("c"))
    plogp = lambda x, p, q: F.when(x > 0, x * F.log(p / q)).otherwise(0.0)
    ratio = 2 * (plogp(F.col("t"), share, F.lit(base)) + plogp(F.col("c"), 1 - share, F.lit(1 - base)))
    got = got.where((share >= 0.5) & (ratio >= least)).withColumn("g", ratio)
    return [(r.feature, r.t, r.c) for r in got.orderBy(F.desc("g"), "feature").collect()]


class LabelModel:
    """A two-class generative model of vote patterns, fitted by expectation maximisation.

    Voters that stay correlated given the class (phi coefficient of at least ``tie``) are tied into factors of up to
    four voters with a joint table for each class; other voters have a probability of firing of their own, which is
    their accuracy. Labelled rows keep their class; all others are weighted by their posterior and together count no
    more than the labelled rows do, where there are any.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, by_label: np.ndarray, rounds: int = 60, tie: float = 0.25):
        """counts: rows of each pattern without a label; by_label: rows of each pattern with label 0 and 1."""
        bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
        known = by_label.sum(axis=0)
        if known.sum():
            counts = counts * min(1.0, known.sum() / max(1, counts.sum()))
        prior = (known[1] + 1) / (known.sum() + 2)
        start = (by_label[:, 1] + prior * 2) / (by_label.sum(axis=1) + 2)
        post = np.where(by_label.sum(axis=1) > 0, start, np.where(bits[:, 3 : 3 + 2 * TIERS].any(axis=1) | (bits[:, 0] > 0), 0.8, 0.02))
        self.factors = [[k] for k in range(VOTERS)]
        for step in range(rounds):
            weight = np.stack([counts * (1 - post) + by_label[:, 0], counts * post + by_label[:, 1]])
            if step == 1:
                self.factors = self.tied(bits, weight, tie)
            total = weight.sum(axis=1)
            score = np.log((total + 1) / (total.sum() + 2))[:, None].repeat(len(patterns), axis=1)
            for f in self.factors:
                cell = (bits[:, f] << np.arange(len(f))).sum(axis=1)
                table_ = np.stack([np.bincount(cell, w, 1 << len(f)) for w in weight]) + 0.1
                score += np.log(table_ / table_.sum(axis=1, keepdims=True))[:, cell]
            new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
            if step > 2 and np.abs(new - post).max() < 1e-6:
                break
            post = new
        self.posterior = dict(zip(patterns.tolist(), post.tolist(), strict=True))
        self.prior = float(weight[1].sum() / max(1e-9, weight.sum()))

    @staticmethod
    def tied(bits: np.ndarray, weight: np.ndarray, tie: float) -> list[list[int]]:
        strength = np.zeros((VOTERS, VOTERS))
        for w in weight:
            p = (w[:, None] * bits).sum(axis=0) / max(w.sum(), 1e-9)
            both = (bits * w[:, None]).T @ bits / max(w.sum(), 1e-9)
            spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p))) + 1e-9
            strength = np.maximum(strength, np.abs(both - np.outer(p, p)) / spread * (spread > 1e-6))
        group = {k: [k] for k in range(VOTERS)}
        for s, i, j in sorted(((strength[i, j], i, j) for i in range(VOTERS) for j in range(i)), reverse=True):
            if s >= tie and group[i] is not group[j] and len(group[i]) + len(group[j]) <= 4:
                merged = group[i] + group[j]
                for k in merged:
                    group[k] = merged
        return [*{id(g): g for g in group.values()}.values()]


def logistic(rows: list[tuple[list[int], float]], width: int, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by full-batch Adam. A row is its active columns and label."""
    if not rows:
        return np.zeros(width), -3.0
    y = np.array([p for _, p in rows])
    row = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    col = np.array([k for c, _ in rows for k in c], np.int64)
    w, first, second = (np.zeros(width + 1) for _ in range(3))
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + w[-1]
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, d[row], width), d.sum()) / len(rows)
        g[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class Scorer:
    """A fitted classifier: toxicity between 0 and 1 of a text."""

    def __init__(self, features: Features, names: int, weights: np.ndarray, bias: float):
        self.features, self.names, self.weights, self.bias = features, names, weights, bias

    def columns_of(self, text: str | None) -> tuple[list[int], int]:
        """The active columns (features, then voters) and the vote pattern."""
        seen, pattern = self.features.of(text)
        return [*seen, *(self.names + k for k in range(VOTERS) if pattern >> k & 1)], pattern

    def scores_of(self, columns: list[list[int]]) -> np.ndarray:
        z = np.array([self.weights[c].sum() + self.bias for c in columns])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.scores_of([self.columns_of(t)[0] for t in texts])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_training: int = 20_000, least_ratio: float = 15.0) -> tuple[Scorer, DataFrame]:
    """The classifier, learned from the labels of training rows and the votes on all documents; and (id, held_out, columns) of every row.

    Texts are read once for the lexicons and once for the votes; their active columns are written, and the fit and the scores
    read those.

    1. Lexicons are mined from all training labels: words and word beginnings that lean to toxic rows. Their number is that
       of the features which reach the likelihood ratio; it grows with the labels.
    2. Lexicon and pattern voters vote on every document; only the counts of the vote patterns (at most 2^VOTERS, in practice
       some hundreds) are gathered, over the whole table. The label model turns a pattern into a posterior.
    3. A logistic regression on the mined features and votes is fitted to the posteriors of a sample of ``max_training``
       training rows (in expectation, by a hash of the id).

    Rows whose crc32(id) mod 4 is 2 are held out: neither their labels nor their texts are learned from, except as
    unlabelled vote counts. Labels other than 0 and 1 are ignored; repeated labels of an id count once (1 wins). Without
    labels of both kinds, only the fixed lexicon and patterns vote.
    """
    spark, docs = docs.sparkSession, docs.select(id_col, text_col)
    by_id = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = checkpoint(by_id.where(train_row("__id")))
    mined = mined_features(docs, labelled, id_col, text_col, least_ratio)

    names = [*[w + "$" for w in INSULTS], *[f for f, _, _ in mined if f not in {w + "$" for w in INSULTS}]]
    strength = {f: (c + 0.5) / (t + c + 1) for f, t, c in mined}
    tier = [int(np.searchsorted(PURITY[:-1], strength.get(n, 0.01))) for n in names]
    voters = spark.sparkContext.broadcast(Scorer(Features(names, tier), len(names), np.zeros(len(names) + VOTERS), 0.0))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            got = [voters.value.columns_of(t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([c for c, _ in got], pa.list_(pa.int32())), pa.array([p for _, p in got], pa.int64())], ["id", "held_out", "draw", "toxic", "columns", "pattern"])

    known = with_labels(docs, labelled, labelled.count(), id_col, "left")
    draw = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1_000_000))
    known = known.select(F.col(id_col).cast("long").alias("id"), (~train_row(id_col)).alias("held_out"), draw.alias("draw"), "toxic", F.col(text_col).alias("text"))
    voted = materialise(known.mapInArrow(vote, "id long, held_out boolean, draw long, toxic int, columns array<int>, pattern long"))
    rows = voted.groupBy("pattern", F.coalesce("toxic", F.lit(-1)).alias("label")).agg(F.count("*").alias("n")).collect()
    patterns = np.array(sorted({r.pattern for r in rows}), np.int64)
    place, counts, by_label = {p: k for k, p in enumerate(patterns.tolist())}, np.zeros(len(patterns)), np.zeros((len(patterns), 2))
    for r in rows:
        if r.label < 0:
            counts[place[r.pattern]] += r.n
        else:
            by_label[place[r.pattern], r.label] += r.n
    model = LabelModel(patterns, counts, by_label) if len(patterns) else None

    total = int(counts.sum() + by_label.sum())
    sample = voted.where(~F.col("held_out") & (F.col("draw") < max(1, int(1e6 * min(1.0, max_training / max(1, 0.75 * total))))))
    rows = sample.select("columns", "pattern").collect() if model else []
    weights, bias = logistic([(r.columns, model.posterior.get(r.pattern, model.prior)) for r in rows], len(names) + VOTERS)
    return Scorer(Features(names, tier), len(names), weights, bias), voted.select("id", "held_out", "columns")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **more) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1) and predicted (1 where score reaches the threshold).

    The classifier of fit() scores every whole text; ids, labels, language and source are no inputs of a score. Null and
    empty texts have no features and get the score of the bias and the voters for clean. Repeated rows are scored each;
    extra columns are not read; an empty table gives no rows.
    """
    scorer, voted = fit(docs, labels, id_col, text_col, **more)
    scorer = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            p = scorer.value.scores_of(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return voted.mapInArrow(score, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **more) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay.

    Every row is judged by its own text where it stands, so nothing is joined or shuffled, and repeated and null ids matter
    to no other row.
    """
    scorer, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **more)[0]), docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield b.filter(pa.array(scorer.value.scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
