"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, WORD, checkpoint, salted_join, table

#: Topics by their words, in four languages; a parameter, to be replaced by the lexicons of a corpus.
WORDS = {
    "technology": "api code computer data database internet key network password server software system token user website rechner netz daten passwort logiciel ordinateur réseau données contraseña red datos programa",
    "law": "court copyright judge law lawyer legal license licensed rights terms trial gericht gesetz recht lizenz urteil cour droit loi licence juge corte derecho ley licencia juez",
    "business": "bank business company economy invoice market money price sales shop trade wirtschaft geld markt preis firma rechnung argent entreprise marché prix banque dinero empresa mercado precio banco",
    "health": "cancer disease doctor drug health hospital medical medicine patient arzt gesundheit krankheit krankenhaus médecin santé maladie hôpital médico salud enfermedad hospital",
    "science": "experiment physics planet research science scientist theory university forschung wissenschaft theorie universität recherche théorie université ciencia investigación teoría universidad",
    "politics": "election government minister parliament party policy president vote regierung wahl partei präsident gouvernement élection président gobierno elección partido presidente",
    "sports": "champion coach football game goal league match player score team sieg spiel spieler tor équipe joueur victoire equipo jugador partido",
}
OTHER = "other"
#: Target shares of tokens. Values that are not listed share what is left in proportion to their tokens to the power ALPHA.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1}
TOPICS = {OTHER: 0.95}
SOURCES: dict[str, float] = {}
ALPHA = 0.5
DIMENSIONS = ("source", "lang", "topic")
#: Pairs of language and topic whose factors the driver may hold while it rakes (a number for each, 80 KB at most).
PAIRS = 10_000
NONE = "\x00"


def topic(text: Column, words: dict[str, str] | None = None, least: int = 2) -> Column:
    """The topic with the most occurrences of its words in the whole text (of equals, the first by name), if there are ``least`` of them."""
    words = WORDS if words is None else words
    every = sorted({w for x in words.values() for w in x.split()})
    if not every:
        return F.lit(OTHER)
    # words by their first letter, so that few are tried at the start of a word of the text
    groups = "|".join(f"{c}(?:{'|'.join(w[1:] for w in every if w[0] == c)})" for c in sorted({w[0] for w in every}))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{groups})(?![\p{{L}}\p{{N}}])"), F.lit(0))

    def count(found: Column, own: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(own)))

    def best(found: Column) -> Column:
        return F.array_max(F.array(*[F.struct(count(found, x.split()).alias("n"), F.lit(-k).alias("place"), F.lit(t).alias("topic")) for k, (t, x) in enumerate(sorted(words.items()))]))

    top = F.element_at(F.transform(F.array(found), best), 1)  # so that the words are searched once
    return F.when(top["n"] >= least, top["topic"]).otherwise(OTHER)


def targets(cells: DataFrame, dim: str, listed: dict[str, float], alpha: float) -> DataFrame:
    """(dim, share) for every value in cells: listed shares as given, the others share the rest, all scaled to sum 1."""
    own = F.create_map(*[F.lit(x) for kv in listed.items() for x in kv])[F.col(dim)] if listed else F.lit(None).cast("double")
    totals = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).withColumn("own", own).withColumn("tempered", F.when(own.isNull(), F.pow("n", F.lit(alpha))))
    given, rest = totals.agg(F.coalesce(F.sum("own"), F.lit(0.0)), F.coalesce(F.sum("tempered"), F.lit(0.0))).first()
    left = max(0.0, 1 - given) if given and rest else (0.0 if given else 1.0)
    scale = given + (left if rest else 0) or 1.0
    share = F.coalesce(F.col("own"), F.col("tempered") * (left / rest if rest else 0.0)) / scale
    return checkpoint(totals.select(dim, share.alias("share")))


def not_settled(sweeps: int, off: float) -> None:
    """Targets that contradict each other (a language with no cell outside one source, say) can't all be met; what is closest stands."""
    warnings.warn(f"raking is {off:.2g} off a target share after {sweeps} sweeps: the targets can't be met together", stacklevel=3)


def rake(cells: DataFrame, shares: dict[str, DataFrame], sweeps: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """cells (the dimensions, tokens) with a column w, whose sums over each dimension are the target shares.

    Iterative proportional fitting: each step scales w to one dimension's marginals; a sweep takes all dimensions. It
    ends when no marginal of the first dimension is off by more than the tolerance, or after ``sweeps``. Cells are a
    table like any other here, grouped and joined by Spark, so sources may be as many as hosts are. Values whose
    cells have no tokens keep weight zero.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    first = next(iter(shares))
    for _ in range(sweeps):
        for dim, share in shares.items():
            sums = fitted.groupBy(dim).agg(F.sum("w").alias("__sum")).join(share, dim).select(dim, F.when(F.col("__sum") > 0, F.col("share") / F.col("__sum")).otherwise(0.0).alias("__by"))
            fitted = fitted.join(sums, dim).withColumn("w", F.col("w") * F.col("__by")).drop("__by")
        fitted = checkpoint(fitted)
        off = fitted.groupBy(first).agg(F.sum("w").alias("__sum")).join(shares[first], first).agg(F.max(F.abs(F.col("__sum") - F.col("share")))).first()[0]
        if off is None or off <= tolerance:
            break
    else:
        not_settled(sweeps, off)
    return fitted


def rake_rows(cells: DataFrame, shares: dict[str, DataFrame], sweeps: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """What rake() gives, in one aggregation for each sweep: for cells of few pairs of the dimensions after the first.

    The weight of a cell is its tokens times a factor for each of its values. Values of the first dimension (sources)
    may be any number: each is a row with its cells, and its factor follows within the row from those of the pairs. The
    rows' sums for each pair, combined before the shuffle, are all that reaches the driver; they give the other factors.
    """
    first, *others = shares
    listed = sorted((tuple(r) for r in cells.select(*others).distinct().collect()), key=str)
    spark, number = cells.sparkSession, {k: n for n, k in enumerate(listed)}
    if not listed:
        return cells.withColumn("w", F.lit(0.0))
    numbered = F.broadcast(spark.createDataFrame([(*k, n) for k, n in number.items()], [*others, "pair"]))
    rows = cells.join(numbered, others).groupBy(first).agg(F.collect_list(F.struct(F.col("pair").cast("int").alias("pair"), F.col("tokens").cast("double").alias("tokens"))).alias("own"))
    rows = checkpoint(rows.join(shares[first], first).coalesce(max(1, math.ceil(cells.count() / 50_000))))
    goal = [{r[0]: r[1] for r in shares[d].select(d, "share").collect()} for d in others]
    member = [np.array([[k[j] == v for k in listed] for v in goal[j]], float) for j in range(len(others))]

    def summed(f: np.ndarray):
        factors = F.lit(f)
        return F.aggregate("own", F.lit(0.0), lambda total, x: total + x["tokens"] * F.get(factors, x["pair"]))

    before = now = np.ones(len(listed))
    last = math.inf
    for sweep in range(sweeps):
        by = F.when(F.col("__now") > 0, F.col("share") / F.col("__now")).otherwise(0.0)
        off = F.when(F.col("__before") > 0, F.abs(F.col("share") * F.col("__now") / F.col("__before") - F.col("share"))).otherwise(0.0)
        held = rows.withColumns({"__now": summed(now), "__before": summed(before)}).select(by.alias("by"), off.alias("off"), F.explode("own").alias("x"))
        got = held.groupBy("x.pair").agg(F.sum(F.col("by") * F.col("x.tokens")).alias("s"), F.max("off").alias("off")).collect()
        if sweep and max(r.off for r in got) <= tolerance:
            break
        off = max(r.off for r in got)
        if sweep == sweeps - 1 or (sweep > 8 and off > 0.98 * last):  # sweeps bring no more
            not_settled(sweep, off)
            break
        last = off
        sums, before, now = np.zeros(len(listed)), now, now.copy()
        sums[[r.pair for r in got]] = [r.s for r in got]
        for j, m in enumerate(member):
            marginal = m @ (now * sums)
            now *= m.T @ np.divide([*goal[j].values()], marginal, out=np.zeros(len(marginal)), where=marginal > 0)
    by = F.when(F.col("__now") > 0, F.col("share") / F.col("__now")).otherwise(0.0)
    fitted = rows.withColumn("__now", summed(now)).select(first, by.alias("by"), F.explode("own").alias("x")).select(first, F.col("x.pair").alias("pair"), (F.col("by") * F.col("x.tokens") * F.get(F.lit(now), F.col("x.pair"))).alias("w"), F.col("x.tokens").cast("long").alias("tokens"))
    return checkpoint(fitted.join(numbered, "pair").select(*shares, "tokens", "w"))


def rate(fitted: DataFrame, budget: float) -> float:
    """The factor c for which the sum of tokens * min(1, c * w / tokens) is the budget (or all tokens, if fewer)."""
    c = None
    for _ in range(60):
        full = F.lit(False) if c is None else F.lit(c) * F.col("w") >= F.col("tokens")
        capped, free = fitted.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if free <= 1e-12:
            return c or 0.0
        new = max(0.0, budget - float(capped)) / free
        if c is not None and abs(new - c) <= 1e-9 * max(1.0, c):
            return new
        c = new
    return c


def described(docs: DataFrame, id_col: str, text_col: str, words: dict[str, str] | None, seed: int) -> DataFrame:
    """docs with __source, __lang, __topic, __n_tokens and __uniform (in [0, 1), by a hash of the id, or of the text where there is none)."""
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col))).otherwise(F.xxhash64(F.lit(seed), F.col(text_col)))
    return docs.withColumns({
        "__source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "__lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "__topic": topic(F.col(text_col), words),
        "__n_tokens": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "__uniform": F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53)),
    })


def with_chances(own: DataFrame, keep_share: float, listed: dict[str, dict[str, float]], alpha: float) -> DataFrame:
    """described() documents with __p, the chance of their cell. Few cells are broadcast, so that no text is shuffled; many are joined, hot ones salted."""
    on = [f"__{d}" for d in DIMENSIONS]
    cells = checkpoint(own.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__n_tokens").alias("tokens"), F.count("*").alias("n")))
    shares = {d: targets(cells, d, listed[d], alpha) for d in DIMENSIONS}
    fitted = (rake_rows if cells.select(*DIMENSIONS[1:]).distinct().count() <= PAIRS else rake)(cells.drop("n"), shares)
    c = rate(fitted, keep_share * (cells.agg(F.sum("tokens")).first()[0] or 0))
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("w") / F.col("tokens"))).otherwise(0.0)
    found = fitted.select(*DIMENSIONS, chance.alias("__p")).join(cells.select(*DIMENSIONS, F.col("n").alias("__rows")), list(DIMENSIONS))
    found = checkpoint(found.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "__p", "__rows"))
    return own.join(F.broadcast(found.drop("__rows")), on) if found.count() <= MOST_BROADCAST else salted_join(own, found, on, "__rows")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_share: float = 0.5,
    sources: dict[str, float] | None = None,
    languages: dict[str, float] | None = None,
    topics: dict[str, float] | None = None,
    words: dict[str, str] | None = None,
    alpha: float = ALPHA,
    seed: int = 11,
) -> DataFrame:
    """One row per document: id, source, lang, topic, n_tokens, probability, sampled.

    Token weights are raked to the source, language and topic marginals. A document's probability is min(1, c * w /
    tokens) of its cell, with c such that the expected tokens are ``keep_share`` of all (cells that would have to be
    repeated stay at 1). It is sampled if a hash of its id, uniform in [0, 1), is below the probability: the same
    documents for the same ids and seed, on any cluster. A topic is that of most words in ``words``. Null source and
    language are values of their own (shown as null). A text without words (null, empty) has no tokens and the probability
    of its cell; a cell of such texts alone gets probability 0. Rows of one id share the hash, rows without an id have one
    by their text. Targets that can't be met together are approached and reported by a warning. Extra columns are not read;
    an empty table gives no rows.
    """
    rows = described(docs, id_col, text_col, words, seed).select(F.col(id_col).alias("__id"), *[f"__{d}" for d in DIMENSIONS], "__n_tokens", "__uniform")
    rows = with_chances(checkpoint(rows), keep_share, targets_of(sources, languages, topics), alpha)
    shown = [F.when(F.col(f"__{d}") != NONE, F.col(f"__{d}")).alias(d) for d in DIMENSIONS]
    return rows.select(F.col("__id").alias(id_col), *shown, F.col("__n_tokens").alias("n_tokens"), F.col("__p").alias("probability"), (F.col("__uniform") < F.col("__p")).alias("sampled"))


def targets_of(sources: dict[str, float] | None, languages: dict[str, float] | None, topics: dict[str, float] | None) -> dict[str, dict[str, float]]:
    return {d: standard if own is None else own for d, own, standard in zip(DIMENSIONS, (sources, languages, topics), (SOURCES, LANGUAGES, TOPICS), strict=True)}


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_share: float = 0.5, sources: dict | None = None, languages: dict | None = None, topics: dict | None = None, words: dict | None = None, alpha: float = ALPHA, seed: int = 11) -> DataFrame:
    """The sampled documents with all their columns, and the columns topic, n_tokens and sampling_probability (mix_... where these names are taken).

    Every row is sampled by its own cell, where it stands, as by mixture(); nothing is joined by id.
    """
    out = with_chances(described(docs, id_col, text_col, words, seed), keep_share, targets_of(sources, languages, topics), alpha).where("__uniform < __p")
    clash = {c.lower() for c in docs.columns}
    name = lambda c: c if c not in clash else f"mix_{c}"
    return out.select(*docs.columns, F.col("__topic").alias(name("topic")), F.col("__n_tokens").alias(name("n_tokens")), F.col("__p").alias(name("sampling_probability")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
