"""Quality rules with cross-document line frequency: lines that many documents of a host share go, and documents they deplete.

Main path: DataFrame functions only. Every text is read once; what follows works on hashes of lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, SPACE, checkpoint, materialise, salted_join, table

#: A line goes if more distinct documents of its host hold it; a document is depleted if less than this share of its words is left.
MOST_DOCS, LEAST_LEFT = 10, 0.5
#: The base rules: fewer words, or more than this share of words in repeated three-word windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more, its first occurrence included.

    Windows are 64-bit hashes, sorted with their positions, so equal ones stand side by side: n log n for a text of n words.
    Two different windows of one text share a hash with a probability of n^2 / 2^65.
    """
    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
            lambda a, i: F.struct(F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")),
        ),
    )
    again = let(
        F.sort_array(windows),
        lambda s: F.sort_array(
            F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])
        ),
    )
    steps = let(again, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def line_keys(text: Column) -> Column:
    """For each line: two hashes of its normalised form (lower case, digits as 0, white space made uniform) and its number of words."""
    form = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), SPACE, " "))
    return F.transform(
        F.split(text, "\n"),
        lambda x: let(form(x), lambda f: F.struct(F.xxhash64(f).alias("h1"), F.hash(f).alias("h2"), F.size(words_of(x)).alias("words"))),
    )


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One narrow row for each document: the base figures, the hashes of its lines, and a key of host and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    figures = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    return rows.select(
        "id",
        "host",
        text_key(F.col("host"), F.col("text")).alias("key"),
        figures.alias("figures"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        line_keys(F.col("text")).alias("lines"),
    ).select("*", "figures.*").drop("figures")


def text_key(host: Column, text: Column) -> Column:
    """A 128-bit key of a host and a text of it."""
    return F.unhex(F.md5(F.concat_ws("\n", host, text).cast("binary")))


def removed_lines(texts: DataFrame, most_docs: int) -> DataFrame:
    """(key, positions of the lines that go, their words) for the distinct texts (key, host, lines) that lose lines.

    A line is counted once for each distinct text of a host, combined before the shuffle. Lines above the limit are joined
    back to the texts' lines: broadcast where their number allows, else a plain join whose hot lines adaptive execution splits.
    Lines without a word are never counted or removed.
    """
    each = texts.select("key", "host", F.posexplode("lines").alias("at", "line")).where("line.words > 0").select("key", "host", "at", "line.*")
    own = texts.select("host", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("line"))
    often = checkpoint(own.groupBy("host", "line.h1", "line.h2").agg(F.count("*").alias("docs")).where(F.col("docs") > most_docs).select("host", "h1", "h2"))
    few = often.count() <= MOST_BROADCAST
    gone = each.join(F.broadcast(often) if few else often, ["host", "h1", "h2"])
    return gone.groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("gone"), F.sum("words").alias("lost"))


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, most_docs: int, least_left: float, least_words: int, most_repeated: float) -> tuple[DataFrame, DataFrame]:
    """The measured rows with base_failed, and one row (key, n rows, gone, depleted) for each distinct text that loses lines."""
    rows = materialise(measured(docs, id_col, text_col, host_col))
    texts = checkpoint(rows.groupBy("key").agg(F.any_value("host").alias("host"), F.any_value("n_words").alias("n_words"), F.any_value("lines").alias("lines"), F.count("*").alias("n")))
    lost = removed_lines(texts, most_docs).join(texts.select("key", "n_words", "n"), "key")
    decided = checkpoint(lost.select("key", "n", "gone", (F.col("n_words") - F.col("lost") < F.col("n_words") * least_left).alias("depleted")))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > F.col("n_words") * most_repeated)
    return rows.drop("lines", "host").withColumn("base_failed", failed), decided


def by_key(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows left-joined to what was decided for their key, without a shuffle of rows where that is a small table."""
    if decided.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(decided.drop("n")), "key", "left")
    return salted_join(rows, decided, ["key"], "n", "left").drop("n")


def line_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    most_docs: int = MOST_DOCS, least_left: float = LEAST_LEFT, least_words: int = LEAST_WORDS, most_repeated: float = MOST_REPEATED,
) -> DataFrame:
    """One row per input row: id, base figures, base_failed and kept.

    Lines are normalised and hashed (96 bits); of each host, distinct documents that hold a line are counted, exact copies
    of a document once. Lines held by more than ``most_docs`` go. A document is kept if the base rules pass and at least
    ``least_left`` of its words are in lines that stay. Null text counts as empty, a null host is a host of its own,
    repeated rows get equal results, extra columns are not read, and an empty table gives an empty result.
    """
    rows, decided = judged(docs, id_col, text_col, host_col, most_docs, least_left, least_words, most_repeated)
    out = by_key(rows, decided.select("key", "n", "depleted"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
    )


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    most_docs: int = MOST_DOCS, least_left: float = LEAST_LEFT, least_words: int = LEAST_WORDS, most_repeated: float = MOST_REPEATED,
) -> DataFrame:
    """The kept documents with all their columns, and their text without the lines above the limit; rules as in line_quality().

    Of the decisions only keys of texts that fail or lose lines are joined to the documents. Rows that lose no line keep
    their text, a null one aside, which the base rules reject.
    """
    rows, decided = judged(docs, id_col, text_col, host_col, most_docs, least_left, least_words, most_repeated)
    failed = rows.where("base_failed").groupBy("key").agg(F.count("*").alias("n")).withColumn("failed", F.lit(True))
    acts = checkpoint(decided.join(failed.drop("n"), "key", "left").select("key", "n", "gone", (F.col("depleted") | F.coalesce("failed", F.lit(False))).alias("drop")).union(
        failed.join(decided, "key", "left_anti").select("key", "n", F.lit(None).cast("array<int>"), F.lit(True))
    ))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    acts = acts.select(F.col("key").alias("__key"), F.col("n").alias("__n"), F.col("gone").alias("__gone"), F.col("drop").alias("__drop"))
    own = docs.withColumn("__key", text_key(host, F.coalesce(F.col(text_col), F.lit(""))))
    if acts.count() <= MOST_BROADCAST:
        joined = own.join(F.broadcast(acts), "__key", "left")
    else:
        joined = salted_join(own, acts, ["__key"], "__n", "left")
    stay = let(F.split(text_col, "\n"), lambda x: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i))))
    return joined.where("not coalesce(__drop, false)").withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(stay)).select(*docs.columns)


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
l AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (SELECT r, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
              trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS form FROM l),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ll WHERE n > 0 GROUP BY r),
often AS (SELECT host, form FROM ll WHERE n > 0 GROUP BY host, form HAVING count(DISTINCT text) > {MOST_DOCS}),
lost AS (SELECT r, sum(n) AS n FROM ll JOIN often USING (host, form) WHERE n > 0 GROUP BY r),
base AS (SELECT r, doc_id, len(ws) AS n_words, len(list_aggregate(ws, 'string_agg', '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
         FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - lost < n_words * {LEAST_LEFT}) AS kept
FROM base
"""
