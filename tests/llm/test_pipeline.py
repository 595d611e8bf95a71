"""The pipeline on a small corpus with planted cases, against a brute-force version of its decisions."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from feedloom.llm import toxicity


def sentence(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9))) for _ in range(n))


def test_planted_cases(spark, tmp_path):
    clean = [(k, sentence(k)) for k in range(300)]
    toxic = [(1_000 + k, sentence(400 + k, 50) + " you idiot and moron, worthless trash") for k in range(40)]
    copies = [(2_000 + k, clean[k][1].replace(" ", "  ", 2)) for k in range(20)]
    item = sentence(9_000, 25) + ". " + sentence(9_001, 6) + "."
    leaks = [(4_000 + k, sentence(600 + k) + " " + item + " " + sentence(700 + k)) for k in range(5)]
    near = [(3_000 + k, clean[50 + k][1].replace(clean[50 + k][1].split()[40], "edited", 1)) for k in range(20)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in clean + toxic + copies + near + leaks] + [(9_999, None, None, None, 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i // 1_000 == 1)) for i, *_ in rows if i < 2_000], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/out-{name}")
        docs = spark.read.parquet(f"{d}/out-{name}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "mixing" or docs.columns == before
    every = {i for i, *_ in rows}
    assert seen["toxicity"] == every - {i for i, _ in toxic}
    assert seen["exact_dedup"] == seen["toxicity"] - {i for i, _ in copies}
    assert seen["near_dedup"] == seen["exact_dedup"] - {i for i, _ in near}
    assert seen["decontamination"] == seen["near_dedup"] - {i for i, _ in leaks}
    assert seen["mixing"] < seen["decontamination"] and {"topic", "n_tokens", "sampling_probability"} <= set(docs.columns)
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == seen["mixing"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, same string, topic string, score double, keep boolean, key binary"


def test_rows_are_judged_by_themselves(spark, tmp_path):
    """Repeated and null ids, nulls in any column, ties, very long texts, clashing columns and empty tables, in every stage."""
    d, item = str(tmp_path), sentence(9_000, 25) + ". " + sentence(9_001, 6) + "."
    bad = "you idiot and moron, worthless trash, "
    train = [(10_000 + k, (bad if k % 3 == 0 else "") + sentence(k, 30)) for k in range(300)]
    long_text = sentence(5, 60_000)
    near = sentence(77, 90)
    rows = [
        (1, "same text"), (2, "same  text"), (2, "a unique other text"), (None, "same text"), (None, "only here"), (None, "only here"), (3, bad + "twice"), (3, "a clean text with id three"),
        (4, "x " + item), (4, "clean text with id four"), (None, bad + "no id"), (None, item), (5, long_text), (5, long_text), (6, near), (7, near.replace(near.split()[40], "edited")), (7, "id seven again"),
        (8, None), (9, ""), (None, None), (10, "tie"), (10, "tie"), (10, " tie"), (11, bad + long_text), (12, long_text + " " + item),
    ]
    more = lambda i, t: (i, t, None, None, None, 1, None, "s", "t", 0.5, None, None)
    spark.createDataFrame([(i, 1, int(k % 3 == 0)) for k, (i, _) in enumerate(train)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame([more(i, t) for i, t in train + rows], COLUMNS)
    pairs = lambda df: sorted((str(r.doc_id), (r.text or "")[:60]) for r in df.collect() if r.doc_id is None or r.doc_id < 10_000)
    cut = lambda xs: sorted((str(i), (t or "")[:60]) for i, t in xs)
    stages = dict(corpus_pipeline.STAGES)
    scored = toxicity.toxicity_scores(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"), spark.read.parquet(f"{d}/labels.parquet").limit(0))
    assert scored.count() == docs.count()
    kept = pairs(stages["toxicity"](spark, docs, d))
    assert not {x for x in kept if x[1].startswith(bad[:40])} and cut(x for x in rows if x[0] in (2, 3, 4, 9, 10) and not (x[1] or "").startswith(bad)) == [x for x in kept if x[0] in ("10", "2", "3", "4", "9")]
    small = docs.where("doc_id is null or doc_id < 10000")
    want = [x for x in rows if x not in [(2, "same  text"), (None, "same text"), (9, ""), (None, None)]]
    for once in [(None, "only here"), (10, "tie"), (5, long_text)]:
        want.remove(once)
    assert pairs(stages["exact_dedup"](spark, small, d)) == cut(want)  # " tie" is another text
    kept = [x for x in rows if x not in [(2, "same  text"), (None, "same text"), (9, ""), (None, None), (None, item), (12, rows[-1][1])] and x[:1] + (x[1] or "",)[:1] != (7, rows[15][1]) and not (x[0] == 10)]
    for once in [(None, "only here"), (5, long_text)]:
        kept.remove(once)
    got = pairs(stages["near_dedup"](spark, small, d))
    assert [x for x in got if x[0] not in ("10", "11")] == cut(x for x in kept if x[0] != 11) and sum(x[0] == "10" for x in got) == 1
    assert pairs(stages["decontamination"](spark, small, d)) == cut(x for x in rows if item not in (x[1] or ""))
    mixed = stages["mixing"](spark, small, d)
    assert set(mixed.columns) == {*docs.columns, "mix_topic", "n_tokens", "sampling_probability"} and set(pairs(mixed)) <= set(cut(rows))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), d)
        assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)
