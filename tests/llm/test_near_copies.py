"""The near-copy stage against brute force on five-word shingles."""

import random

import corpus_pipeline

from feedloom.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_are_dropped(spark):
    r = random.Random(3)
    words = lambda n: ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(n)]
    texts = [words(300) for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(40):  # k % 7 changed words, each in five shingles
        t = list(texts[k])
        for at in r.sample(range(10, 290), k % 7):
            t[at] = "changed"
        rows.append((1_000 + k, " ".join(t)))
    far = list(texts[50])
    far[10:290:10] = ["other"] * 28
    group = words(200)
    rows += [(2_000, " ".join(far)), (3_000, ""), (3_001, None), (3_002, "Two words"), (3_003, "two  words"), (None, rows[0][1]), (None, " ".join(words(50))), (5, " ".join(words(60)))]
    rows += [(4_000 + k, " ".join([*group[:-1], f"end{k}"])) for k in range(150)]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert ids.count(None) == 1 and ids.count(5) == 2  # no text is lost by its id
    ids = {*ids} - {None}
    sets = {i: shingles(t) for i, t in reversed(rows) if i is not None}  # of id 5 the first
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    order = sorted(sets)
    want = {b for k, b in enumerate(order) if not any(alike(a, b) for a in order[:k])}
    assert ids == want and not ids & set(range(1_000, 1_040))
    assert {2_000, 3_000, 3_002, 4_000} <= ids


def test_rounds_change_nothing(spark):
    """Buckets with many leaders: taken in rounds or by the last pass, the same rows stay."""
    r = random.Random(5)
    base = ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(120)]
    rows = []
    for k in range(60):
        t = list(base)
        for at in r.sample(range(120), r.randrange(9)):
            t[at] = f"w{k}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = simhash.row_sets(docs, "doc_id", "text", 5, 24, 5)
    found = [sorted((bytes(e.src), bytes(e.dst)) for e in simhash.near_copies(docs, sketches, rounds=n).collect()) for n in (1, 2, 8)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 15


def test_band_keys_reach_the_similarity():
    import numpy as np

    r, met = np.random.default_rng(1), 0
    for _ in range(200):
        x = r.integers(0, 1 << 63, 450, np.uint64)
        a, b = x[:400], np.concatenate([x[:356], x[400:444]])  # similarity 356 / 444
        met += any(p == q for p, q in zip(simhash.band_keys(a, 24, 5), simhash.band_keys(b, 24, 5), strict=True))
    assert met == 200


def test_one_bucket_of_chains(spark):
    """All texts in one bucket, chains a, b, c with a unlike c among them: the edges are those of leaders in order, whatever the rounds."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = []
    for _ in range(30):
        a = ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(120)]
        b, c = list(a), list(a)
        b[20] = b[60] = "changed"
        c[20] = c[60] = "changed"
        c[90] = c[105] = "again"
        chain = [a, b, c]
        r.shuffle(chain)
        rows += chain
    texts = [(k, " ".join(t)) for k, t in enumerate(rows)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sketches = simhash.row_sets(docs, "doc_id", "text", 5, 24, 5).withColumn("keys", F.array(F.lit(7).cast("long")))
    of = {bytes(x.same): x.id for x in sketches.select("same", "id").collect()}
    sets = {k: shingles(t) for k, t in texts}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    leaders = []
    for k in sorted(sets):
        if not any(alike(x, k) for x in leaders):
            leaders.append(k)
    want = {(x, k) for x in leaders for k in sets if k != x and alike(x, k)}
    for rounds, block in ((0, 64), (0, 7), (2, 16)):
        got = simhash.near_copies(docs, sketches, rounds=rounds, block=block).collect()
        assert {(of[bytes(e.src)], of[bytes(e.dst)]) for e in got} == want and len(got) == len(want) >= 60
    assert any(a > b for a, b in want)  # links of a leader to a member before it, which led to another


def crowd_of(n, seed, common=0.3):
    """Edits of one text, most with words of their own, some with words or places that others have changed, too."""
    r = random.Random(seed)
    base, out = ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(120)], []
    for k in range(n):
        t = list(base)
        for at in r.sample(range(120), r.choice([0, 1, 1, 2, 3, 4, 5, 6, 9])):
            t[at] = f"w{r.randrange(3)}" if r.random() < common else f"own{k}"
        out.append((k, " ".join(t + ["more"] * r.choice([0, 0, 0, 1]) + [f"end{k % 7}x{j}" for j in range(r.choice([0, 0, 0, 6, 15]))])))
    return out


def test_no_link_of_a_crowd_is_lost(spark):
    """All texts in one bucket: the components are those of all similar pairs, however small a crowd and however few the steps."""
    from pyspark.sql import functions as F

    texts = crowd_of(150, 4)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sketches = simhash.row_sets(docs, "doc_id", "text", 5, 24, 5).withColumn("keys", F.array(F.lit(7).cast("long")))
    of = {bytes(x.same): x.id for x in sketches.select("same", "id").orderBy(F.desc("id")).collect()}
    sets = {k: shingles(t) for k, t in texts}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    def groups(edges):
        root = {k: k for k in sets}
        for a, b in edges:
            a, b = root[a], root[b]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        return root

    want = groups((a, b) for a in sets for b in sets if a < b and alike(a, b))
    assert 20 < len({*want.values()}) < 140
    for crowd, depth in ((4, 3), (16, 1), (1_000, 3)):
        got = [(of[bytes(e.src)], of[bytes(e.dst)]) for e in simhash.copy_links(docs, sketches, crowd=crowd, depth=depth).collect()]
        assert all(alike(a, b) for a, b in got)
        same = [(a, b) for a in sets for b in sets if a < b and sets[a] == sets[b]]
        assert groups(got + same) == want


def test_simhash_step_meets_what_the_keys_do_not(spark):
    """Operator 5's step is one of the stage's own: without a common MinHash key, near copies meet by their fingerprints."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(900)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:-1], "changed"]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sketches = simhash.row_sets(docs, "doc_id", "text", 5, 24, 5).withColumn("keys", F.array(F.col("id")))
    assert simhash.copy_links(docs, sketches).count() == 1


def test_parity_bits_rule_out_no_similar_pair():
    import numpy as np

    r, ruled_out = np.random.default_rng(2), 0
    for n in (1, 3, 40, 129, 400, 9_000):
        for gone in (0, n // 20, n // 9, n // 5, n // 2):
            x = np.unique(r.integers(0, 1 << 63, n + gone, np.uint64))
            a, b = x[: len(x) - gone], x[gone:]
            for p, q in ((a, b), (b, a), (a, x), (x, b)):
                may = simhash.may_be_similar(simhash.parity_bits(p), simhash.parity_bits(q), len(p) + len(q), 0.8)
                assert may or not simhash.similar(p, q, 0.8)
                ruled_out += not may
    assert ruled_out >= 10
    assert simhash.may_be_similar(simhash.parity_bits(x[:0]), simhash.parity_bits(x[:0]), 0, 0.8)


def test_pairs_of_a_crowd_grow_with_its_sets(spark, monkeypatch):
    """Copies of one text with edits of their own, under their real keys: few pairs for each set are compared, over all buckets."""
    r = random.Random(6)
    base, texts = ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(150)], []
    for k in range(160):
        t = list(base)
        for at in r.sample(range(5, 145), min(k, 1 + k % 9)):
            t[at] = f"own{k}x{at}"
        texts.append((k, " ".join(t)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    compared, whole = [], simhash.side_by_side

    def counted(pairs, held):
        compared.append(pairs.count())
        return whole(pairs, held)

    monkeypatch.setattr(simhash, "side_by_side", counted)
    got = simhash.copy_links(docs, simhash.row_sets(docs, "doc_id", "text", 5, 24, 5)).collect()
    assert len(got) >= 60
    # 160 sets and their pivot once, and the pairs of small buckets that may be similar
    assert sum(compared) < 4 * len(texts), compared
