"""Line quality, spelling variants and centroid clustering against brute force and on odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from feedloom.llm import centroid_clustering, line_quality, spelling_variants

DOCS = "doc_id long, text string, source string"


def base_figures(text):
    words = text.split()
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + o for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for o in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.split():
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_line_quality_against_brute_force(spark):
    rnd = random.Random(1)
    shared = [f"Shared line {w} of this site" for w in "abcdefgh"]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{rnd.randrange(40 if i % 7 else 4)}" for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(0, 6))]
        text = "\n".join(rnd.sample(own + [x.upper() if rnd.random() < 0.3 else x for x in rnd.sample(shared, rnd.randrange(0, 8))] * rnd.choice([1, 1, 3]), k=None or len(own)) if rnd.random() < 0.2 else own + rnd.sample(shared, rnd.randrange(0, 9)))
        rows.append((i, text, rnd.choice(["a", "b", None])))
    rows += rows[:5]
    got = line_quality.line_quality(spark.createDataFrame(rows, DOCS), least_words=20)
    norm = lambda x: " ".join("".join("0" if c.isdigit() else c for c in x.lower()).split())
    holders = Counter((s, line) for s, t in {(s, t) for _, t, s in rows} for line in {norm(x) for x in t.split("\n") if x.split()})
    often = {k for k, n in holders.items() if n > line_quality.MOST_DOCS}
    assert often
    want = []
    for i, t, s in rows:
        n, chars, symbols, dup, rep = base_figures(t)
        left = sum(len(x.split()) for x in t.split("\n") if (s, norm(x)) not in often)
        failed = n < 20 or 100 * rep > 50 * n
        want.append((i, n, chars, symbols, dup, rep, failed, not failed and not left < n * 0.5))
    found = [tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]
    assert sorted(found) == sorted(want)
    assert {x[-1] for x in want if not x[-2]} == {True, False}
    cleaned = line_quality.clean_documents(spark.createDataFrame(rows, DOCS), least_words=20).collect()
    keep = {(i, s): "\n".join(x for x in t.split("\n") if (s, norm(x)) not in often) for (i, t, s), w in zip(rows, want) if w[-1]}
    assert sorted((r["doc_id"], str(r["source"])) for r in cleaned) == sorted((i, str(s)) for (i, t, s), w in zip(rows, want) if w[-1])
    assert all(r["text"] == keep[r["doc_id"], r["source"]] for r in cleaned)


@pytest.mark.parametrize("text", ["", " \n\t ", "one", "a b", "a a a", "a a a a", "x y z x y z", "a b c a b c d a b", "é\x85é \xa0 b|c<d> #", "1\n1\n\n 1\n1 "])
def test_base_figures_of_short_texts(spark, text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    r = line_quality.line_quality(spark.createDataFrame([(1, text, "s")], DOCS)).first()
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    rep = len({i + o for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for o in range(3)})
    assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), rep)
    assert r["base_failed"] and not r["kept"]


def test_line_quality_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, None, None, 1, "k"), (1, "", "", 2, "k"), (1, "", "", 2, "k"), (2, long, "s", 3, "k"), (3, "a b\n" * 40, None, 4, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, key string")  # names that clash
    out = {(r["doc_id"], r["n_words"]): r for r in line_quality.line_quality(df).collect()}
    assert len(out) == 4 and out[2, 60_000]["kept"] and out[3, 80]["base_failed"] and out[3, 80]["n_dup_lines"] == 39
    assert [r["doc_id"] for r in line_quality.clean_documents(df).collect()] == [2] and line_quality.clean_documents(df).columns == df.columns
    assert line_quality.line_quality(df.limit(0)).count() == 0 and line_quality.clean_documents(df.limit(0)).count() == 0


def test_line_quality_joins_beyond_broadcast(spark, monkeypatch):
    rows = [(i, "\n".join([f"own {i} " * 20, "shared words of all pages " * 30]), "h") for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    want = line_quality.line_quality(df).collect()
    monkeypatch.setattr(line_quality, "MOST_BROADCAST", 0)
    assert sorted(line_quality.line_quality(df).collect()) == sorted(want)
    assert line_quality.clean_documents(df).count() == sum(r["kept"] for r in want)


def brute_forms(counts, ratio=10):
    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in counts if one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("block", [20_000, 7])
def test_spelling_variants_against_brute_force(spark, block):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(7, 10))) for _ in range(150)} | {"aaaaaaa", "aaaaaaaa", "ananana", "nananan"}
    for w in list(words)[:80]:
        i = rnd.randrange(len(w))
        words |= {w[:i] + "z" + w[i:], w[:i] + "ß" + w[i + 1 :], (w + "q")[: len(w) + 1]}
    counts = {w: rnd.choice([2, 3, 25, 30, 400, 5000]) for w in words if len(w) >= 7}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.spelling_forms(rows, block=block).collect()}
    want = brute_forms(counts)
    assert got == want
    assert any(x[0] and x[1] != x[0] for x in want.values())  # chains


def test_vocabulary_slips_and_odd_rows(spark):
    rows = [(i, f"Wörterbuch wOrdbooks, ÀÉabcdefg x{'y' * (i % 9)} İstanbulş", None) for i in range(200)] + [(None, None, "a"), (5, "", "b"), (None, "wordbooks " * 40_000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    want = Counter()
    for i, t, _ in rows:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            low = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode()) if low else 1
            low, run = (low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low), ""
            want[low] += len(low) >= 7
    got = {r["word"]: r["n"] for r in spelling_variants.vocabulary_of(df, "doc_id", "text", 7, 2, 31).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert {r["word"] for r in spelling_variants.spelling_variants(df, slip=31).collect()} == set(got)
    assert spelling_variants.spelling_variants(df.limit(0)).count() == 0


def brute_clusters(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    cents = [v for _, v in first]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        groups = {j: [v for (_, v), a in zip(kept, at) if a == j] for j in range(len(cents))}
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(cents)]
    out = [(i, *nearest(v)) for i, v in kept]
    fits = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(str(i), j, fits(d), digest[j]) for i, d, j in out]


@pytest.mark.parametrize("seed, far", [(1, 1.0), (2, 0.004), (3, 1e7)])
def test_clusters_against_brute_force(spark, seed, far):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(i % 5, 0.7) * far for _ in range(4)]) for i in range(300)] + [(7, [0.0] * 4)] * 20  # ties and repeats
    odd = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [1.0, float("inf"), 0.0, 0.0]), (None, [0.5] * 4), (905, [])]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd], "vec_id long, embedding array<float>, cluster string").repartition(3)
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = centroid_clustering.cluster_vectors(df, dims=4)
    found = got.collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["centroid_sha256"]) for r in found) == sorted(brute_clusters(exact, 4, 8, 10))
    if all(r["distance"] is not None for r in found) and far < 1e6:
        assert {r["inertia"] for r in found} == {sum(r["distance"] for r in found)}
        assert all(r["cluster_inertia"] == sum(x["distance"] for x in found if x["cluster"] == r["cluster"]) for r in found[:20])


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in centroid_clustering.cluster_vectors(df, dims=2).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert centroid_clustering.cluster_vectors(df.limit(0), dims=2).count() == 0
    assert centroid_clustering.cluster_vectors(df, dims=64).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_save_scans():
    """After the first round most rows of far groups are settled by their bounds, and settled rows are right."""
    import numpy as np

    rng = np.random.default_rng(0)
    v = np.floor(np.concatenate([rng.normal(c, 5, (200, 3)) for c in (0, 500, 1000)]))
    one = centroid_clustering.Round([[0, 0, 0], [480, 480, 480], [1000, 1000, 1000]], None)
    cluster, upper, lower = centroid_clustering.assign(one, v, np.full(600, -1), np.zeros(600), np.zeros(600))
    two = centroid_clustering.Round([[1, 0, 0], [500, 500, 500], [1000, 1000, 999]], one.centroids)
    seen, squared = [], centroid_clustering.squared
    centroid_clustering.squared = lambda rows, c: seen.append(len(rows)) or squared(rows, c)
    try:
        again, _, _ = centroid_clustering.assign(two, v, cluster, upper, lower)
    finally:
        centroid_clustering.squared = squared
    assert sum(seen) < 600 and (again == np.repeat([0, 1, 2], 200)).all()
