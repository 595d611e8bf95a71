"""Exact, near and substring deduplication against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from feedloom.llm import exact_dedup, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mü nu xi omicron".split()) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared, base = prose(1, 60), prose(2, 300)
    words = base.split(" ")
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "\t\n", 3)), (4, " ".join([*words[:150], "edited", *words[151:]])),
        (5, prose(5) + " " + shared + " " + prose(6)), (6, shared + "\n" + prose(7)), (7, None), (8, ""), (9, " \t "),
        (10, "one two"), (11, "word " * 200), (12, prose(8, 20_000)), (13, prose(9, 34)), (14, "ÀB cd ef gh"), (15, "Àb CD ef gh"),
        (16, "a b"), (16, "a b"), (None, "a b"), (None, None), (17, shared[: len(shared) // 2]),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2, "t") for r in rows], "doc_id long, text string, id string, key int, n int, full string").repartition(3)


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_exact_groups(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    source = collect(docs)
    for r in source:
        groups[norm(r["text"])].append(r["doc_id"])
    got = collect(exact_dedup.exact_groups(docs, digest=True))
    want = []
    for r in source:
        g = groups[norm(r["text"])]
        ids = [i for i in g if i is not None]
        keep = min(ids) if ids else None
        want.append((r["doc_id"], keep, len(g), keep is None or r["doc_id"] == keep, hashlib.sha256(norm(r["text"]).encode()).hexdigest()))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((g["doc_id"], g["keep_id"], g["group_size"], g["kept"], g["text_sha256"]) for g in got), key=key) == sorted(want, key=key)


def test_exact_empty_and_all_columns(spark, docs):
    empty = docs.limit(0)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert {1, 4, 5, 6, 7} <= {r.doc_id for r in kept.collect()} and not {2, 8} & {r.doc_id for r in kept.collect()}
    # without a bitmap, keys are joined: the same result
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(exact_dedup.exact_groups(docs, most_log2=0, digest=True)) == rows(exact_dedup.exact_groups(docs, digest=True))
    assert rows(exact_dedup.keep_first_copies(docs, most_log2=0)) == rows(kept)


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def test_near_duplicates(docs):
    source = collect(docs)
    fps = [brute_fingerprint(r["text"]) for r in source]
    comp = brute_components([r["doc_id"] for r in source], fps)
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(c)) for r, f, c in zip(source, fps, comp, strict=True))
    got = sorted((str(g["doc_id"]), g["fingerprint"], str(g["component_id"])) for g in collect(simhash.near_duplicates(docs)))
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one_of_each(docs).columns == docs.columns


def test_masks_cover_every_pair_within_the_radius():
    masks, r = simhash.covering_masks(), random.Random(3)
    for _ in range(20_000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(m & d == 0 for m in masks)
    assert all(25 <= m.bit_count() <= 40 for m in masks)


@pytest.mark.parametrize("bucket", [1, 4, 96])
def test_links_connect_what_brute_force_connects_however_small_the_buckets(spark, bucket):
    r = random.Random(bucket)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(30)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = [(e.src % (1 << 64), e.dst % (1 << 64)) for e in simhash.links(df, bucket=bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    comp = brute_components(fps, fps)
    roots = dict(zip(fps, comp, strict=True))
    from feedloom.llm.common import connected_components

    got = {n.node % (1 << 64): n.root % (1 << 64) for n in connected_components(simhash.links(df, bucket=bucket)).collect()}
    classes = defaultdict(set)
    for f in fps:
        classes[got.get(f, f)].add(f)
    want = defaultdict(set)
    for f in fps:
        want[roots[f]].add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize(("window", "small"), [(35, False), (5, False), (5, True)])
def test_substrings(docs, window, small, monkeypatch):
    if small:  # many owners and shards, each of many slices
        for name, value in (("SHARD_WORDS", 20), ("OWNER_WORDS", 8), ("SLICE_ROWS", 2)):
            monkeypatch.setattr(substring_dedup, name, value)
    source, seen = collect(docs), Counter()
    words = [WORD.findall(r["text"] or "") for r in source]
    for w in words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = []
    for r, w in zip(source, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(r["doc_id"]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = collect(substring_dedup.remove_repeats(docs, window=window, with_text=True))
    assert sorted((str(g["doc_id"]), g["n_words"], g["n_removed"], g["kept_sha256"], g["kept_text"]) for g in got) == sorted(want)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_phrases_are_found_in_other_documents():
    phrases = substring_dedup.Phrases()
    for p in (b"b c", b"c d e", b"x y"):
        phrases.add(p)
    assert phrases.covered(b"a b c d e f x y x") == [(1, 4), (6, 2)]
    assert phrases.covered(b"b c b c") == [(0, 4)]
    assert phrases.covered(b"c d x") == []


def test_passages_and_stretches_meet_in_their_shard(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 10)
    shared = [" ".join(f"{p}{i}" for i in range(30)) for p in "abcd"]
    texts = [f"start{k} {shared[k % 4]} middle{k} {shared[(k + 1) % 4]} end{k}" for k in range(12)]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, key long, text string")
    rows = substring_dedup.dealt(docs, *substring_dedup.confirmed_passages(docs, 5), 5).collect()
    passages = {(r["shard"], bytes(r["words"])) for r in rows if r["what"] == 0}
    assert len({s for s, _ in passages}) > 1
    # a passage is compiled once for the corpus, not once for each document that holds it
    assert len(passages) == sum(r["what"] == 0 for r in rows)
    assert any(r["id"] != p["id"] and bytes(p["words"]) in bytes(r["words"]) for p in rows if p["what"] == 0 for r in rows if r["what"] == 1 and r["shard"] == p["shard"])
