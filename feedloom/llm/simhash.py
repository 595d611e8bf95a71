"""Near-duplicate detection: SimHash fingerprints, linked by covering locality-sensitive hashing; and near copies by verified MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, act_on_rows, checkpoint, connected_components, materialise, parts, salted_join, table, text_key

BITS, RADIUS = 64, 3
#: Buckets of more distinct fingerprints than this are searched by neighbourhoods instead of by comparing members.
BUCKET = 96
#: Buckets of more sets than this are searched by the shingles in which their sets differ from a pivot.
CROWD = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def hashed_shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the runs of ``shingle`` words, in order; a shorter text is one run of all its words."""
    words = (text or b"").translate(LOWER).split()  # bytes.split() cuts at the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the UTF-8 text as a signed integer."""
    return folded(hashed_shingles(text, shingle))


def folded(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """The SimHash of hashed shingles; long texts are summed in blocks of bounded memory."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp); null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            fps = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Masks of which at least one keeps only equal bits of any pair within the radius.

    Bit i carries a nonzero vector m(i) of radius + 1 bits. Mask v (nonzero) keeps the bits whose vector has odd
    scalar product with v. ``radius`` differing bits span at most ``radius`` dimensions, so some v is orthogonal to
    all of them and its mask drops them all.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) that connect exactly the distinct fingerprints (fp) that are within the radius of each other.

    Each fingerprint enters 2^(radius+1) - 1 tables under its covering masks; any close pair meets in one of them.
    Buckets of up to ``bucket`` members compare their members in place. The members of larger buckets are searched
    without comparing pairs: x and y differ in at most 3 bits exactly if some z is within 1 bit of x and 2 bits of
    y, so each fingerprint visits its neighbourhoods of radius 1 and 2 (2,146 keys, however large the bucket) and
    is linked to the smallest radius-1 visitor of each key. That is exact, too, and linear in the members.
    """
    assert radius == RADIUS, "the neighbourhood search is laid out for radius 3"
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(covering_masks())])
    rows = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    sizes = checkpoint(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = checkpoint(salted_join(rows, sizes, ["t", "key"], "n"))
    small = met.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("a"))
    pairs = f"flatten(transform(a, x -> transform(filter(a, y -> y > x and bit_count(x ^ y) <= {radius}), y -> struct(x as src, y as dst))))"
    near = small.select(F.explode(F.expr(pairs)).alias("e")).select("e.src", "e.dst")

    hot = met.where(F.col("n") > bucket).select("fp").distinct()
    one = [1 << i for i in range(BITS)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    flips = lambda xs: F.array(*[F.lit(signed(x)) for x in xs])
    inner = hot.select("fp", F.explode(flips([0, *one])).alias("d")).select("fp", F.col("fp").bitwiseXOR(F.col("d")).alias("z"))
    outer = hot.select("fp", F.explode(flips([0, *one, *two])).alias("d")).select("fp", F.col("fp").bitwiseXOR(F.col("d")).alias("z"))
    centre = inner.groupBy("z").agg(F.min("fp").alias("src"))
    far = outer.join(centre, "z").select("src", F.col("fp").alias("dst"))
    return near.union(far).where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Rows with equal fingerprints are linked at distance 0, so the search runs over distinct fingerprints only.
    Null and empty texts have fingerprint zero and are linked like any other. Null ids never become component_id
    unless a component has no other. Extra columns are not read; an empty table gives an empty result.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(distinct.select("fp")))
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    labelled = checkpoint(labelled)
    least = checkpoint(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    of_fp = checkpoint(salted_join(labelled, least, ["root"], "members").select("fp", "n", "component_id"))
    out = salted_join(rows, of_fp, ["fp"], "n")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray, bands: int, rows: int, block: int = 1 << 12) -> list[int]:
    """One signed 64-bit key for each band: the hash of ``rows`` least values of the set, each under a hash function of its own."""
    seeds = np.random.default_rng(5).integers(1, 1 << 63, (2, bands * rows, 1), np.uint64)
    least = np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(hashes), block):
        mixed = (hashes[None, at : at + block] ^ seeds[0]) * (seeds[1] | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=1), out=least)
    return [signed(xxhash.xxh64_intdigest(part.tobytes(), k)) for k, part in enumerate(least.reshape(bands, rows))]


def similar(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of at least the given one."""
    least, most = sorted((len(one), len(other)))
    if least < similarity * most - 1e-9:
        return False
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common >= similarity * (least + most - common) - 1e-9


def parity_bits(hashes: np.ndarray, most: int = 1 << 14) -> bytes:
    """For each bit the parity of the shingles that fall on it; at least two bits for a shingle, a power of two, and up to ``most``."""
    bits = min(most, max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64)
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(one: bytes, other: bytes, both: int, similarity: float) -> bool:
    """Whether sets of parity_bits() one and other, ``both`` shingles together, may be similar: never false for similar sets.

    A shingle that only one of them has flips one bit, common ones flip none: no more bits differ than shingles. The
    larger sketch is folded to the size of the smaller.
    """
    small, large = sorted((one, other), key=len)
    x = int.from_bytes(small, "little")
    for at in range(0, len(large), len(small)):
        x ^= int.from_bytes(large[at : at + len(small)], "little")
    return x.bit_count() <= (1 - similarity) / (1 + similarity) * both + 1e-6


def row_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, text, same, size, fp, keys, bits) for each row: its id, the key of its text, the 128-bit hash of its set of shingles, the set's size, SimHash, MinHash keys and parity bits."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            every = [hashed_shingles(t, shingle) for t in b.column(2).to_pylist()]
            sets, fps = [np.unique(x) for x in every], pa.array([folded(x) for x in every], pa.int64())
            equal = pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary())
            sizes, keys = pa.array([len(x) for x in sets], pa.int64()), pa.array([band_keys(x, bands, rows) for x in sets], pa.list_(pa.int64()))
            bits = pa.array([parity_bits(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), equal, sizes, fps, keys, bits], ["id", "text", "same", "size", "fp", "keys", "bits"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("text"), F.col(text_col).cast("binary").alias("words"))
    return materialise(texts.mapInArrow(sketch, "id long, text binary, same binary, size long, fp long, keys array<long>, bits binary"))


def near_copies(docs: DataFrame, sketches: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, rounds: int = 2, block: int = 64) -> DataFrame:
    """Edges (src, dst) between sets of word shingles (by their 128-bit hashes) with a Jaccard similarity of at least ``similarity``.

    SimHash can't collect these: at similarity 0.8, fingerprints differ in about 10 of 64 bits, for which covering masks
    need 2^11 tables. Candidates come from the MinHash keys in ``sketches``: a pair of similarity s shares one of b keys of
    r values with probability 1 - (1 - s^r)^b, and every link is verified on the whole sets.

    One text stands for each set. Sets meet in buckets. In the order of their smallest ids, those of a bucket that are similar
    to none of its leaders so far become leaders, and every member is compared with every leader, those after it
    included. So a link that joins a member to any leader of a common bucket is found: the second link of a chain a, b, c, too.
    What is not compared are two members that aren't leaders in any bucket they share.

    Leaders are taken in rounds until none is left: one for each bucket in the first ``rounds``, as near copies share theirs in
    most buckets and are then compared about once; up to ``block`` beyond, of which those similar to an earlier one of the
    block don't count. Tasks hold one pair at a time, pairs whose sizes differ too much are never formed, and
    the edges are the same for any ``rounds`` and ``block``.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [np.unique(hashed_shingles(t, shingle)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["same", "set"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ok = [similar(*(np.frombuffer(x, np.uint64) for x in pair), similarity) for pair in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["leader", "same", "ok"])

    # the row that stands for a set: the smallest id, null ids last, then the smallest key of the text
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text")
    sets = checkpoint(sketches.groupBy("same").agg(F.min(rank).alias("rank"), F.min("size").alias("size"), F.min_by("keys", rank).alias("keys")))
    keyed = sets.select("same", "size", "rank", F.posexplode("keys").alias("band", "key"))
    sizes = checkpoint(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    open_ = materialise(salted_join(keyed, sizes, ["band", "key"], "n").select("band", "key", "same", "size", "rank", F.lit(False).alias("linked"), "n"))
    met = checkpoint(open_.select("same", "rank").distinct().select("same", "rank.id", "rank.text"))
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), text_key(F.col(text_col)).alias("own_text"), F.col(text_col).cast("binary").alias("words"))
    few = met.count() <= MOST_BROADCAST
    found = texts.join(F.broadcast(met) if few else met, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_text") == F.col("text"))).select("same", "words")
    held = materialise(found.mapInArrow(hashed, "same binary, set binary").dropDuplicates(["same"]))

    edges, taken, order = None, 0, Window.partitionBy("band", "key").orderBy("rank", "same")
    fits = F.least("size", "leader.size") >= similarity * F.greatest("size", "leader.size") - 1e-9
    own_rank = F.array_position("leaders.same", F.col("same"))
    while True:
        many = 1 if taken < rounds else block
        first = open_.where("not linked").withColumn("place", F.row_number().over(order)).where(F.col("place") <= many)  # cut before the shuffle, too
        listed = F.sort_array(F.collect_list(F.struct("rank", "same", "size")))
        lead = checkpoint(first.groupBy("band", "key").agg(F.transform(listed, lambda x: F.struct(x["same"].alias("same"), x["size"].alias("size"))).alias("leaders"), F.max("n").alias("n_rows")))
        at = materialise(salted_join(open_, lead, ["band", "key"], "n_rows").drop("n_rows"))
        met = at.withColumn("leader", F.explode("leaders")).where(fits & (F.col("leader.same") != F.col("same"))).withColumn("leader", F.col("leader.same"))
        pairs = checkpoint(met.select("leader", "same").distinct())
        led = checkpoint(pairs.groupBy("leader").agg(F.count("*").alias("n_led")))
        own = held.withColumnsRenamed({"same": "leader", "set": "leader_set"}).join(led, "leader")
        both = salted_join(pairs.join(held, "same").select("leader", "same", "set"), own, ["leader"], "n_led").select("leader", "same", "set", "leader_set")
        judged = checkpoint(both.mapInArrow(verified, "leader binary, same binary, ok boolean").where("ok"))
        linked = met.select("band", "key", "leader", "same", "leaders", own_rank.alias("later")).join(judged, ["leader", "same"])
        if many > 1:
            linked = checkpoint(linked)
            among = linked.select("band", "key", F.array_position("leaders.same", F.col("leader")).alias("sooner"), "later").where("sooner < later")
            among = among.groupBy("band", "key").agg(F.collect_list(F.struct("sooner", "later")).alias("among"))
            count_ = lambda a, j: F.when(F.exists("among", lambda e: (e["later"] == j) & F.array_contains(a, e["sooner"])), a).otherwise(F.concat(a, F.array(j)))
            counted = F.aggregate(F.sequence(F.lit(1), F.size("leaders")).cast("array<long>"), F.array().cast("array<long>"), count_)
            lead = checkpoint(lead.join(among, ["band", "key"], "left").select("band", "key", F.transform(counted, lambda j: F.element_at("leaders", j.cast("int"))).alias("leaders"), "n_rows"))
            linked = linked.join(lead.select("band", "key", F.explode("leaders.same").alias("leader")), ["band", "key", "leader"])
            at = salted_join(at.drop("leaders"), lead, ["band", "key"], "n_rows").drop("n_rows")
        new = checkpoint(linked.select("band", "key", "leader", "same"))
        edges = edges.union(new.select("leader", "same")) if edges is not None else new.select("leader", "same")
        now = new.select("band", "key", "same", F.lit(True).alias("now")).distinct()
        rest = at.where(own_rank == 0).drop("leaders").join(now, ["band", "key", "same"], "left")
        open_ = materialise(rest.withColumn("linked", F.col("linked") | F.coalesce("now", F.lit(False))).drop("now"))
        # buckets without another leader are done
        more = checkpoint(open_.groupBy("band", "key").agg(F.count_if(~F.col("linked")).alias("free"), F.count("*").alias("n")).where("free > 0 and n > 1").select("band", "key", "n"))
        if more.isEmpty():
            return edges.select(F.col("leader").alias("src"), F.col("same").alias("dst")).distinct()
        open_, taken = salted_join(open_.drop("n"), more, ["band", "key"], "n"), taken + 1


def shared_sets(docs: DataFrame, sets: DataFrame, text_col: str, shingle: int, bits: int = 24) -> DataFrame:
    """(same, set) for the sets (same, text) that a comparison needs, hashed anew from their texts.

    A table of 2^bits bits, in words of 64, tells the texts that may be needed; it is all that is broadcast, so what
    the driver holds doesn't grow with the sets.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [np.unique(hashed_shingles(t, shingle)).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())], ["same", "set"])

    place = lambda key: F.pmod(F.xxhash64(key), F.lit(1 << bits))
    word, bit = F.shiftright("place", 6), F.expr("shiftleft(1L, cast(place & 63 as int))")
    told = sets.select(place(F.col("text")).alias("place")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("told"))
    texts = docs.select(F.col(text_col).cast("binary").alias("words"), place(text_key(F.col(text_col))).alias("place")).withColumn("word", word)
    found = texts.join(F.broadcast(checkpoint(told)), "word").where(F.col("told").bitwiseAND(bit) != 0).select("words")
    return materialise(found.mapInArrow(hashed, "same binary, set binary").join(sets.select("same"), "same", "left_semi").dropDuplicates(["same"]))


def side_by_side(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(one, other, one_set, other_set) for distinct pairs (one, other) of sets; one may stand in any number of them."""
    pairs = checkpoint(pairs)
    times = checkpoint(pairs.groupBy("one").agg(F.count("*").alias("n_pairs")))
    own = checkpoint(held.withColumnsRenamed({"same": "one", "set": "one_set"}).join(times, "one"))
    half = pairs.join(held.withColumnsRenamed({"same": "other", "set": "other_set"}), "other")
    return salted_join(half, own, ["one"], "n_pairs").select("one", "other", "one_set", "other_set")


def similar_pairs(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (one, other) of sets that are similar."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ok = [similar(*(np.frombuffer(x, np.uint64) for x in pair), similarity) for pair in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["one", "other"]).filter(pa.array(ok, pa.bool_()))

    return checkpoint(side_by_side(pairs.distinct(), held).mapInArrow(judge, "one binary, other binary"))


def told_apart(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(one, other, near, size, pivot_size, tokens) for distinct pairs of a pivot and a set: whether they are similar, and the shingles that one of them lacks."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [[np.frombuffer(x, np.uint64) for x in pair] for pair in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            near, tokens = [similar(p, x, similarity) for p, x in sets], [np.setxor1d(p, x, assume_unique=True).view(np.int64) for p, x in sets]
            sizes = [pa.array([len(pair[k]) for pair in sets], pa.int64()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_()), *sizes, pa.array(tokens, pa.list_(pa.int64()))], ["one", "other", "near", "size", "pivot_size", "tokens"])

    return materialise(side_by_side(pairs, held).mapInArrow(differ, "one binary, other binary, near boolean, size long, pivot_size long, tokens array<long>"))


def candidates(pairs: DataFrame, similarity: float) -> DataFrame:
    """(one, other) of the pairs (one, other: structs of same, size and bits) that may be similar by their parity bits."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ok = [may_be_similar(x, y, n, similarity) for x, y, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["one", "other"]).filter(pa.array(ok, pa.bool_()))

    flat = pairs.select(F.col("one.same").alias("one"), F.col("other.same").alias("other"), F.col("one.bits").alias("one_bits"), F.col("other.bits").alias("other_bits"), (F.col("one.size") + F.col("other.size")).alias("both"))
    return flat.mapInArrow(judge, "one binary, other binary")


def pivots(crowds: DataFrame, settle: bool) -> DataFrame:
    """(one, other): each set of the crowds (bucket, same) with the pivot of its bucket.

    The more sets one meets in all its buckets, the less it differs from what they have in common; a bucket proposes its set that
    meets most. To ``settle`` is to take, for a bucket, the set that most of its members take for the best of all that their buckets
    propose, so that buckets of one crowd share a pivot, a member or not.
    """
    sizes = checkpoint(crowds.groupBy("bucket").agg(F.count("*").alias("n")))
    rows = checkpoint(salted_join(crowds, sizes, ["bucket"], "n"))
    met = rows.groupBy("same").agg(F.sum("n").alias("met"))
    tops = checkpoint(rows.join(met, "same").groupBy("bucket").agg(F.max(F.struct("met", "same")).alias("pivot"), F.count("*").alias("n")))
    chosen = salted_join(crowds, tops, ["bucket"], "n")
    if settle:
        best = checkpoint(chosen.groupBy("same").agg(F.max("pivot").alias("pivot")))
        votes = crowds.join(best, "same").groupBy("bucket", "pivot").agg(F.count("*").alias("times"))
        tops = checkpoint(votes.groupBy("bucket").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot"), F.sum("times").alias("n")))
        chosen = salted_join(crowds, tops, ["bucket"], "n")
    return chosen.select(F.col("pivot.same").alias("one"), F.col("same").alias("other")).where("one <> other").distinct()


def from_common(apart: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """told_apart() with the shingles in which each set differs from c, what most sets of its pivot (one) hold, and the ``pivot`` that takes its place.

    That is the set p of least D(p) - r|p|, D and r as in copy_links(); ``near`` and ``pivot_size`` are told of it, and ``off`` is D(p).
    """
    ratio = (1 - similarity) / (1 + similarity)
    members = apart.groupBy("one").agg((F.count("*") + 1).alias("members"), F.max("pivot_size").alias("pivot_size"))
    tokens = apart.select("one", F.explode("tokens").alias("token")).groupBy("one", "token").agg(F.count("*").alias("n"))
    most = tokens.join(members, "one").where("2 * n > members").groupBy("one").agg(F.collect_list("token").alias("most"))
    most = checkpoint(members.join(most, "one", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>"))))
    flipped = F.concat(F.array_except("tokens", "most"), F.array_except("most", "tokens")).alias("tokens")
    sets = salted_join(apart.drop("pivot_size"), most, ["one"], "members").select("one", "other", "near", "size", flipped)
    sets = materialise(sets.union(most.select("one", "one", F.lit(True), "pivot_size", "most")))
    d = F.size("tokens")
    best = F.struct((d - ratio * F.col("size")).alias("slack"), (F.col("one") != F.col("other")).alias("moved"), F.col("other").alias("pivot"), d.alias("off"), F.col("size").alias("pivot_size"))
    best = sets.groupBy("one").agg(F.min(best).alias("p"), F.count("*").alias("members"))
    best = checkpoint(best.select("one", "p.pivot", "p.off", "p.pivot_size", "members"))
    told = checkpoint(salted_join(sets, best, ["one"], "members").where("other <> pivot").drop("members"))
    moved = similar_pairs(told.where("pivot <> one").select(F.col("pivot").alias("one"), "other"), held, similarity)
    told = told.join(moved.select(F.col("one").alias("pivot"), "other", F.lit(True).alias("now")), ["pivot", "other"], "left")
    return checkpoint(told.withColumn("near", F.when(F.col("pivot") == F.col("one"), F.col("near")).otherwise(F.coalesce("now", F.lit(False)))).drop("now"))


def meeting(apart: DataFrame, similarity: float) -> DataFrame:
    """(bucket, same, size, near, outer, e, cap, n): the sets of from_common() under the differences by which similar ones meet, n rows in a bucket.

    The bounds are those of copy_links(). In a bucket, rows with ``outer`` are of outer sets x, the others of any sets y.
    """
    ratio = (1 - similarity) / (1 + similarity)
    rows = apart.withColumn("e", F.size("tokens") - ratio * F.col("size"))
    ends = rows.groupBy("one").agg(F.min(F.when(~F.col("near"), F.col("e"))).alias("lo"), F.max(F.greatest("size", "pivot_size")).alias("largest"), F.count("*").alias("members"))
    rows = salted_join(rows, checkpoint(ends.where("lo is not null")), ["one"], "members").drop("members")
    tokens = rows.select("one", "other", F.explode("tokens").alias("token"))
    often = checkpoint(tokens.groupBy("one", "token").agg(F.count("*").alias("n")).where("n > 1"))
    shared = salted_join(tokens, often, ["one", "token"], "n").groupBy("one", "other").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))

    e, many, width = F.col("e"), F.size("shared"), F.greatest(F.lit(4), ratio / 4 * F.col("pivot_size"))
    of_outer = F.greatest(F.lit(1), F.ceil((F.col("lo") + e) / 2 - 1e-6))
    of_any = F.greatest(F.lit(1), F.ceil((F.col("off") - ratio * F.col("pivot_size") + e) / 2 - 1e-6), F.ceil(e - ratio * F.least("largest", F.col("size") / similarity) - 1e-6))
    first = lambda o: F.greatest(F.lit(0), many - o + 1).cast("int")  # noqa: E731  # differences of its own, which come first, aren't among the shared ones
    told = rows.join(shared, ["one", "other"]).withColumn("short", first(of_outer))
    told = told.withColumn("all", F.when(F.col("near"), F.col("short")).otherwise(F.greatest("short", first(of_any))))
    told = told.select("one", F.col("other").alias("same"), "size", "near", "e", "lo", "short", width.alias("width"), many.alias("many"), F.posexplode(F.slice("shared", F.lit(1), F.col("all"))).alias("k", "x"))
    told = told.withColumn("cap", 2 * (F.col("many") - F.col("k")) - e + 1e-6)
    bin_ = lambda v: F.floor(v / F.col("width"))
    least = F.when(F.col("near"), F.col("lo")).otherwise(F.greatest("lo", "e")) - 1e-6
    spot = lambda b, outer: F.struct(b.alias("bin"), F.lit(outer).alias("outer"))
    none = F.array().cast("array<struct<bin: bigint, outer: boolean>>")
    as_x = F.when(F.col("near"), none).otherwise(F.array(spot(bin_(e), True)))
    as_y = F.when((F.col("k") < F.col("short")) & (F.col("cap") >= least), F.transform(F.sequence(bin_(least), bin_(F.col("cap"))), lambda b: spot(b, False))).otherwise(none)
    told = told.select("one", F.col("x.token").alias("token"), "same", "size", "near", "e", "cap", F.explode(F.concat(as_x, as_y)).alias("spot"))
    told = materialise(told.select(F.xxhash64("one", "token", "spot.bin").alias("bucket"), "same", "size", "near", "spot.outer", "e", "cap"))
    n = told.groupBy("bucket").agg(F.count_if("outer").alias("x"), F.count_if(~F.col("outer")).alias("y"), F.min("same").alias("least"), F.max("same").alias("most"), F.count("*").alias("n"))
    return salted_join(told, checkpoint(n.where("x * y > 0 and least <> most").select("bucket", "n")), ["bucket"], "n")


def copy_links(docs: DataFrame, sketches: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = CROWD, depth: int = 3) -> DataFrame:
    """Edges (src, dst) between similar sets of shingles (by their 128-bit hashes) that connect all similar sets which met.

    Sets meet in two ways. Operator 5's step: their SimHash fingerprints are within 3 bits (``links``, exact). As at a
    similarity of 0.8 fingerprints differ in about 10 bits, sets also meet under a common MinHash key in ``sketches``. Every edge
    is verified on the whole sets.

    A bucket of up to ``crowd`` sets compares all its pairs, by parity bits first. A larger one has a pivot p, and each set is
    compared with it. Sets similar to p are inner ones, connected by it, the others are outer ones. D(x) is the number of
    shingles in which x differs from c, what most sets of the pivot hold. x and y are similar if they differ in at most
    r(|x| + |y|) shingles, r = (1 - s) / (1 + s), and they differ in D(x) + D(y) less twice the differences from c that
    they share. With e(x) = D(x) - r|x|, they share at least (e(x) + e(y)) / 2. p is the set of least e(p), and an outer
    set differs from p in more than r(|p| + |x|), so e(x) + e(y) is more than 0 for an outer x and any y: they share a
    difference. As y can't share more than D(y), they share at least e(x) - r|y|, too.

    Sets that share o of them share one of the first D - o + 1 in any order; rare ones come first, and of the differences
    from its k-th on, y shares no more than remain: e(x) <= cap(y) = 2(D - k) - e(y), where D counts those that any other set shares.
    So x and y meet under one difference and an interval of e: x has one e, y all up to its cap. No pair of inner sets is
    formed, and the rest grows with the sets unless many make the same rare changes. Those are a crowd of
    their own with a pivot that made them, too; after ``depth`` such steps all pairs that meet are compared.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text")
    sets = sketches.groupBy("same").agg(F.min(rank).alias("rank"), F.min("size").alias("size"), F.min_by("fp", rank).alias("fp"), F.min_by("keys", rank).alias("keys"), F.min_by("bits", rank).alias("bits"))
    sets = materialise(sets.select("same", "rank.text", "size", "fp", "keys", "bits"))

    # operator 5's step: equal fingerprints, and those within 3 bits
    fps = checkpoint(sets.groupBy("fp").agg(F.min("same").alias("one"), F.count("*").alias("n")))
    equal = salted_join(sets.select("fp", "same"), fps.where("n > 1"), ["fp"], "n").where("one <> same").select("one", F.col("same").alias("other"))
    ends = fps.select("fp", "one")
    within = links(ends.select("fp")).join(ends.withColumnRenamed("fp", "src"), "src").join(ends.select(F.col("fp").alias("dst"), F.col("one").alias("other")), "dst")
    alike = checkpoint(equal.union(within.select(F.least("one", "other"), F.greatest("one", "other"))))

    keyed = sets.select("same", F.posexplode("keys").alias("band", "key")).select("same", F.xxhash64("band", "key").alias("bucket"))
    sizes = checkpoint(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    met = checkpoint(salted_join(keyed, sizes, ["bucket"], "n").select("bucket", "same", "n"))
    any_ = met.select("same").union(alike.select("one")).union(alike.select("other")).distinct()
    sets = materialise(sets.select("same", "text", "size", "bits").join(any_, "same"))  # those that meet no other set have no links

    # pairs that are compared as they are
    facts = sets.select("same", F.struct("same", "size", "bits").alias("fact"))
    fact = lambda name: facts.select(F.col("same").alias(name), F.col("fact").alias(f"{name}_fact"))
    alike = alike.join(fact("one"), "one").join(fact("other"), "other").select(F.col("one_fact").alias("one"), F.col("other_fact").alias("other"))
    found = [candidates(alike, similarity)]
    small = met.where(F.col("n") <= crowd).join(facts, "same").groupBy("bucket").agg(F.sort_array(F.collect_list("fact")).alias("a"))
    fits = f"least(x.size, y.size) >= {similarity} * greatest(x.size, y.size) - 1e-9"
    pairs = f"flatten(transform(a, x -> transform(filter(a, y -> y.same > x.same and {fits}), y -> struct(x as one, y as other))))"
    found.append(candidates(small.select(F.explode(F.expr(pairs)).alias("e")).select("e.one", "e.other"), similarity))
    found = [checkpoint(reduce(DataFrame.union, found).distinct())]
    needed = found[0].select("one").union(found[0].select("other")).union(met.where(F.col("n") > crowd).select("same")).distinct().toDF("same")
    held = shared_sets(docs, checkpoint(sets.select("same", "text").join(needed, "same")), text_col, shingle)

    edges, crowds = [], checkpoint(met.where(F.col("n") > crowd).select("bucket", "same"))
    for step in range(depth):
        if crowds.isEmpty():
            break
        apart = from_common(told_apart(pivots(crowds, settle=step == 0), held, similarity), held, similarity)
        edges.append(apart.where("near").select(F.col("pivot").alias("one"), "other"))
        rows = checkpoint(meeting(apart, similarity))
        few = rows.where(F.col("n") <= 2 * crowd) if step + 1 < depth else rows
        x, y = (few.where(F.col("outer") == at).select("bucket", *[F.col(c).alias(f"{c}_{name}") for c in ("same", "size", "near", "e", "cap")]) for name, at in (("x", True), ("y", False)))
        order = "near_y or struct(e_x, same_x) > struct(e_y, same_y)"  # of two outer sets one is x
        met_at = x.join(y, "bucket").where(f"same_x <> same_y and e_x <= cap_y and e_y <= cap_x and ({order})").where(f"least(size_x, size_y) >= {similarity} * greatest(size_x, size_y) - 1e-9")
        found.append(met_at.select(F.least("same_x", "same_y").alias("one"), F.greatest("same_x", "same_y").alias("other")))
        crowds = rows.where(F.col("n") > 2 * crowd).select("bucket", "same").distinct() if step + 1 < depth else rows.limit(0).select("bucket", "same")
        crowds = checkpoint(crowds)
    edges.append(similar_pairs(reduce(DataFrame.union, found), held, similarity))
    return reduce(DataFrame.union, edges).select(F.col("one").alias("src"), F.col("other").alias("dst"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """docs with one row, that of the smallest id, for each group that links of near copies join; all columns stay.

    Rows of equal sets of shingles are one group, null and empty texts among them. Null ids come last; of rows with one id
    and different texts, that with the smallest key of the text stays, of rows that repeat both, any one. Sets meet by SimHash
    within 3 bits and by MinHash; with the bands and rows given, a pair of similarity 0.8 meets with probability 0.99993. All
    similar sets that met are in one group. An empty table stays empty.
    """
    sketches = row_sets(docs, id_col, text_col, shingle, bands, rows)
    roots = connected_components(copy_links(docs, sketches, text_col, shingle, similarity))
    keys = sketches.groupBy("same", "id", "text").agg(F.count("*").alias("times"))
    keys = checkpoint(keys.join(roots, keys["same"] == roots["node"], "left").select("id", "text", "times", F.coalesce("root", "same").alias("root")))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text")
    groups = checkpoint(keys.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.sum("times").alias("rows")).where("rows > 1"))
    judged = salted_join(keys, groups.select("root", "first", "n"), ["root"], "n").withColumn("keep", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text") == F.col("first.text")))
    acts = judged.where("not keep or times > 1").select(F.col("id").alias("__id"), F.col("text").alias("__text"), F.col("keep").alias("__keep"))
    return act_on_rows(docs, acts, id_col, text_col)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
