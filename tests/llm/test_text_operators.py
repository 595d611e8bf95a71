"""Token counts, toxicity, personal data, mixing and decontamination."""

import random
import zlib

import pytest

from feedloom.llm import decontam, mixing, pii, token_counts, toxicity


def collect(df):
    return [r.asDict() for r in df.collect()]


def sentence(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice("the of and a in on with for".split()) if r.random() < 0.4 else "".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9))) for _ in range(n))


# ---- token counts ----


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary()
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [None, "", " ", "  a  b ", "▁x", "日本語 テスト𝄞", "<s> hello</s>", "a\tb\n\nc", "x" * 5_000, *[sentence(k) for k in range(30)], "naïve ﬁ é́ ​", sentence(99, 20_000), "a", "a"]
    df = spark.createDataFrame([(k, x, "z") for k, x in enumerate(texts)], "doc_id long, text string, id string")
    got = {r["doc_id"]: r for r in collect(token_counts.token_counts(df))}
    for k, x in enumerate(texts):
        assert got[k]["n_tokens"] == (len(t.encode(x, add_special_tokens=False).ids) if x else 0), repr((x or "")[:40])
        assert got[k]["n_chars"] == len(x or "")
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_ties_keep_the_longest_last_piece():
    c = token_counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0)])
    assert c.count("ab") == 1 and c.count("abc") == 1 and c.count("abé") == 3


# ---- toxicity ----


@pytest.fixture(scope="module")
def toxic_docs(spark):
    r, rows, labels = random.Random(1), [], []
    for k in range(900):
        bad, words = k % 6 == 0, sentence(k, 40).split(" ")
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), "idiot" if k % 4 else "zwobbel" + r.choice(["en", "ung", "t"]))
        rows.append((k, " ".join(words), "en", 1))
        labels.append((k, 1, int(bad)))
    rows += [(9_000, None, None, 1), (9_001, "", "en", 1), (9_002, "idiot " * 9_000, "en", 1), (None, "nothing here", "en", 1), (1, rows[1][1], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), {k: t for k, _, t in labels}


def test_toxicity_on_held_out_rows(toxic_docs):
    docs, labels, truth = toxic_docs
    got = collect(toxicity.toxicity_scores(docs, labels))
    assert len(got) == docs.count()
    for g in got:
        if g["doc_id"] is not None:
            assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3)
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert sum(g["predicted"] == truth[g["doc_id"]] for g in held) >= 0.97 * len(held)
    by_id = {g["doc_id"]: g for g in got}
    assert by_id[9_002]["predicted"] == 1 and not by_id[9_000]["predicted"] and not by_id[9_001]["predicted"] and not by_id[None]["predicted"]


def test_toxicity_without_labels_or_rows(toxic_docs):
    docs, labels, truth = toxic_docs
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    got = {g["doc_id"]: g["predicted"] for g in collect(toxicity.toxicity_scores(docs, labels.limit(0)))}
    assert sum(got[k] for k, t in truth.items() if not t) == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = {(g["doc_id"], g["score"]) for g in collect(toxicity.toxicity_scores(docs, labels)) if g["predicted"]}
    assert kept.count() == docs.count() - len(gone) and {9_000, 9_001, None} <= {r.doc_id for r in kept.collect()}


def test_label_model_ties_correlated_voters():
    import numpy as np

    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.1
    a = np.where(y, r.random(20_000) < 0.9, r.random(20_000) < 0.01)
    bits = (a.astype(int) << 3) | (a.astype(int) << 4) | (np.where(y, r.random(20_000) < 0.7, r.random(20_000) < 0.05).astype(int) << 5)
    patterns, counts = np.unique(bits, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float), np.zeros((len(patterns), 2)))
    assert any({3, 4} <= set(f) for f in model.factors)
    assert model.posterior[int(0b111 << 3)] > 0.9 and model.posterior[0] < 0.1


def test_label_model_against_brute_force():
    """Without ties the model is naive Bayes by expectation maximisation: the same, row by row, gives the same posteriors."""
    import numpy as np

    r = np.random.default_rng(2)
    n, v = 3_000, toxicity.VOTERS
    y = r.random(n) < 0.2
    hit, false = r.uniform(0.4, 0.9, v), r.uniform(0.01, 0.2, v)
    votes = np.where(y[:, None], r.random((n, v)) < hit, r.random((n, v)) < false)
    label = np.where(r.random(n) < 0.1, y.astype(int), -1)
    packed = (votes << np.arange(v)).sum(axis=1)
    patterns, at = np.unique(packed, return_inverse=True)
    counts = np.bincount(at, label < 0, len(patterns))
    by_label = np.stack([np.bincount(at, label == k, len(patterns)) for k in (0, 1)], axis=1)
    model = toxicity.LabelModel(patterns, counts, by_label, tie=9.0)

    known = by_label.sum(axis=0)
    scale = min(1.0, known.sum() / counts.sum())
    prior = (known[1] + 1) / (known.sum() + 2)
    post = np.empty(n)
    for k in range(n):  # the start: labels of the same pattern, else the lexicon voters
        own = by_label[at[k]]
        post[k] = (own[1] + prior * 2) / (own.sum() + 2) if own.sum() else 0.8 if votes[k, [0, *range(3, 3 + 2 * toxicity.TIERS)]].any() else 0.02
    for step in range(60):
        score = np.zeros((2, n))
        weight = [np.where(label < 0, scale * (post if c else 1 - post), label == c) for c in (0, 1)]
        for c in (0, 1):
            score[c] += np.log((weight[c].sum() + 1) / (weight[0].sum() + weight[1].sum() + 2))
            for j in range(v):
                fired = (weight[c] * votes[:, j]).sum() + 0.1
                rest = (weight[c] * ~votes[:, j]).sum() + 0.1
                score[c] += np.log(np.where(votes[:, j], fired, rest) / (fired + rest))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
        if step > 2 and np.abs(new - post).max() < 1e-6:
            break
        post = new
    assert max(abs(model.posterior[p] - post[k]) for k, p in enumerate(packed.tolist())) < 1e-3
    assert np.mean((post > 0.5) == y) > 0.97


# ---- personal data ----


def test_surrogates(spark):
    rows = [
        (1, "Mr. John Smith wrote to ann.lee7@mail.example.org; Mrs Anna Brown, tel +1 (555) 013-4477, card 4111111111111111."),
        (2, "ANN.LEE7@mail.example.org again, 10.20.30.40 and 10.20.30.41; г-жа Анна Попова"),
        (3, None), (4, ""), (5, "version 2.0, chapter 10.2, no data (c) 1999-2001"), (6, 'token = "0123456789abcdef0123456789abcdef01234567"'),
        (None, "mail bob@x.example.com"), (None, None), (7, "word " * 30_000 + "bob@x.example.com"), (7, "bob@x.example.com"),
    ]
    df = spark.createDataFrame([(*r, "r", 5) for r in rows], "doc_id long, text string, row string, s int")
    got = collect(pii.pseudonymise(df, "k"))
    by = {g["doc_id"]: g for g in got if g["text"] and g["doc_id"] != 7}
    one = by[1]["text"]
    for gone in ("John", "Smith", "ann.lee7", "Anna", "555) 013", "4111111111111111"):
        assert gone not in one
    assert one.startswith("Mr. ") and "Mrs " in one and by[1]["n_entities"] == 5 and "tel +1 (" in one
    men, women = pii.NAMES["latin", "m"].split(), pii.NAMES["latin", "f"].split()
    assert one.split()[1] in men and one.split("Mrs ")[1].split()[0] in women
    mail = next(w for w in one.split() if "@" in w).rstrip(";")
    assert mail in by[2]["text"] and mail.endswith(".org") and mail.split("@")[0][-1].isdigit()
    ips = [w for w in by[2]["text"].replace(";", "").split() if w.count(".") == 3 and "@" not in w]
    assert len(set(ips)) == 2 and "10.20.30.4" not in by[2]["text"]
    assert by[2]["text"].split("г-жа ")[1].split()[0] in pii.NAMES["cyrillic", "f"].split()
    assert by[5]["text"] == rows[4][1] and by[5]["n_entities"] == 0
    assert by[6]["text"].startswith('token = "') and len(by[6]["text"]) == len(rows[5][1])
    bob = by[None]["text"].split()[1]
    assert sorted(g["text"][-len(bob) :] for g in got if g["doc_id"] == 7) == [bob, bob]
    assert {g["doc_id"]: g["text"] for g in got}[4] == "" and sum(g["text"] is None for g in got) == 2
    again = {g["doc_id"]: g["text"] for g in collect(pii.pseudonymise(df, "k")) if g["text"]}
    assert again[1] == one and {g["doc_id"]: g["text"] for g in collect(pii.pseudonymise(df, "other")) if g["text"]}[1] != one
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_an_entity_is_found_standing_alone(spark):
    secrets = ["password: swordfish", "secret=correcthorsebattery", "key sk-abcdefghijklmnopqrstuvwxyz", "by Mr.\u00a0Smith", "это г-жа Попова", "say Dr Who", "mail ann@x.example.com", "ssn 123-45-6789", "at 10.20.30.40"]
    got = {g["doc_id"]: g for g in collect(pii.pseudonymise(spark.createDataFrame([*enumerate(secrets)], "doc_id long, text string"), "k"))}
    for k, text in enumerate(secrets):
        assert got[k]["n_entities"] == 1 and got[k]["text"] != text, text


def test_distinct_people_stay_distinct(spark):
    people = [f"Mr {a} {b}" for a in ("Aaron", "Caleb", "Dylan", "Felix", "Ivan") for b in (f"Q{chr(97 + i)}{chr(97 + j)}x" for i in range(12) for j in range(12))]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(people)], "doc_id long, text string")
    got = [g["text"] for g in collect(pii.pseudonymise(df, "k"))]
    assert len(set(got)) == len(people) and not set(got) & set(people)


def test_mentions_of_one_entity_meet(spark):
    texts = [
        "Mr John Smith came. Then John Smith left, Smith's hat too, and Dr. John Smith wept.", "Mr. John Smith again; Mrs Smith; MR", "call +1 555 013 4477 or +1-555-013-4477 or +15550134477",
        "card 4111 1111 1111 1111 is 4111111111111111", "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013000", "token=abcdefgh12 and password: abcdefgh12", "Smith alone, no title",
        "г-жа Анна Попова и Анна Попова", "password: ........", "x@y.co z@y.co", "名前@例え.jp", "Mr Smith-", "+" + "1" * 9,
    ]
    out = {g["doc_id"]: g["text"] for g in collect(pii.pseudonymise(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "k"))}
    w = out[0].split()
    full = " ".join(w[1:3])
    assert w[0] == "Mr" and out[0].count(full) == 1 + 2 and f"{w[2].rstrip('.')}'s hat" in out[0] and "Smith" not in out[0] and "John" not in out[0]
    assert out[1].startswith(f"Mr. {full} again; Mrs {w[2]}") and out[6] == texts[6]
    a, b, c = out[2][5:].split(" or ")
    assert a.replace(" ", "-") == b and b.replace("-", "") == c and a.startswith("+1 ") and a != "+1 555 013 4477"
    one, two = out[3][5:].split(" is ")
    luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(two))))
    assert one.replace(" ", "") == two and one.count(" ") == 3 and luhn % 10 == 0 and two != "4" + "1" * 15
    one, two = out[4][5:].split(" and ")
    assert one.replace(" ", "") == two and two[:2] == "DE" and int("".join(str(int(x, 36)) for x in two[4:] + two[:4])) % 97 == 1
    assert out[5].startswith("token=") and out[5].split(" and ")[0][6:] == out[5].split("password: ")[1] != "abcdefgh12"
    assert out[7].split()[1:3] == out[7].split()[4:6] and out[7].split()[2].endswith("а") and "Попова" not in out[7]
    assert out[8] != texts[8] and len({*out[9].split()}) == 2 and "名" not in out[10] and out[11].endswith("-") and len(out[12]) == 10


def test_whole_names_go(spark):
    """Names of several parts, initials, particles, degrees and curly apostrophes; numbers with 00; web tokens."""
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmN"
    texts = [
        "Mr John Paul Smith called", "Mr J. Smith called", "Mr O’Brien and O'Brien called", "Dr. med. Anna Müller rief an", "Mrs. van der Berg und Berg", "Prof. Dr. Karl von Zabel schrieb",
        "Mr John Adam Smith called", "tel 0044 20 7946 0958 now", "tel +44 20 7946 0958 now", f"Authorization: Bearer {token}", "Mr K. Smith called", "Mr J. R. Smith, not Jx Smith",
    ]
    out = {g["doc_id"]: g["text"] for g in collect(pii.pseudonymise(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "k"))}
    gone = ["John", "Paul", "Smith", "J.", "Brien", "Anna", "Müller", "Berg", "Karl von", "Zabel", "Adam", "7946", "eyJhbGciOiJIUzI1NiJ9", "K."]
    assert not [(w, x) for w in gone for x in out.values() if w in x]
    shape = lambda k: out[k].split()
    assert [len(shape(k)) for k in (0, 1, 3, 4)] == [4, 4, 6, 6] and shape(3)[:2] == ["Dr.", "med."] and shape(3)[4:] == ["rief", "an"]
    assert shape(2)[1] == shape(2)[3] and shape(4)[:3] == ["Mrs.", "van", "der"] and shape(4)[3] == shape(4)[5]
    assert shape(5)[:2] == ["Prof.", "Dr."] and shape(5)[3] == "von" and shape(5)[5] == "schrieb"
    assert len({shape(k)[2] for k in (0, 1, 6, 10)}) == 1 and len({out[k] for k in (0, 1, 6, 10)}) == 4
    assert out[7][4:].split()[0] == "0044" and out[7].replace("0044", "+44") == out[8] and len(out[9]) == len(texts[9]) and out[9].startswith("Authorization: Bearer eyJ")


def test_many_people_settle_and_stay_distinct(spark, monkeypatch):
    """Brute force over detected mentions: one surrogate for each entity, no two alike, none an original, all else as it was."""
    import regex

    calls, real = [], pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda *a: (calls.append(a[-1]), real(*a))[1])
    r = random.Random(4)
    name = lambda k, first, rest: first[k % len(first)] + "".join(rest[(k // len(first) ** (j + 1)) % len(rest)] for j in range(3))
    latin, cyrillic = [name(k, "ABCDEFGHIJKLM", "aeioulmnrs") for k in range(5_000)], [name(k, "АБВГДЕЖЗИК", "аеиоулмнр") for k in range(500)]
    rows = [f"{sentence(k, 5)} Mr {x} {sentence(k + 9, 3)} {r.choice(['+1 202 555 0', '+44-20-7946-0'])}{k % 1000:03d}" for k, x in enumerate(latin)] + [f"вчера г-н {x} был" for x in cyrillic]
    rows += [f"Mr {g} Smith and mail u{k}@h{k % 7}.example.org" for k, g in enumerate(["Aaron", "Bert", "Cato", "Dino", "Emil"] * 30)]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    got = {g["doc_id"]: g["text"] for g in collect(pii.pseudonymise(df, "k"))}
    pattern = regex.compile(pii.PATTERN.replace(r"\x{A0}", "\xa0"))
    mapped, back = {}, {}
    for k, text in enumerate(rows):
        old, new = [m[0] for m in pattern.finditer(text)], [m[0] for m in pattern.finditer(got[k])]
        assert len(old) == len(new) and pattern.split(text) == pattern.split(got[k])
        for x, y in zip(old, new, strict=True):
            assert mapped.setdefault(x, y) == y and back.setdefault(y, x) == x and y not in rows
    assert not set(back) & set(mapped)
    assert max(calls) <= 4


# ---- mixing ----


def test_mixing(spark):
    r, rows = random.Random(4), []
    for k in range(3_000):
        rows.append((k, sentence(k, r.randint(5, 60)), r.choices(["en", "de", None], [8, 1, 1])[0], f"src{min(int(r.expovariate(0.5)), 9)}"))
    rows += [(5_000, None, "en", "src0"), (5_001, "", None, None), (5_002, "a b c", "xx", "lone")]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, lang string, source string, topic string, n_tokens int")
    langs = {"en": 0.5, "de": 0.2}
    got = collect(mixing.mixture(df, languages=langs, topics={}, keep_share=0.05))
    assert len(got) == len(rows)
    mass = {}
    for g in got:
        mass[g["lang"]] = mass.get(g["lang"], 0) + g["n_tokens"] * g["probability"]
    total = sum(mass.values())
    assert abs(mass["en"] / total - 0.5) < 0.03 and abs(mass["de"] / total - 0.2) < 0.03
    assert abs(total / sum(g["n_tokens"] for g in got) - 0.05) < 1e-6
    sampled = sum(g["n_tokens"] for g in got if g["sampled"])
    assert abs(sampled / total - 1) < 0.3
    kept = mixing.sample_mixture(df)
    assert kept.columns == [*df.columns, "mix_topic", "mix_n_tokens", "sampling_probability"]
    assert mixing.mixture(df.limit(0)).count() == 0


def test_raking_meets_both_marginals(spark):
    cells = spark.createDataFrame([("a", "x", 30), ("a", "y", 10), ("b", "x", 20), ("b", "y", 40), ("c", "y", 0)], "source string, lang string, tokens long")
    shares = {"source": spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.0)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "lang string, share double")}
    for raked in (mixing.rake, mixing.rake_rows):
        got = collect(raked(cells, shares, tolerance=1e-8))
        assert len(got) == 5
        assert abs(sum(g["w"] for g in got if g["source"] == "a") - 0.7) < 1e-6 and abs(sum(g["w"] for g in got if g["lang"] == "x") - 0.2) < 1e-6


# ---- decontamination ----


def scores(index, query):
    """Brute force: the score of every item."""
    want = {}
    for t in query:
        for item, x in zip(*index.postings.get(t, ((), ())), strict=True):
            want[item] = want.get(item, 0) + x
    return want


def test_search_equals_scoring_every_item():
    items = [(k, sentence(k, 15 + k % 40)) for k in range(150)]
    for threshold in (0.15, 0.3, 0.6):
        shard = decontam.Shard(items, threshold)
        assert [i.half for i in shard.indexes] == [16, 32, 64] and sum(len(i.items) for i in shard.indexes) == 150
        for seed in range(40):
            words = set(decontam.tokens(sentence(1_000 + seed, 80) + (" " + items[seed][1] if seed % 2 else "")))
            query = sorted(shard.lookup.terms[w] for w in words if w in shard.lookup.terms)
            for index in shard.indexes:
                want, got = scores(index, query), dict(index.search(query))
                assert got.keys() == {i for i, x in want.items() if x >= threshold - 1e-9}
                assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_no_passage_that_can_match_is_left_out():
    import numpy as np

    items = [(k, sentence(k, 15 + k % 40)) for k in range(150)]
    shard, r = decontam.Shard(items, 0.5), random.Random(3)
    for seed in range(30):
        text = " ".join(sentence(2_000 + 10 * seed + j, r.randint(0, 90)) + " " + (items[r.randrange(150)][1] if r.random() < 0.7 else "") for j in range(r.randint(1, 8)))
        every = np.array([t for run in text.split() for t in shard.lookup[run]])
        for index in shard.indexes:
            halves = -(-len(every) // index.half)
            want = set()
            for k in range(max(1, halves - 1)):
                terms = {t for t in every[k * index.half : (k + 2) * index.half].tolist() if t >= 0}
                want.update((k, i) for i, x in scores(index, terms).items() if x >= 0.5)
            for most in (2_000_000, 20):
                got = [(k, i) for k, query in index.passages(every, most) for i, _ in index.search(query)]
                assert len(got) == len(set(got)) and set(got) == want


def test_contaminated(spark):
    items = [(k, sentence(500 + k, 20) + ". " + sentence(700 + k, 8) + ".") for k in range(30)] + [(90, None), (91, ""), (92, "?!"), (3, sentence(503, 20) + ". " + sentence(703, 8) + ".")]
    rows = [(k, sentence(k, 200)) for k in range(40)]
    rows += [(100, sentence(1, 90) + " " + items[4][1].upper() + " " + sentence(2, 90)), (101, items[5][1].replace(" ", " | ")), (102, None), (103, ""), (104, sentence(9, 9_000) + " " + items[3][1])]
    words = items[6][1].split(" ")
    rows += [(105, " ".join(["changed", *words[1:12], "here", *words[13:]])), (None, items[7][1]), (106, items[8][1].split(". ")[0])]
    rows += [(107, items[9][1].replace(items[9][1].split()[-2], "altered"))]  # within the answer
    docs = spark.createDataFrame([(*r, "i", 1.0) for r in rows], "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    for shard in (20_000, 7):
        seen.append(sorted((str(g["doc_id"]), g["item_id"], round(g["score"], 9)) for g in collect(decontam.contaminated(docs, bench, shard_items=shard))))
        assert seen[0] == seen[-1]  # scores don't depend on the split
        got = {(g["doc_id"], g["item_id"]) for g in collect(decontam.contaminated(docs, bench, shard_items=shard))}
        assert got == {(100, 4), (101, 5), (104, 3), (105, 6), (107, 9), (None, 7)}
    for shard in (20_000, 7):
        kept = decontam.drop_contaminated(docs, bench, shard_items=shard)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(40), 102, 103, 106}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_texts_vote_once(spark, monkeypatch):
    """Each text is turned into features once for its votes; the fit and the scores read what was written."""
    docs = spark.createDataFrame([(k, f"you idiot {k}" if k % 3 == 0 else f"a fine day {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    scorer, voted = toxicity.fit(docs, labels)
    rows = {r.id: r for r in voted.collect()}
    assert set(rows) == set(range(60))
    assert all(sorted(rows[r.doc_id].columns) == sorted(scorer.columns_of(r.text)[0]) for r in docs.collect())
