"""Personal data: detected entities get keyed surrogates of the same type, script, gender and format.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, materialise, salted_join, table

#: Titles by gender, and given names by script and gender. Surrogates are drawn from the names.
TITLES = {
    "m": "Mr Mister Herr Señor Monsieur Sir г-н Господин",
    "f": "Mrs Ms Miss Frau Señora Señorita Madame Mme Mlle Madam г-жа Госпожа",
    "n": "Dr Prof Professor Doctor",
}
#: What may follow a title as its part, and words that stand within names and stay in them.
DEGREES = "med phil rer nat jur ing habil h c"
PARTICLES = "van von der den de del della di da dos du la le ten ter zu zur af bin ibn"
NAMES = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Kevin Brian George Edward Peter Henry Carl Hans Karl Jürgen Klaus Stefan Pierre Jean Louis Michel Jacques Carlos José Luis Miguel Antonio Pedro",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Helen Laura Anna Emma Julia Ursula Monika Sabine Petra Marie Sophie Camille Chloé Isabelle Carmen María Lucía Elena Rosa Pilar",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Людмила",
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης Παναγιώτης Βασίλης Χρήστος",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα",
}
#: Syllables and endings of made-up names: five syllables and an ending give 10^9 family names or more for each script.
CONSONANTS = {"latin": "b c d f g h j k l m n p r s t v w z th br", "cyrillic": "б в г д ж з к л м н п р с т ф х", "greek": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ"}
VOWELS = {"latin": "a e i o u", "cyrillic": "а е и о у", "greek": "α ε ι ο ου"}
FAMILY_ENDINGS = {"latin": "n ler son man ner ston ford well dez rin", "cyrillic": "ов ев ин", "greek": "ος ης ας"}
GIVEN_ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("greek", "m"): "ς", ("greek", "f"): "νη"}
#: From these attempts on, given names are made up, and digits or letters are added where a format has no room left.
MADE_UP, LONGER = 2, 6
#: One title or several, with degrees; titles of one person follow each other.
ONE_TITLE = rf"(?:{'|'.join(w.replace('-', '[-]') for x in TITLES.values() for w in x.split())})\.?[ \x{{A0}}](?:(?:{'|'.join(DEGREES.split())})\.[ \x{{A0}}]?)*"
TITLED = rf"(?:{ONE_TITLE}){{1,3}}"
#: What is detected, in the order in which a place is tried. Passages that match none stay as they are.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)*\.[\p{L}]{2,24}",
    "secret": r"(?=[aAsStTpP])(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[A-Za-z0-9+/_.=-]{8,}",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}.+-])(?:\d{4}[ -]){3}\d{4}(?![\p{L}\p{N}]|-\d)|(?<![\p{L}\p{N}.+-])\d{13,19}(?![\p{L}\p{N}]|-\d)",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.+-])00[1-9]\d{0,2}(?:[ .-]\d{2,4}){2,5}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}-])\d{3}[-.]\d{3}[-.]\d{4}(?![\p{L}\p{N}-])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?=[{''.join(sorted({w[0] for x in TITLES.values() for w in x.split()}))}]){TITLED}(?:(?:\p{{Lu}}\.|{'|'.join(PARTICLES.split())}|\p{{Lu}}[\p{{L}}'’-]+) ){{0,4}}\p{{Lu}}[\p{{L}}'’-]+",
}
#: All patterns begin where no letter or digit stands before; that is tested once, not by each of them.
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
TITLE = rf"^({TITLED})"
SECRET_HEAD = rf"^({PATTERNS['secret'].rsplit('[A-Za-z0-9', 1)[0]})"
#: Country calling codes: of one, two or else three digits.
CALLING_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def kind(value: Column) -> Column:
    """The kind of a mention; a bare name, found because the document names it with a title elsewhere, is a person."""
    out = F.when(F.lit(False), "")
    for name, p in PATTERNS.items():
        out = out.when(value.rlike(f"^(?:{p})$"), "secret" if name == "key" else name)
    return out.otherwise("person")


def number(source: Column, at: int, digits: int = 4) -> Column:
    """The number that some hex digits of source stand for."""
    return F.conv(F.substring(source, at, digits), 16, 10).cast("long")


def pick(words: str, n: Column) -> Column:
    a = words.split()
    return F.element_at(F.array(*map(F.lit, a)), (n % len(a) + 1).cast("int"))


def fill(mask: Column, source: Column, letters: str, alphabet: str) -> Column:
    """mask with each character of the class ``letters`` replaced by one that the hex digits of source choose."""
    lookup = F.split(F.lit(alphabet), "")
    # a place's digits come from the stream turned by its round, so that long values don't repeat in steps of 60
    chosen = lambda i: (F.conv(F.substring(source, (i * 2) % 120 + 1, 2), 16, 10).cast("int") + F.floor(i / 60).cast("int") * 7) % F.lit(len(alphabet)) + 1
    return F.array_join(F.transform(F.split(mask, ""), lambda c, i: F.when(c.rlike(letters), F.element_at(lookup, chosen(i).cast("int"))).otherwise(c)), "")


def stream(key: str, kind_: Column, value: Column, attempt: int) -> Column:
    """128 hex digits of a keyed hash."""
    seed = F.concat_ws("\x1f", F.lit(key), kind_, value, F.lit(str(attempt)))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GREEK, CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшэюя"
#: Character classes and what takes their place: letters of their script and case, digits; letters of other scripts become Latin.
CLASSES = {
    "\\p{N}": "0123456789", "[\\p{IsLatin}&&\\p{Ll}]": LOWER, "[\\p{IsLatin}&&\\p{Lu}]": UPPER, "[\\p{IsCyrillic}&&\\p{Ll}]": CYRILLIC, "[\\p{IsCyrillic}&&\\p{Lu}]": CYRILLIC.upper(),
    "[\\p{IsGreek}&&\\p{Ll}]": GREEK, "[\\p{IsGreek}&&\\p{Lu}]": GREEK.upper(), "[\\p{L}&&[^\\p{IsLatin}\\p{IsCyrillic}\\p{IsGreek}]]": LOWER,
}


def same_format(value: Column, source: Column) -> Column:
    """Letters become letters of their script and case, digits digits; all other characters stay."""
    for letters, alphabet in CLASSES.items():
        value = fill(value, source, letters, alphabet)
    return value


def hex_or_same(value: Column, source: Column) -> Column:
    hexes = fill(fill(fill(value, source, "[0-9]", "0123456789"), source, "[a-f]", "abcdef"), source, "[A-F]", "ABCDEF")
    return F.when(value.rlike("^[0-9a-f]{16,}$") | value.rlike("^[0-9A-F]{16,}$"), hexes).otherwise(same_format(value, source))


def digit_sum(digits: Column) -> Column:
    """The Luhn sum of digits that a check digit will follow."""
    doubled = lambda c: F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN (ISO 7064 modulo 97)."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    left = F.aggregate(F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), step)
    return F.lpad((98 - left).cast("string"), 2, "0")


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def made_up(source: Column, script: str, syllables: int, at: int = 1) -> Column:
    sounds = " ".join(c + v for c in CONSONANTS[script].split() for v in VOWELS[script].split())
    return F.concat(*[pick(sounds, number(source, at + 4 * k)) for k in range(syllables)])


def surrogate(key: str, kind_: Column, value: Column, gender: Column, attempt: int) -> Column:
    """The surrogate of a canonical value; another attempt gives another one."""
    source = stream(key, kind_, value, attempt)
    more = F.lit("") if attempt < LONGER else F.substring(fill(F.lit("0" * 60), source, "0", "0123456789"), 1, attempt - LONGER + 1)
    letters = F.lit("") if attempt < LONGER else F.substring(fill(F.lit("0" * 60), source, "0", LOWER), 1, attempt - LONGER + 1)
    user, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    stem, dot = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    email = F.concat(same_format(user, source), letters, F.lit("@"), same_format(stem, stream(key, F.lit("domain"), domain, 0)), dot)
    fixed = F.regexp_extract(value, "^(AKIA|gh[pousr]_|sk-|eyJ)?", 1)
    secret = F.concat(fixed, hex_or_same(F.substring(value, F.length(fixed) + 1, F.length(value)), source), letters)
    octets = F.concat_ws(".", (number(source, 1) % 223 + 1).cast("string"), *[(number(source, 5 * k) % 256).cast("string") for k in (1, 2, 3)])
    code = F.when(value.startswith("+"), F.concat(F.lit("+"), F.regexp_extract(F.substring(value, F.lit(2), F.length(value)), CALLING_CODE, 1))).otherwise("")
    phone = F.concat(code, fill(F.substring(value, F.length(code) + 1, F.length(value)), source, "[0-9]", "0123456789"), more)
    card = F.concat(F.left(value, F.lit(1)), fill(F.substring(value, F.lit(2), F.length(value) - 2), source, "[0-9]", "0123456789"), more)
    card = F.concat(card, ((10 - digit_sum(card) % 10) % 10).cast("string"))
    ssn = F.concat(F.lpad((number(source, 1) % 665 + 1).cast("string"), 3, "0"), F.lpad((number(source, 5) % 99 + 1).cast("string"), 2, "0"), F.lpad((number(source, 9) % 9999 + 1).cast("string"), 4, "0"))
    bban = F.concat(same_format(F.substring(value, F.lit(5), F.length(value)), source), more)
    iban = F.concat(F.left(value, F.lit(2)), iban_check(F.left(value, F.lit(2)), bban), bban)

    script = script_of(value)
    ending = {s: pick(e, number(source, 40)) for s, e in FAMILY_ENDINGS.items()}
    ending["cyrillic"] = F.concat(ending["cyrillic"], F.when(value.endswith("а"), "а").otherwise(""))
    ending["greek"] = F.when(value.endswith("ου"), "ου").otherwise(ending["greek"])
    family = F.coalesce(*[F.when(script == s, F.concat(made_up(source, s, 4 if s == "latin" else 5), ending[s])) for s in CONSONANTS])
    sex = F.coalesce(gender, F.when(number(source, 60, 1) < 8, "m").otherwise("f"))
    if attempt < MADE_UP:
        given = F.coalesce(*[F.when((script == s) & (sex == g), pick(names, number(source, 1, 12))) for (s, g), names in NAMES.items()])
    else:
        given = F.initcap(F.coalesce(*[F.when((script == s) & (sex == g), F.concat(made_up(source, s, 2 + attempt // 4), F.lit(e))) for (s, g), e in GIVEN_ENDINGS.items()]))
    return (
        F.when(kind_ == "email", email)
        .when(kind_ == "secret", secret)
        .when(kind_ == "ip", octets)
        .when(kind_ == "phone", phone)
        .when(kind_ == "card", card)
        .when(kind_ == "ssn", ssn)
        .when(kind_ == "iban", iban)
        .when(kind_ == "family", F.initcap(family))
        .otherwise(given)
    )


def parts_of(kind_: Column, raw: Column) -> dict[str, Column]:
    """The canonical forms of a mention (value, and given for persons with two names), its head and tail that stay, and gender.

    Mail addresses lose their case, digits their separators, secrets what introduces them, names title, case and a
    genitive ending; so all mentions of one entity meet, whatever their form. The last part is the family name, particles
    before it stay, and all else, initials too, is the given name.
    """
    plain = lambda x: F.lower(F.replace(x, F.lit("’"), F.lit("'")))
    person = kind_ == "person"
    title = F.when(person, F.regexp_extract(raw, TITLE, 1)).otherwise("")
    tail = F.when(person, F.regexp_extract(raw, "(['’]s|['’-]+)$", 1)).otherwise("")
    name = F.split(F.substring(raw, F.length(title) + 1, F.length(raw) - F.length(title) - F.length(tail)), " ")
    family, before = F.element_at(name, -1), F.slice(name, 1, F.size(name) - 1)
    particle = lambda x: x.isin(PARTICLES.split())
    between = F.array_join(F.transform(F.filter(before, particle), lambda x: F.concat(x, F.lit(" "))), "")
    before = F.filter(before, lambda x: ~particle(x))
    given = F.when(F.size(before) > 0, F.array_join(before, " "))
    titled = F.transform(F.split(title, r"[ \x{A0}]"), lambda x: F.regexp_replace(x, r"\.$", ""))
    has = lambda g: F.arrays_overlap(titled, F.array(*map(F.lit, TITLES[g].split())))
    first = F.when(F.size(before) > 0, F.element_at(before, 1))
    known = lambda g: F.coalesce(first.isin([n for (_, h), names in NAMES.items() if h == g for n in names.split()]), F.lit(False))
    secret_head = F.regexp_extract(raw, SECRET_HEAD, 1)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    value = (
        F.when(kind_ == "email", F.lower(raw))
        .when(kind_ == "secret", F.substring(raw, F.length(secret_head) + 1, F.length(raw)))
        .when(kind_ == "phone", F.when(raw.startswith("00"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits)))).otherwise(F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits)))
        .when(kind_.isin("card", "ssn"), digits)
        .when(kind_ == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(person, plain(family))
        .otherwise(raw)
    )
    gender = F.when(has("m"), "m").when(has("f"), "f").when(known("m"), "m").when(known("f"), "f")
    head = F.when(kind_ == "secret", secret_head).otherwise(title)
    return {"value": value, "given": F.when(person, plain(F.concat_ws(" ", given, F.when(given.isNotNull(), family)))), "between": F.when(person, between), "head": head, "tail": tail, "gender": F.when(person, gender)}


def placed_in(raw: Column, digits: Column) -> Column:
    """raw with its letters and digits replaced, in order, by those of a surrogate; what is left over follows."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    taken = lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["text"], F.substring(digits, a["at"], F.lit(1))).alias("text"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at")))
    done = F.aggregate(F.split(raw, ""), start, taken)
    return F.concat(done["text"], F.substring(digits, done["at"], F.length(digits)))


def rendered(kind_: Column, raw: Column, head: Column, tail: Column, named: Column, given: Column, between: Column) -> Column:
    """The mention in its own form: title or introduction, separators and capitals stay."""
    name = F.concat(F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), F.coalesce(between, F.lit("")), named)
    shouted = F.substring(raw, F.length(head) + 1, F.length(raw))
    name = F.when(F.upper(shouted) == shouted, F.upper(name)).otherwise(name)
    bare = F.when(named.startswith("+"), F.substring(named, F.lit(2), F.length(named))).otherwise(named)
    bare = F.when(raw.startswith("00") & named.startswith("+"), F.concat(F.lit("00"), bare)).otherwise(bare)
    return F.when(kind_ == "person", F.concat(head, name, tail)).when(kind_.isin("phone", "card", "ssn", "iban"), placed_in(raw, bare)).otherwise(F.concat(head, named, tail))


def assign(entities: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """(kind, value, n, surrogate) for distinct (kind, value): no two values of a kind share a surrogate, none is a value that occurs.

    ``entities`` has (kind, value, gender, n). All values get their first surrogate; where some collide with each other or
    with an original, all but the smallest (or all) go on to another attempt, until none is left. Each round handles the
    collided ones only. Given names may repeat with other family names.
    """
    clash = F.when(F.col("kind") == "given", F.concat_ws(" ", F.lower("surrogate"), F.substring_index("value", " ", -1))).otherwise(F.lower("surrogate"))
    settled, open_ = None, entities
    taken = entities.select("kind", F.lower("value").alias("clash"))
    for k in range(rounds):
        tried = checkpoint(open_.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("gender"), k)).withColumn("clash", clash))
        winners = tried.groupBy("kind", "clash").agg(F.min_by(F.struct("value", "n", "surrogate"), "value").alias("w")).join(taken, ["kind", "clash"], "left_anti")
        good = checkpoint(winners.select("kind", "clash", "w.*"))
        settled = good if settled is None else settled.union(good)
        open_ = tried.join(good, ["kind", "value"], "left_anti").select("kind", "value", "gender", "n")
        if open_.isEmpty():
            return settled.select("kind", "value", "n", "surrogate")
        open_, taken = checkpoint(open_), taken.union(good.select("kind", "clash"))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates in place of entities, n_entities, kinds (a map of counts).

    Entities are found by PATTERNS; a person's full name or family name is found again without a title anywhere in a
    document that names the person with one. Mentions of one entity get the same surrogate everywhere, whatever their
    title, case and separators (coreference); different entities get different ones, none of which occurs in the corpus
    (distinctness). Family names are replaced one for one, so a name and its family name alone still match. Surrogates
    keep type, script, gender, separators, calling code, and valid check digits of cards and IBANs; where a format has no room
    left for another value, surrogates get longer. The same key gives the same surrogates for the same corpus; without
    it they don't lead back to the originals.

    A name is up to five parts after its titles: initials, particles, names. It is replaced whole: given names and initials
    together by one given name, the last part by a family name; particles stay.

    Text around entities is unchanged. Null text stays null with no entities; an empty text stays empty. Rows that repeat
    an id and text share their result; null ids are handled like any other. Of titles of both genders for one name the
    more frequent counts. Extra columns are not read; an empty table gives no rows.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.concat_ws("|", F.col("id").cast("string"), F.hex(F.xxhash64("id", "text"))))
    found = rows.select("row", "text", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found")).where(F.size("found") > 0)
    names = F.transform(F.filter("found", lambda x: x.rlike(f"^(?:{PATTERNS['person']})$")), lambda x: F.regexp_replace(F.regexp_replace(x, TITLE, ""), "(?:['’]s|['’-]+)$", ""))
    both = F.array_distinct(F.concat(names, F.transform(names, lambda x: F.element_at(F.split(x, " "), -1))))
    longest_first = F.array_join(F.transform(F.sort_array(F.transform(both, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False), lambda x: F.regexp_replace(F.replace(x["x"], F.lit("."), F.lit("[.]")), "['’]", "['’]")), "|")
    again = F.concat(F.lit(rf"{PATTERN}|(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:"), longest_first, F.lit(r")(?![\p{L}\p{N}])"))
    found = found.withColumn("pattern", F.when(F.size(names) > 0, again))
    found = found.select("row", "pattern", F.when(F.col("pattern").isNull(), F.col("found")).otherwise(F.regexp_extract_all(text, F.col("pattern"), F.lit(0))).alias("found"))
    mentions = found.select("row", "pattern", F.posexplode("found").alias("at", "raw")).withColumn("kind", kind(F.col("raw")))
    mentions = mentions.select("*", *[c.alias(n) for n, c in parts_of(F.col("kind"), F.col("raw")).items()])
    # rows with equal id and text share a key, so their mentions are one
    mentions = materialise(mentions.groupBy("row", "at").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("pattern", "raw", "kind", "value", "given", "between", "head", "tail", "gender")]))

    names_of = [F.struct(F.lit(0).alias("part"), F.when(F.col("kind") == "person", "family").otherwise(F.col("kind")).alias("kind"), F.col("value").alias("value"))]
    names_of.append(F.struct(F.lit(1).alias("part"), F.lit("given").alias("kind"), F.col("given").alias("value")))
    wanted = mentions.select("row", "at", "gender", F.explode(F.array(*names_of)).alias("p")).select("row", "at", "gender", "p.*").where("value is not null and value <> ''")
    men, women = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    entities = wanted.groupBy("kind", "value").agg(F.when(men > women, "m").when(women > 0, "f").alias("gender"), F.count("*").alias("n"))
    named = assign(checkpoint(entities), key)
    got = salted_join(wanted.select("row", "at", "part", "kind", "value"), checkpoint(named), ["kind", "value"], "n").groupBy("row", "at").agg(F.max(F.when(F.col("part") == 0, F.col("surrogate"))).alias("named"), F.max(F.when(F.col("part") == 1, F.col("surrogate"))).alias("given_named"))
    shown = mentions.join(got, ["row", "at"]).withColumn("surrogate", rendered(F.col("kind"), F.col("raw"), F.col("head"), F.col("tail"), F.col("named"), F.col("given_named"), F.col("between")))
    placed = checkpoint(shown.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate", "kind"))).alias("s"), F.max("pattern").alias("pattern"), F.max("copies").alias("copies")))
    out = salted_join(rows, placed, ["row"], "copies", "left")
    parts = F.split(text, F.coalesce("pattern", F.lit(PATTERN)), -1)
    filled = F.array_join(F.zip_with(parts, F.col("s.surrogate"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    counts = F.map_from_entries(F.transform(F.array_distinct(F.col("s.kind")), lambda k: F.struct(k, F.size(F.filter(F.col("s.kind"), lambda x: x == k)))))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("s").isNotNull(), filled).otherwise(text).alias("text"),
        F.coalesce(F.size("s"), F.lit(0)).alias("n_entities"),
        F.coalesce(counts, F.create_map().cast("map<string,int>")).alias("kinds"),
    )


#: The key of the query; in production it comes from a secret store.
QUERY_KEY = "feedloom-query-key"


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
    return out.select("doc_id", "text", "n_entities")
