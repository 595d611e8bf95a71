"""Scalar functions as Column expressions, and a few Arrow UDFs for what Catalyst has no function for."""

from __future__ import annotations

import difflib
import html
import json
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .udf import arrow_udf


def key_form(k: Column) -> Column:
    """The form of a JSON key in which roles are looked up."""
    return F.translate(F.lower(k), "- ", "__")


def paging_form(k: Column) -> Column:
    return F.translate(F.lower(k), "-_", "")


def content_type(c: Column) -> Column:
    return F.trim(F.split(F.lower(F.coalesce(c, F.lit(""))), ";")[0])


def feed_type(c: Column) -> Column:
    """json_feed, atom, rss or null, for a normalised content type."""
    return F.when(c.contains("json"), "json_feed").when(c.contains("atom"), "atom").when(c.contains("rss") | c.isin("application/xml", "text/xml"), "rss")


def bucket_key(method: Column, url: Column) -> Column:
    """METHOD scheme://host/path, the key under which captures of one endpoint meet."""
    host = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    return F.concat(F.upper(method), F.lit(" "), F.regexp_extract(url, r"^([^:/?#]+)://", 1), F.lit("://"), host, F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))


def parse_time(text: Column) -> Column:
    """RFC 2822 or ISO text as a timestamp (UTC where no zone is given); null where it is neither."""
    t = F.trim(text)
    rest = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    rfc = F.coalesce(F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm xx")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(t, "Z$", "")))
    return F.coalesce(rfc, iso)


def xml_escape(c: Column) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def confidence(text: Column) -> Column:
    """A confidence in [0, 1]; what is no number counts as 0."""
    return clamp(F.coalesce(text.try_cast("double"), F.lit(0.0)), 0.0, 1.0)


def mask_secret(c: Column) -> Column:
    return F.when(F.length(c) == 0, "").when(F.length(c) <= 12, F.concat(F.lit("…"), F.right(c, F.lit(4)))).otherwise(F.concat(F.left(c, F.lit(4)), F.lit("…"), F.right(c, F.lit(4))))


def is_dated(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(L.DATES))


def without_dates(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + "|".join(L.DATES), "")


def class_id_weight(cls: Column, elem_id: Column) -> Column:
    one = lambda c: F.when(c.rlike(f"(?i){L.POSITIVE}"), 25).otherwise(0) - F.when(c.rlike(f"(?i){L.NEGATIVE}"), 25).otherwise(0)
    return one(F.coalesce(cls, F.lit(""))) + one(F.coalesce(elem_id, F.lit("")))


def is_unlikely(cls: Column, elem_id: Column, role: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(cls, F.lit("")), F.coalesce(elem_id, F.lit("")))
    return F.lower(F.coalesce(role, F.lit(""))).isin(L.UNLIKELY_ROLES) | (both.rlike(f"(?i){L.UNLIKELY}") & ~both.rlike(f"(?i){L.MAYBE}")) | both.rlike(f"(?i){L.TAXONOMY}")


def tag_baseline(tag: Column) -> Column:
    points = F.create_map(*[F.lit(x) for kv in L.TAG_BASELINE.items() for x in kv])
    return F.coalesce(points[F.lower(tag)], F.lit(0))


def is_utility_class(c: Column) -> Column:
    bare = F.regexp_replace(c, L.UTILITY_VARIANT, "")
    prefix = "^(" + "|".join(p for p in L.UTILITY_PREFIXES) + ")"
    return (bare == "") | bare.isin(L.UTILITY_EXACT) | bare.rlike(L.UTILITY_COMPOUND) | bare.rlike(prefix)


def meaningful_classes(cls: Column) -> Column:
    """Classes that are no layout helpers, block-element-modifier names first."""
    kept = F.filter(F.split(F.trim(F.coalesce(cls, F.lit(""))), r"\s+"), lambda c: ~is_utility_class(c))
    bem = lambda c: c.contains("__") | c.contains("--")
    return F.concat(F.filter(kept, bem), F.filter(kept, lambda c: ~bem(c)))


def is_api_like(url: Column) -> Column:
    u = F.lower(url)
    return ~u.rlike(L.API_EXCLUDED) & (u.rlike(L.API_PATHS) | u.rlike(L.API_WORDS))


def is_graphql(url: Column, ctype: Column, body: Column) -> Column:
    query = F.get_json_object(body, "$.query")
    by_body = body.startswith("{") & F.coalesce(query.contains("{") & (query.contains("query") | query.contains("mutation") | query.startswith("{")), F.lit(False))
    return F.lower(url).rlike(r"/graphql/?(\?|$)") | F.coalesce(F.lower(ctype).contains("graphql"), F.lit(False)) | F.coalesce(by_body, F.lit(False))


def operation_name(query: Column) -> Column:
    return F.regexp_extract(query, r"(?:query|mutation|subscription)\s+(\w+)", 1)


def operation_type(query: Column) -> Column:
    found = F.regexp_extract(query, r"^\s*(query|mutation|subscription)\b", 1)
    return F.when(found == "", "query").otherwise(found)


@arrow_udf("string")
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """RFC 3986 resolution; an empty link stays empty."""
    return pd.Series([urljoin(b or "", x) if x else "" for b, x in zip(base, link, strict=True)])


def set_query_param(url: Column, name: Column, value: Column) -> Column:
    """The URL with a query parameter set; of repeated parameters the last stays, in the place of the first."""
    rest, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "(#.*)$", 1)
    base, query = F.substring_index(rest, "?", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1))).otherwise("").alias("v")))
    every = F.concat(pairs, F.array(F.struct(name.alias("k"), value.alias("v"))))
    names = F.array_distinct(F.transform(every, lambda p: p["k"]))
    last = lambda n: F.element_at(F.filter(every, lambda p: p["k"] == n), -1)["v"]
    return F.concat(base, F.lit("?"), F.array_join(F.transform(names, lambda n: F.concat(F.url_encode(n), F.lit("="), F.url_encode(last(n)))), "&"), fragment)


def _set_body(body: str | None, name: str, value: str) -> str | None:
    try:
        data = json.loads(body or "")
    except ValueError:
        return body
    return json.dumps(data | {name: value}) if isinstance(data, dict) else body


@arrow_udf("string")
def set_body_param(body: pd.Series, name: pd.Series, value: pd.Series) -> pd.Series:
    """The JSON object with a member set; what is no JSON object stays as it is."""
    return pd.Series([_set_body(b, n, v) for b, n, v in zip(body, name, value, strict=True)])


_FOLD = str.maketrans({c: to for to, cs in L.SMART_PUNCTUATION.items() for c in cs} | {"…": "..."})


def match_form_of(text: str) -> str:
    plain = html.unescape(text if text.isascii() else unicodedata.normalize("NFKD", text))
    return " ".join((plain if plain.isascii() else plain.translate(_FOLD)).split()).lower()


@arrow_udf("string")
def match_form(text: pd.Series) -> pd.Series:
    """The form in which example texts and page texts are compared."""
    return text.map(lambda t: None if t is None else match_form_of(t))


class Ratio:
    """Ratios of matching blocks; what is known of the second text is kept while it stays the same."""

    def __init__(self) -> None:
        self.matcher = difflib.SequenceMatcher(None, "", "")

    def __call__(self, one: str, other: str, least: float = 0.0) -> float | None:
        """The ratio, or None where the lengths or characters in common rule out that it reaches ``least``."""
        if one == other:
            return 1.0
        if other != self.matcher.b:
            self.matcher.set_seq2(other)
        self.matcher.set_seq1(one)
        if least and (self.matcher.real_quick_ratio() < least or self.matcher.quick_ratio() < least):
            return None
        return self.matcher.ratio()


@arrow_udf("double")
def similarity_from(one: pd.Series, other: pd.Series, least: pd.Series) -> pd.Series:
    """similarity() where it is at least the given one, else null."""
    ratio, found, seen, form = Ratio(), [], None, ""
    for a, b, limit in zip(one, other, least, strict=True):
        if b != seen or not found:
            seen, form = b, match_form_of(b or "")
        r = ratio(match_form_of(a or ""), form, limit)
        found.append(r if r is not None and r >= limit else None)
    return pd.Series(found, dtype="float64")


@arrow_udf("double")
def similarity(one: pd.Series, other: pd.Series) -> pd.Series:
    """Ratio of matching blocks, 0 to 1, of the compared forms."""
    forms = ((match_form_of(a or ""), match_form_of(b or "")) for a, b in zip(one, other, strict=True))
    ratio = Ratio()
    return pd.Series([ratio(a, b) for a, b in forms], dtype="float64")


@arrow_udf("double")
def form_ratio(one: pd.Series, other: pd.Series) -> pd.Series:
    """Ratio of matching blocks, 0 to 1, of two texts that are in their compared form already.

    This is difflib's ratio with its rule for long texts left on: where the second text has 200 characters or more, those
    that make up over a hundredth of it start no block.
    """
    ratio = Ratio()
    return pd.Series([ratio(a, b) for a, b in zip(one, other, strict=True)], dtype="float64")


#: Characters are counted in so many classes by their code; more classes make the bound tighter and wider to carry.
CLASSES = 16


def profile(form: Column) -> Column:
    """What ratio_bound() needs of a compared form: its length and how many of its characters fall in each class."""
    codes = F.transform(F.filter(F.split(form, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    counts = F.transform(F.array(codes), lambda x: F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.size(F.filter(x, lambda c: c == k))))[0]
    return F.struct(F.length(form).alias("n"), counts.alias("counts"))


def ratio_bound(one: Column, other: Column) -> Column:
    """No ratio of two forms exceeds this bound of their profiles: matching blocks hold no character more often than either form,
    and characters of one class are taken as equal. Two empty forms are equal."""
    common = F.aggregate(F.zip_with(one["counts"], other["counts"], lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    length = one["n"] + other["n"]
    return F.when(length == 0, 1.0).otherwise(2.0 * common / length)
