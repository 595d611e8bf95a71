"""Atom documents and OPML outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_time, xml_escape


#: How ids of entries without a link begin; a parameter, so that a deployment can keep the ids that its readers know.
ID_PREFIX = "item:"


def entry_id(prefix: str = ID_PREFIX) -> Column:
    """The link, or for items without one the prefix and the first 16 hex digits of the title's SHA-256."""
    return F.when(F.col("link") != "", F.col("link")).otherwise(F.concat(F.lit(prefix), F.substring(F.sha2(F.col("title"), 256), 1, 16)))


def atom_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def element(name: str, c: Column, extra: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{extra}>"), xml_escape(c), F.lit(f"</{name}>"))


def attribute(name: str, c: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), xml_escape(c), F.lit('"'))


def atom_entries(items: DataFrame, *by: str, updated: Column | None = None, prefix: str = ID_PREFIX) -> DataFrame:
    """(by, ord, entry_id, entry): one Atom entry per item; published only where the timestamp is a date, thumbnails not at all.

    ``updated`` (a timestamp) is the entry's updated element, which Atom requires; without it the published time stands there.
    """
    title = F.when(F.col("title") == "", "(untitled)").otherwise(F.col("title"))
    when = parse_time(F.col("timestamp"))
    optional = lambda cond, c: F.when(cond, c).otherwise("")
    changed = F.coalesce(when if updated is None else updated, F.lit("1970-01-01").cast("timestamp"))
    entry = F.concat(
        F.lit("<entry>"), element("id", F.col("entry_id")), element("title", title), F.lit("<updated>"), atom_time(changed), F.lit("</updated>"),
        optional(F.col("link") != "", F.concat(F.lit("<link"), attribute("href", F.col("link")), F.lit("/>"))),
        optional(F.col("content") != "", element("content", F.col("content"), ' type="html"')),
        optional(F.col("author") != "", F.concat(F.lit("<author>"), element("name", F.col("author")), F.lit("</author>"))),
        F.coalesce(F.concat(F.lit("<published>"), atom_time(when), F.lit("</published>")), F.lit("")), F.lit("</entry>"),
    )
    return items.withColumn("entry_id", entry_id(prefix)).select(*by, "ord", "entry_id", entry.alias("entry"))


def atom_documents(entries: DataFrame, by: str, title: str, url: str | None = None, updated: Column | None = None, author: str = "feedloom") -> DataFrame:
    """(by, document): each feed's entries in order, with the id, title, updated, author and link elements that Atom requires.

    ``url`` names the column of the source page; ``updated`` is the time of the scrape.
    """
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "entry"))), lambda e: e["entry"]), "")
    changed = F.coalesce(F.lit(None).cast("timestamp") if updated is None else updated, F.lit("1970-01-01").cast("timestamp"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom">'), element("id", F.concat(F.lit("feed:"), F.col(by).cast("string"))), element("title", F.col(title)),
        F.lit("<updated>"), atom_time(changed), F.lit("</updated><author>"), element("name", F.lit(author)), F.lit("</author>"),
        F.concat(F.lit("<link"), attribute("href", F.coalesce(F.col(url), F.lit(""))), F.lit("/>")) if url else F.lit(""),
    )
    return entries.groupBy(by, title, *[url] * bool(url)).agg(body.alias("__b")).select(by, F.concat(head, "__b", F.lit("</feed>")).alias("document"))


#: The attributes of native outlines, by field; the link's path is the item's unique id as well.
NATIVE = {"item": "Item", "title": "ItemTitle", "link": "ItemUri", "content": "ItemContent", "author": "ItemAuthor", "timestamp": "ItemTimestamp", "thumbnail": "ItemThumbnail"}


def opml_outlines(feeds: DataFrame, native: bool = False) -> DataFrame:
    """(feed_id, outline) for feeds (name, feed_url, source_url, strategy, selectors map) that have a URL.

    Native outlines carry the selectors of XPath feeds (keys: item and the fields), so that a reader scrapes by itself; these
    need a source URL only.
    """
    name = F.when(F.coalesce("name", F.lit("")) == "", "Untitled Feed").otherwise(F.col("name"))
    source = F.coalesce("source_url", F.lit(""))
    line = F.concat(F.lit("<outline"), attribute("text", name), attribute("title", name))
    html = F.when(source != "", attribute("htmlUrl", source)).otherwise("") if native else attribute("htmlUrl", source)
    plain = F.when(F.length("feed_url") > 0, F.concat(line, F.lit(' type="rss"'), attribute("xmlUrl", F.col("feed_url")), html, F.lit("/>")))
    if native:
        of = lambda k: F.coalesce(F.col("selectors")[k], F.lit(""))
        paths = [F.when(of(k) != "", attribute(f"frss:xPath{a}", of(k))).otherwise("") for k, a in NATIVE.items()]
        uid = F.when(of("link") != "", attribute("frss:xPathItemUid", of("link"))).otherwise("")
        xpath = F.concat(line, F.lit(' type="HTML+XPath"'), attribute("xmlUrl", source), attribute("htmlUrl", source), *paths, uid, F.lit("/>"))
        plain = F.when((F.col("strategy") == "xpath") & (of("item") != "") & (source != ""), xpath).otherwise(plain)
    return feeds.select("feed_id", plain.alias("outline")).where("outline is not null")


def opml_documents(outlines: DataFrame, by: list[str], created: Column, title: str = "Saved feeds", native: bool = False) -> DataFrame:
    """(by, document): the outlines of each group, in the order of their feeds, as a whole OPML document."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feed_id", "outline"))), lambda x: x["outline"]), "")
    space = ' xmlns:frss="https://freshrss.org/opml"' if native else ""
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><opml version="2.0"{space}><head>'), element("title", F.lit(title)), F.lit("<dateCreated>"), F.date_format(created, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</dateCreated></head><body>"))
    return outlines.groupBy(*by).agg(body.alias("__b")).select(*by, F.concat(head, "__b", F.lit("</body></opml>")).alias("document"))
