"""Data sources for spark.read.format(): HAR files by ranges of their entries, and paged JSON APIs whose answers are files.

    spark.dataSource.register(HarFiles)
    spark.read.format("har_files").option("path", folder).load()

Paths may carry a scheme that pyarrow's file systems know; each task opens its own files. The rows of HAR files go on to
documents.entry_captures(), so a capture has the same form wherever it comes from.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

ENTRIES = re.compile(r'"entries"\s*:\s*\[')
WAIT = re.compile(r"[\s,]*")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    """The data files at or below path, in order; names that begin with _ or . are no data."""
    system, at = _opened(path)
    top = system.get_file_info(at)
    found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def _text(path: str, like: str) -> str:
    with _opened(like)[0].open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


class Lines(InputPartition):
    """What one task reads: the lines of a file that begin within a range of its bytes."""

    def __init__(self, file: str, low: int, high: int) -> None:
        super().__init__((file, low, high))
        self.file, self.low, self.high = file, low, high


def _ranges(path: str, size: int) -> list[Lines]:
    return [Lines(f.path, at, at + size) for f in _files(path) for at in range(0, f.size, size)]


def _lines(part: Lines, like: str) -> Iterator[str]:
    with _opened(like)[0].open_input_file(part.file) as raw:
        f, at = io.BufferedReader(raw, 1 << 20), max(part.low - 1, 0)
        f.seek(at)
        if part.low:  # the line that the byte before belongs to is another task's
            at += len(f.readline())
        while at < part.high and (line := f.readline()):
            at += len(line)
            yield line.decode("utf-8", "replace").rstrip("\r\n")


class HarParts(InputPartition):
    """What one task reads: (file, which of how many parts of it)."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        super().__init__(tuple(pieces))
        self.pieces = pieces


class HarFiles(DataSource):
    """(file, entry, raw, error): the entries of HAR files, one by one as JSON text; a file that can't be read gives a row with an error.

    Options: path; split_mb (64): small files share a task up to that size, a larger one is dealt to several, each of which decodes and keeps its own run of
    entries and only skips over the text of the others; push_filters (false): equality and IN filters on file choose the files
    before any is read, for which the session must allow spark.sql.python.filterPushdown.enabled. named_lines (false): each line of
    the files is a name, a tab and a HAR document without line breaks; the name stands as file, and files are dealt by ranges of lines.
    """

    @classmethod
    def name(cls) -> str:
        return "har_files"

    def schema(self) -> str:
        return "file string, entry int, raw string, error string"

    def reader(self, schema) -> DataSourceReader:
        kind = FilteredHarReader if self.options.get("push_filters") == "true" else HarReader
        return kind(self.options["path"], float(self.options.get("split_mb", 64)), self.options.get("named_lines") == "true")


class HarReader(DataSourceReader):
    def __init__(self, path: str, split_mb: float, named: bool = False) -> None:
        self.path, self.split, self.named, self.wanted = path, max(1, int(split_mb * 2**20)), named, None

    def partitions(self) -> list[HarParts] | list[Lines]:
        if self.named:
            return _ranges(self.path, self.split)
        out, held = [], 0
        for f in _files(self.path):
            if self.wanted is not None and f.path not in self.wanted:
                continue
            if f.size > self.split:
                parts = -(-f.size // self.split)
                out += [HarParts([(f.path, k, parts)]) for k in range(parts)]
                held = 0
            elif held and held + f.size <= self.split:  # small files share a task
                out[-1].pieces.append((f.path, 0, 1))
                held += f.size
            else:
                out.append(HarParts([(f.path, 0, 1)]))
                held = f.size
        return out

    def read(self, partition: HarParts | Lines) -> Iterator[tuple]:
        if isinstance(partition, Lines):
            for line in _lines(partition, self.path):
                name, _, text = line.partition("\t")
                if self.wanted is None or name in self.wanted:
                    yield from self.entries(name, text, 0, 1)
            return
        for file, part, parts in partition.pieces:
            yield from self.entries(file, _text(file, self.path), part, parts)

    def entries(self, file: str, text: str, part: int, parts: int) -> Iterator[tuple]:
        start = ENTRIES.search(text)
        if not start:
            if part == 0:
                yield file, None, None, "no entries"
            return
        low, high = len(text) * part // parts, len(text) * (part + 1) // parts
        decode, at, k = json.JSONDecoder().raw_decode, WAIT.match(text, start.end()).end(), 0
        while at < high and at < len(text) and text[at] != "]":
            try:
                end = decode(text, at)[1]
            except ValueError:
                if low <= at < high:
                    yield file, None, None, "could not parse"
                return
            if low <= at < high:
                yield file, k, text[at:end], None
            at, k = WAIT.match(text, end).end(), k + 1


class FilteredHarReader(HarReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute == ("file",):
                self.wanted = set(values) if self.wanted is None else self.wanted & set(values)
            else:
                yield f


class Configs(InputPartition):
    def __init__(self, configs: list[dict]) -> None:
        super().__init__(configs)
        self.configs = configs


class PagedFiles(DataSource):
    """(config_id, page_idx, ord, raw, error): the items that paged reads of JSON APIs fetch, in order, by the stop rule.

    Options: configs (JSON lines: config_id, item_path, and where they apply kind page, offset or cursor, start, per_page,
    max_pages, max_items, has_more, total_pages, next_cursor); responses (a folder); page_path, where in it a page is
    (``{config}/{page}.json``), for page numbers, offsets, or cursors (the first page of a cursor is ``start`` or ``first``);
    per_task (64 configs). A page's path may be a folder with one file; a page_path without {page} names a config's JSON
    lines of page and body. In place of configs and responses, lines may name a folder of JSON lines that are each a config with its
    ``pages`` (an object of page and body); tasks read ranges of them (split_mb, 64), so the driver sees no config.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "config_id string, page_idx int, ord int, raw string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def member(data: object, path: str | None) -> object:
    for key in path.split(".") if path else []:
        if isinstance(data, dict):
            data = data.get(key)
        elif isinstance(data, list) and re.fullmatch(r"-?\d+", key) and -len(data) <= int(key) < len(data):
            data = data[int(key)]
        else:
            return None
    return data


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.joined, self.split = options.get("lines"), max(1, int(float(options.get("split_mb", 64)) * 2**20))
        if not self.joined:
            self.folder, self.where = options["responses"].rstrip("/"), options.get("page_path", "{config}/{page}.json")
            self.configs, self.each = options["configs"], int(options.get("per_task", 64))

    def partitions(self) -> list[Configs] | list[Lines]:
        if self.joined:
            return _ranges(self.joined, self.split)
        rows = [json.loads(line) for f in _files(self.configs) for line in _text(f.path, self.configs).splitlines() if line.strip()]
        return [Configs(rows[k : k + self.each]) for k in range(0, len(rows), self.each)]

    def read(self, part: Configs | Lines) -> Iterator[tuple]:
        if isinstance(part, Lines):
            for line in _lines(part, self.joined):
                c = json.loads(line)
                yield from self.items(c, c.get("pages") or {})
            return
        for c in part.configs:
            yield from self.items(c, {} if "{page}" in self.where else self.lines(c["config_id"]))

    def lines(self, config: str) -> dict[str, str]:
        rows = [json.loads(x) for f in _files(f"{self.folder}/{self.where.format(config=config)}") for x in _text(f.path, self.folder).splitlines()]
        return {str(r["page"]): r["body"] for r in rows}

    def page(self, config: str, page: object, kept: dict[str, str]) -> object:
        """The answer for a page, None where there is none or it is no JSON."""
        if not re.fullmatch(r"[\w\-]+", str(page)):
            return None
        found = [] if kept or self.joined else _files(f"{self.folder}/{self.where.format(config=config, page=page)}")
        try:
            return json.loads(kept.get(str(page), "") if kept else _text(found[0].path, self.folder) if found else "")
        except ValueError:
            return None

    def items(self, c: dict, kept: dict[str, str]) -> Iterator[tuple]:
        kind, size, most = c.get("kind") or "page", c.get("per_page"), c.get("max_items") or 250
        at, got = c.get("start", "first" if kind == "cursor" else 1 if kind == "page" else 0), 0
        for k in range(c.get("max_pages") or 1):
            data = self.page(c["config_id"], at, kept) if got < most else None
            items = member(data, c.get("item_path"))
            if not isinstance(items, list) or not items:
                if k == 0:
                    yield c["config_id"], None, None, None, "no items"
                return
            for i, item in enumerate(items):
                if got + i < most and isinstance(item, dict):
                    yield c["config_id"], k, i, json.dumps(item, ensure_ascii=False), None
            got += len(items)
            total = member(data, c.get("total_pages")) if c.get("total_pages") else None
            if c.get("has_more") and not member(data, c["has_more"]) or isinstance(total, int) and total <= k + 1:
                return
            if kind == "cursor":
                at = member(data, c.get("next_cursor") or "next")
                if not at:
                    return
            elif size and len(items) < size:
                return
            else:
                at += 1 if kind == "page" else size or 25
