"""Entries of large JSON documents, read in parts.

A JSON object or list that fills a file would be one row, read by one task. Here the file is read
as text cut at commas, so that Spark deals its byte ranges to tasks, and a range is read
without knowing what stands before it: its effect on quotes, depth and counts is
summed up for both cases, inside and outside a string; the driver strings these few numbers per
range together, and a second pass cuts the ranges into entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import materialize

_STRING_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}\[\],]', re.DOTALL)


class Scan:
    """Brackets and commas outside strings, over text that comes in parts."""

    def __init__(self, inside: bool):
        self.inside = inside

    def marks(self, text: str) -> Iterator[tuple[int, str]]:
        at = 0
        if self.inside:
            rest = _STRING_REST.match(text)
            if rest is None:
                return
            at, self.inside = rest.end(), False
        for token in _TOKEN.finditer(text, at):
            mark = token.group()
            if mark[0] != '"':
                yield token.start(), mark
            elif not token.group(1):
                self.inside = True


@dataclass
class Effect:
    """What a range does, with depths counted from where it starts."""

    inside: bool
    depth: int = 0
    opened: Counter = field(default_factory=Counter)  # containers opened, by the depth inside them
    commas: Counter = field(default_factory=Counter)  # commas at a depth
    latest: Counter = field(default_factory=Counter)  # commas at a depth since a container was last opened to it

    def read(self, scan: Scan, text: str) -> None:
        for _, mark in scan.marks(text):
            if mark in "{[":
                self.depth += 1
                self.opened[self.depth] += 1
                self.latest[self.depth] = 0
            elif mark in "}]":
                self.depth -= 1
            else:
                self.commas[self.depth] += 1
                self.latest[self.depth] += 1
        self.inside = scan.inside


@dataclass(frozen=True)
class Start:
    """Where a range begins: in a string or not, depth, and number of the container and entry at the wanted depth."""

    inside: bool = False
    depth: int = 0
    parent: int = -1
    entry: int = 0

    def after(self, effect: Effect, wanted: int) -> Start:
        at = wanted - self.depth
        opened = effect.opened[at]
        entry = effect.latest[at] if opened else self.entry + effect.commas[at]
        return Start(effect.inside, self.depth + effect.depth, self.parent + opened, entry)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, str]]:
    """(file, start of the range, whether the text opens the range, text) of pieces that were cut at commas."""
    last = None
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in range(3))
        at = 0
        while at < len(values):
            own = (files[at], starts[at])
            to = at
            while to < len(values) and (files[to], starts[to]) == own:
                to += 1
            text = ",".join(values[at:to])
            # a comma stands before every piece but the first of a file
            first = own != last
            yield *own, first, text if first and own[1] == 0 else "," + text
            last, at = own, to


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep=",").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


_COUNTS = "map<int,bigint>"
_EFFECT = f"file string, block bigint, case boolean, inside boolean, depth int, opened {_COUNTS}, commas {_COUNTS}, latest {_COUNTS}, opener string"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[tuple[Scan, Effect]]] = {}
    openers: dict[tuple[str, int], str] = {}
    for file, block, first, text in _ranges(batches):
        if first:
            held[file, block] = [(Scan(case), Effect(case)) for case in (False, True)]
            openers[file, block] = text.lstrip("\ufeff \t\r\n")[:1]
        for scan, effect in held[file, block]:
            effect.read(scan, text)
    rows = [
        (*own, bool(case), e.inside, e.depth, *([(k, v) for k, v in c.items()] for c in (e.opened, e.commas, e.latest)), openers[own])
        for own, both in held.items() for case, (_, e) in enumerate(both)
    ]
    counts = pa.map_(pa.int32(), pa.int64())
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), counts, counts, counts, pa.string()]
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", _EFFECT)]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _starts(spark: SparkSession, path: str, depths: dict[str, int]) -> dict[tuple[str, int], tuple[Start, int, str]]:
    """Start, wanted depth and outermost bracket of every range of the files whose outermost bracket is in ``depths``; a few numbers a range reach the driver."""
    by_file: dict[str, dict[int, list]] = {}
    for r in _pieces(spark, path).mapInArrow(_effects, _EFFECT).collect():
        effect = Effect(r["inside"], r["depth"], *(Counter(r[c]) for c in ("opened", "commas", "latest")))
        by_file.setdefault(r["file"], {}).setdefault(r["block"], [None, None, r["opener"]])[int(r["case"])] = effect
    out = {}
    for file, blocks in by_file.items():
        opener = blocks[min(blocks)][2]
        wanted = depths.get(opener)
        if wanted is None:
            continue
        start = Start()
        for block in sorted(blocks):
            out[file, block] = (start, wanted, opener)
            start = start.after(blocks[block][int(start.inside)], wanted)
        if start.inside or start.depth:
            raise ValueError(f"{file} ends inside a string or a container")
    return out


def json_entries(spark: SparkSession, path: str, depths: dict[str, int]) -> DataFrame:
    """(file, opener, parent, entry, header, text): entries of JSON containers, in order of (parent, entry).

    ``depths`` says for files that are an object ('{') and for files that are a list ('[') at which
    depth entries are cut, 1 for those of the outermost container; files of the other kind are left out. ``parent`` numbers
    the containers at that depth, and ``header`` is what stands before one,
    such as the key of an object inside an object (empty at depth 1). ``text`` is the entry
    as it stands, with its key in an object. Entries that pass the end of a range are put together by
    one shuffle of these parts alone. Empty containers have no entry.
    """
    starts = _starts(spark, path, depths)
    shared = spark.sparkContext.broadcast(starts)  # one row a range
    names = ["file", "opener", "parent", "entry", "block", "header", "whole", "text"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        rows: list[tuple] = []
        own: tuple[str, int] | None = None
        opener = ""
        scan, depth, parent, entry, wanted = Scan(False), 0, -1, 0, 0
        header: list[str] = []
        body: list[str] = []
        opened = {"header": False, "body": False}  # whether the part in hand began in this range

        def give(kind: str, parts: list[str], whole: bool) -> None:
            text = "".join(parts)
            if text.strip() or not whole:
                head = kind == "header"
                rows.append((own[0], opener, parent + head, 0 if head else entry, own[1], head, whole, text))
            parts.clear()

        def leave() -> None:
            """The range ends within a part."""
            if depth >= wanted:
                give("body", body, False)
            elif depth == wanted - 1:
                give("header", header, False)

        for file, block, first, text in _ranges(batches):
            if (file, block) not in starts:
                continue
            if first:
                if own is not None:
                    leave()
                own = (file, block)
                start, wanted, opener = starts[own]
                scan, depth, parent, entry = Scan(start.inside), start.depth, start.parent, start.entry
                header, body, opened = [], [], {"header": start == Start(), "body": False}
            at = 0
            for place, mark in scan.marks(text):
                if mark in "{[":
                    depth += 1
                    if depth == wanted:
                        header.append(text[at:place])
                        give("header", header, opened["header"])
                        parent, entry, at, opened["body"] = parent + 1, 0, place + 1, True
                    elif depth == wanted - 1:
                        header, at, opened["header"] = [], place + 1, True
                elif mark in "}]":
                    depth -= 1
                    if depth == wanted - 1:
                        body.append(text[at:place])
                        give("body", body, opened["body"])
                        at, header, opened["header"] = place + 1, [], True
                elif depth == wanted:
                    body.append(text[at:place])
                    give("body", body, opened["body"])
                    entry, at, opened["body"] = entry + 1, place + 1, True
                elif depth == wanted - 1:
                    header, at, opened["header"] = [], place + 1, True
            (body if depth >= wanted else header).append(text[at:])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows.clear()
        if own is not None:
            leave()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "file string, opener string, parent bigint, entry bigint, block bigint, header boolean, whole boolean, text string"
    parts = materialize(_pieces(spark, path).mapInArrow(cut, schema), "parts")
    key = ["file", "opener", "parent", "entry", "header"]
    torn = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = parts.filter("not whole").groupBy(*key).agg(F.array_join(F.transform(torn, lambda p: p["text"]), "").alias("text"))
    every = parts.filter("whole").select(*key, "text").unionByName(joined)
    found = every.filter("not header and trim(text, ' \\t\\r\\n') <> ''").drop("header")
    headers = every.filter("header").select(F.col("file").alias("_f"), F.col("parent").alias("_p"), F.col("text").alias("header"))
    same = (F.col("file") == F.col("_f")) & (F.col("parent") == F.col("_p"))
    return found.join(headers, same, "left").select(
        "file", "opener", "parent", "entry", F.coalesce("header", F.lit("")).alias("header"), "text"
    )


def header_key(header: Column | str) -> Column:
    """The key in a header such as ``"gene": ``."""
    col = F.col(header) if isinstance(header, str) else header
    return F.map_keys(F.from_json(F.concat(F.lit("{"), col, F.lit("null}")), "map<string,string>"))[0]


def object_entry(text: Column | str, value_type: str) -> Column:
    """Struct (key, value) of an entry of an object."""
    col = F.col(text) if isinstance(text, str) else text
    return F.map_entries(F.from_json(F.concat(F.lit("{"), col, F.lit("}")), f"map<string,{value_type}>"))[0]


def list_entry(text: Column | str, value_type: str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.from_json(F.concat(F.lit("["), col, F.lit("]")), f"array<{value_type}>")[0]
