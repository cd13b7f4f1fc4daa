"""Multi-document YAML and JSON files, plain or gzipped, as rows of JSON text."""

from __future__ import annotations

import functools
import gzip
import io
import itertools
import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

DOCUMENT_SCHEMA = "path string, position int, id string, doc string"


def _plain(value):
    """Dates and times as ISO text, keys as text."""
    import datetime as dt

    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value.isoformat() if isinstance(value, dt.date) else value


def _loader():
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


#: What most lines of a document are: ``key:``, ``key: value``, ``- value`` and ``- key: value``, with values that end on their line.
_QUOTED = r"'[ -&(-~]*'|\"[ !#-\[\]-~]*\""
_INNER = r"(?:[\w/+.,@=()$'~^<>%&*!|?{}\[\]\"`;#-]|:(?=[^ ]))"
_PLAIN = rf"(?:[\w/+.$]|-(?=[\w.])){_INNER}*(?: +(?!#){_INNER}+)*"
_LINE = re.compile(rf"( *)((?:- )*)(?:({_QUOTED}|[A-Za-z_$][\w$./-]*(?::[\w$./-]+)*):(?: ({_QUOTED}|{_PLAIN}|\{{\}}|\[\]))?|({_QUOTED}|{_PLAIN}|\{{\}}|\[\]))", re.ASCII)
_WHOLE = re.compile(r"0|-?[1-9][0-9]*")
_DECIMAL = re.compile(r"-?(?:0|[1-9][0-9]*)\.[0-9]*(?:e[-+][0-9]+)?")
#: Stand for empty collections, of which each document gets its own.
_NO_KEYS, _NO_ITEMS = object(), object()


@functools.lru_cache(1 << 12)
def _key(text: str) -> str:
    if len(text) > 200:
        raise _Unusual
    import yaml

    found = next(iter(yaml.load(f"{text}: 0", Loader=_loader())))
    if not isinstance(found, str):  # 1 and yes are one key
        raise _Unusual
    return found


@functools.lru_cache(1 << 12)
def _loaded(text: str):
    import yaml

    return _plain(yaml.load(text, Loader=_loader()))


@functools.cache
def _forms() -> dict[str, list]:
    return _loader().yaml_implicit_resolvers


def _value(text: str):
    """What a value on one line is, by the library but for texts, whole and decimal numbers."""
    first = text[0]
    if first in "'\"":
        return text[1:-1]
    if first in "{[":
        return _NO_KEYS if first == "{" else _NO_ITEMS
    if not any(form.match(text) for _, form in _forms().get(first, ())):
        return text
    if _WHOLE.fullmatch(text):
        return int(text)
    return float(text) if _DECIMAL.fullmatch(text) else _loaded(text)


class _Unusual(Exception):
    """The library has to read this document."""


@functools.lru_cache(1 << 14)
def _line(line: str) -> tuple:
    """Indent, dashes, key (None without), whether there is a value, value."""
    m = _LINE.fullmatch(line.removesuffix("\n"))
    if m is None:
        raise _Unusual
    indent, dashes, key, of_key, alone = m.groups()
    text = of_key if key is not None else alone
    if key is None and not dashes:
        raise _Unusual
    return len(indent), len(dashes) // 2, None if key is None else _key(key), text is not None, None if text is None else _value(text)


def _fresh(value):
    return {} if value is _NO_KEYS else [] if value is _NO_ITEMS else value


def _simple(lines: list[str]) -> dict | None:
    """The document of lines that are all usual ones."""
    root: dict = {}
    # the innermost open collection and its column, those around it, and its key that has had no value yet
    own, column, stack, held = root, 0, [], None
    for line in lines:
        at, dashes, key, has_value, value = _line(line)
        if held is not None:
            if at > column or (dashes and at == column):
                stack.append((column, own))
                own[held] = new = [] if dashes else {}
                column, own = at, new
            else:
                own[held] = None
            held = None
        # inner collections end; a list may stand at the column of its key
        while column > at or (column == at and not dashes and type(own) is list):
            column, own = stack.pop() if stack else (-1, own)
        if column != at or (type(own) is list) != (dashes > 0):
            raise _Unusual
        for k in range(dashes):
            if key is None and k + 1 == dashes:
                break
            stack.append((column, own))
            own.append(new := {} if k + 1 == dashes else [])
            column, own = column + 2, new
        if key is None:
            own.append(_fresh(value))
        elif has_value:
            own[key] = value if type(value) is str else _fresh(value)
        else:
            held = key
    if held is not None:
        own[held] = None
    return root if lines else None


def _one(lines: list[str], rest: Iterable[str] | None = None) -> Iterator:
    """The documents of lines between two markers; with what follows, if the library has to see that too."""
    try:
        if rest is not None:
            raise _Unusual
        found = [_simple(lines)]
    except _Unusual:
        import yaml

        found = map(_plain, yaml.load_all("".join(itertools.chain(lines, rest or ())), Loader=_loader()))
    return (d for d in found if d is not None)


_MARKER = re.compile(r"---(?=\s|$)")


def _yaml_documents(text: Iterable[str]) -> Iterator:
    """Documents of lines of YAML, one after the other, so that a file of any length takes the memory of one document.

    Most documents are lines of keys and plain values in block style; all others, and all after a directive, an end
    marker or a byte order mark, the library reads.
    """
    lines: list[str] = []
    marker: list[str] = []
    text = iter(text)
    for line in text:
        first = line[:1]
        if first == "-" and _MARKER.match(line):
            if lines:
                yield from _one(lines)
            # a value beside the marker is for the library
            marker, lines = ([line], []) if line == "---\n" else ([], [line])
        elif first == "%" or first == "\ufeff" or (first == "." and line[:3] == "..."):
            yield from _one([*marker, *lines, line], text)
            return
        else:
            lines.append(line)
    if lines:
        yield from _one(lines)


def parsed(source, name: str) -> Iterator:
    """The documents of an open file."""
    source = gzip.GzipFile(fileobj=source) if name.endswith(".gz") else source
    if ".json" in name.rsplit("/", 1)[-1]:
        found = json.loads(source.read().decode())
        yield from (_plain(d) for d in (found if isinstance(found, list) else [found]))
    else:
        yield from _yaml_documents(io.TextIOWrapper(source, encoding="utf-8", newline="\n"))


def parse(raw: bytes, name: str) -> list[dict]:
    """The documents of one file."""
    return list(parsed(io.BytesIO(raw), name))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, position (in its file), id, doc (JSON) of all documents below path, read where the files are."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, i, d.get("id"), json.dumps(d)) for i, d in enumerate(parsed(io.BytesIO(raw), name))]
                yield pd.DataFrame(rows, columns=["path", "position", "id", "doc"])

    return files.mapInPandas(run, DOCUMENT_SCHEMA)


def load_definitions(path: str) -> list[dict]:
    """Metadata types or products of one file, on the driver: definitions are few and small."""
    with open(path, "rb") as f:
        return parse(f.read(), path)
