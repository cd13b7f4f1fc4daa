"""Documents as a Spark data source, and files of documents, tables and lines that tasks write side by side.

``spark.read.format("eo-documents")`` reads multi-document YAML and JSON, plain or gzipped, a partition for each file;
writing gives a file for each partition, which takes its name only once all tasks have ended. Paths are what pyarrow's file
systems open (local ones, hdfs, s3, gs); what only Spark's own readers open goes through documents.read_documents.

Documents are written in the order that people read them in: what names a dataset first, its sources last.
"""

from __future__ import annotations

import functools
import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from eocatalog.sources import documents

NAME = "eo-documents"
#: A batch on its way to Spark has at most this many documents, and about this many characters.
BATCH_DOCUMENTS, BATCH_CHARS = 4096, 1 << 23
#: gzip's own choice; Python's, 9, takes a multiple of the time for some percent.
GZIP_LEVEL = 6
#: The order of a document's properties, and of an older document's lineage.
PROPERTY_ORDER = [
    "$schema", "name", "license", "metadata_type", "description", "metadata", "id", "label", "product", "locations", "crs", "geometry", "grids", "properties", "measurements", "accessories",
    "ga_label", "product_type", "product_level", "product_doi", "creation_dt", "size_bytes", "checksum_path", "platform", "instrument", "format", "usgs", "rms_string", "acquisition", "extent",
    "grid_spatial", "gqa", "browse", "image", "lineage", "product_flags",
]
LINEAGE_ORDER = ["algorithm", "machine", "ancillary_quality", "ancillary", "source_datasets"]
#: What the index adds to newer documents for readers of older ones.
COMPATIBILITY = ("grid_spatial", "extent")


_PLACES = {tuple(order): {k: i for i, k in enumerate(order)} for order in (PROPERTY_ORDER, LINEAGE_ORDER)}


def _by(order: list[str], doc: dict) -> dict:
    """Keys in an order, others after them as they were."""
    place, last = _PLACES[tuple(order)], len(order)
    return {k: doc[k] for k in sorted(doc, key=lambda k: place.get(k, last))}


def is_newer(doc: dict) -> bool:
    return "eo3" in str(doc.get("$schema") or "")


def ordered(doc: dict, locations: list[str] | None = None) -> dict:
    """A document for display: in order, embedded ones too. A newer one without what was added for older readers, its lineage as ids.

    locations are put in as ``location`` if there is one, else as ``locations``.
    """
    out = dict(doc)
    if locations is not None:
        out |= {"location": locations[0]} if len(locations) == 1 else {"locations": locations}
    lineage = out.get("lineage")
    sources = lineage.get("source_datasets") if isinstance(lineage, dict) else None
    if is_newer(out):
        out = {k: v for k, v in out.items() if k not in COMPATIBILITY}
        if isinstance(sources, dict):
            out["lineage"] = {kind: [source["id"]] for kind, source in sources.items()}
        return _by(PROPERTY_ORDER, out)
    if isinstance(lineage, dict):
        own = _by(LINEAGE_ORDER, lineage)
        if isinstance(sources, dict):
            own["source_datasets"] = {kind: ordered(source) for kind, source in sources.items()}
        out["lineage"] = own
    if isinstance(out.get("metadata"), dict):
        out["metadata"] = ordered(out["metadata"])
    return _by(PROPERTY_ORDER, out)


def header(doc: dict, url: str | None = None) -> str:
    """Comment lines above a document: what it is, and where it is from."""
    said = ([] if is_newer(doc) else ["EO1 Dataset"]) + ([f"url: {url}"] if url else [])
    return "".join(f"# {x}\n" for x in said)


@functools.cache
def _library():
    """The library's dumper and its emitter, which is asked how a text may be written."""
    import yaml

    class Dumper(yaml.SafeDumper):
        def ignore_aliases(self, data):
            return True

    Dumper.add_representer(float, lambda dumper, value: dumper.represent_scalar("tag:yaml.org,2002:float", _float(value)))
    return Dumper, yaml.emitter.Emitter(io.StringIO(), allow_unicode=True)


def _float(value: float) -> str:
    text = repr(value)
    if "n" in text:  # inf, nan
        return text.replace("inf", ".inf").replace("nan", ".nan")
    return text.replace("e", ".0e") if "e" in text and "." not in text else text


class _Unusual(Exception):
    """The library has to write this document."""


#: Texts that the library writes plain, or in single quotes where they read as something else than text.
_SAFE = re.compile(r"[A-Za-z0-9_/+$](?:[\w/+.,@=()$-]|:(?!\Z))*", re.ASCII)


@functools.lru_cache(1 << 14)
def _text(text: str) -> str:
    """A text as the library writes it on one line, by its own analysis where it isn't one of the safe ones."""
    dumper, emitter = _library()
    plain = True
    if not _SAFE.fullmatch(text):
        told = emitter.analyze_scalar(text)
        plain = told.allow_block_plain
        if told.multiline or not (plain or told.allow_single_quoted):
            raise _Unusual
    for _, form in dumper.yaml_implicit_resolvers.get(text[:1], ()):
        if form.match(text):
            plain = False
    if plain:
        return text
    if not (_SAFE.fullmatch(text) or told.allow_single_quoted):
        raise _Unusual
    return "'" + text.replace("'", "''") + "'"


@functools.lru_cache(1 << 12)
def _key(text: str) -> str:
    # the library writes others with a question mark
    if not 0 < len(text) < 120:
        raise _Unusual
    return _text(text) + ":"


_WORDS = {None: "null", True: "true", False: "false"}


def _put(head: str, value, deeper: str, beside: str, out: list[str]) -> None:
    """Writes a value after head. Its lines are indented by deeper, those of a list by beside."""
    kind = type(value)
    if kind is str:
        text = _text(value)
        if " " in text and len(head) + 1 + len(text) > 80:
            raise _Unusual  # the library may break it
        out.append(f"{head} {text}\n")
    elif kind is float:
        out.append(f"{head} {_float(value)}\n")
    elif kind is int:
        out.append(f"{head} {value}\n")
    elif kind is dict or kind is list:
        put = _put_keys if kind is dict else _put_items
        if not value:
            out.append(head + (" {}\n" if kind is dict else " []\n"))
        elif head.endswith("-"):
            put(value, head + " ", deeper, out)
        else:
            out.append(head + "\n")
            at = deeper if kind is dict else beside
            put(value, at, at, out)
    elif value is None or kind is bool:
        out.append(f"{head} {_WORDS[value]}\n")
    else:
        raise _Unusual


def _put_keys(doc: dict, first: str, indent: str, out: list[str]) -> None:
    lead = first
    for k, v in doc.items():
        _put(lead + _key(k), v, indent + "  ", indent, out)
        lead = indent


def _put_items(items: list, first: str, indent: str, out: list[str]) -> None:
    lead = first
    for v in items:
        _put(lead + "-", v, indent + "  ", indent + "  ", out)
        lead = indent


def _block(doc: dict) -> str:
    """A document as the library dumps it. What is written over one line or in double quotes is left to the library, which is slow."""
    import yaml

    try:
        if type(doc) is not dict or not doc:
            raise _Unusual
        out: list[str] = []
        _put_keys(doc, "", "", out)
        return "".join(out)
    except (_Unusual, RecursionError, TypeError):
        return yaml.dump(doc, Dumper=_library()[0], sort_keys=False, allow_unicode=True)


def _marked(doc: dict) -> str:
    return "---\n" + _block(doc)


def as_yaml(docs: list[dict]) -> str:
    """Several documents of one file. Floats are told from whole numbers, 1e-10 included, which YAML 1.1 would read as text."""
    return "".join(map(_marked, docs))


def _files(path: str) -> tuple:
    import pyarrow.fs as pfs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pfs.LocalFileSystem(), path
    # the scheme that Hadoop gives S3
    return pfs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DocumentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pfs

        fs, root = _files(self.path)
        info = fs.get_file_info(root)
        if info.type == pfs.FileType.File:
            return [_File(root)]
        listed = fs.get_file_info(pfs.FileSelector(root, recursive=True))
        # what is hidden isn't there yet
        own = [f.path for f in listed if f.type == pfs.FileType.File and not any(p[:1] in "._" for p in f.path[len(root) :].strip("/").split("/"))]
        return [_File(p) for p in sorted(own)]

    def read(self, partition: _File) -> Iterator:
        import pyarrow as pa

        fs, _ = _files(self.path)
        names = ["path", "position", "id", "doc"]
        batch = lambda at, ids, docs: pa.RecordBatch.from_arrays([pa.array([partition.path] * len(ids)), pa.array(range(at, at + len(ids)), pa.int32()), pa.array(ids, pa.string()), pa.array(docs, pa.string())], names)
        at, ids, docs, size = 0, [], [], 0
        with fs.open_input_stream(partition.path, compression=None) as source:
            for d in documents.parsed(source, partition.path):
                ids.append(None if d.get("id") is None else str(d["id"]))
                docs.append(json.dumps(d))
                size += len(docs[-1])
                if len(ids) == BATCH_DOCUMENTS or size > BATCH_CHARS:
                    yield batch(at, ids, docs)
                    at, ids, docs, size = at + len(ids), [], [], 0
        if ids:
            yield batch(at, ids, docs)


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, form: str, compressed: bool, overwrite: bool):
        self.path, self.form, self.compressed, self.overwrite = path, form, compressed, overwrite
        self.job = uuid.uuid4().hex
        fs, root = _files(path)
        fs.create_dir(f"{root}/_{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, root = _files(self.path)
        name = f"{uuid.uuid4().hex}.{self.form}{'.gz' if self.compressed else ''}"
        out = None
        for batch in iterator:
            # a document at a time: parsed ones are many small objects
            put = json.dumps if self.form == "json" else _marked
            texts_ = [put(ordered(json.loads(d))) for d in batch.column("doc").to_pylist() if d is not None]
            if not texts_:
                continue
            if out is None:
                raw = fs.open_output_stream(f"{root}/_{self.job}/{name}", compression=None)
                out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=GZIP_LEVEL) if self.compressed else raw
                first = True
            if self.form == "json":  # one list a file
                out.write((("[" if first else ",\n") + ",\n".join(texts_)).encode())
            else:
                out.write("".join(texts_).encode())
            first = False
        if out is None:
            return _Written(None)
        if self.form == "json":
            out.write(b"]")
        out.close()
        if self.compressed:
            raw.close()
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        import pyarrow.fs as pfs

        fs, root = _files(self.path)
        before = [f.path for f in fs.get_file_info(pfs.FileSelector(root)) if f.type == pfs.FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{root}/_{self.job}/{m.name}", f"{root}/{m.name}")
        for old in before:
            fs.delete_file(old)
        fs.delete_dir(f"{root}/_{self.job}")

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, root = _files(self.path)
        fs.delete_dir(f"{root}/_{self.job}")


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return documents.DOCUMENT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        form = self.options.get("form", "yaml")
        if form not in ("yaml", "json"):
            raise ValueError(f"neither yaml nor json: {form}")
        return DocumentWriter(self.options["path"], form, self.options.get("compression") == "gzip", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, position (in its file), id, doc (JSON) of all documents below path, a partition for each file."""
    register(spark)
    return spark.read.format(NAME).load(path)


def write(docs: DataFrame, path: str, form: str = "yaml", compressed: bool = False, mode: str = "append") -> None:
    """Writes the documents of docs(doc) below path, a file for each partition that has any. A null is no document.

    Writers leave nulls out: a filter here would make the documents of most callers once more.
    """
    register(docs.sparkSession)
    rows = docs.selectExpr("CAST(NULL AS STRING) AS path", "CAST(NULL AS INT) AS position", "CAST(NULL AS STRING) AS id", "doc")
    rows.write.format(NAME).option("form", form).option("compression", "gzip" if compressed else "none").mode(mode).save(path)


def texts(docs: DataFrame, url: str | None = None) -> DataFrame:
    """id, text: documents(id, doc) as they are shown, ordered YAML below its comments. What isn't a document has no text.

    url is the address that a document is shown under, ``{id}`` in it the document's.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for id_, raw in zip(ids, batch.column(1).to_pylist(), strict=True):
                try:
                    doc = json.loads(raw) if raw else None
                except ValueError:
                    doc = None
                shown = isinstance(doc, dict)
                out.append(header(doc, url and url.replace("{id}", str(id_))) + _block(ordered(doc)) if shown else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return docs.select("id", "doc").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text string")
