"""CQL2 text and JSON filters as Columns.

Both notations become the same tree of plain lists, ``[op, *args]``, which is then turned into a Column over
named fields. A property that no field has is null, so a comparison with it is never true.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eocatalog.functions import shapes


class FilterError(ValueError):
    """The filter isn't valid CQL2, or holds what isn't supported."""


_TOKEN = re.compile(r"""\s*(?:
    (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<string>'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")+")
  | (?P<name>[A-Za-z_][A-Za-z0-9_:.]*(?:-[A-Za-z0-9_:.]+)*)
  | (?P<sign><>|<=|>=|=|<|>|\(|\)|,|\+|-|\*|/)
)""", re.X)
_COMPARE = {"=", "<>", "<", "<=", ">", ">="}
_GEOMETRIES = {"POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"}
_RESERVED = {"AND", "OR", "NOT", "IS", "NULL", "LIKE", "IN", "BETWEEN"}
_SPATIAL = {"s_intersects", "s_within", "s_contains", "s_disjoint", "s_equals", "s_touches", "s_crosses", "s_overlaps"}
_TEMPORAL = {"t_before", "t_after", "t_during", "t_equals", "t_intersects"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected {text[at:at + 10]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class _Parser:
    """Precedence climbing over tokens: OR, AND, NOT, comparison, sums, products, signs."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise FilterError(f"expected {wanted}")

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise FilterError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        parts = [self.both()]
        while self.take("OR"):
            parts.append(self.both())
        return ["or", *parts] if len(parts) > 1 else parts[0]

    def both(self):
        parts = [self.negated()]
        while self.take("AND"):
            parts.append(self.negated())
        return ["and", *parts] if len(parts) > 1 else parts[0]

    def negated(self):
        return ["not", self.negated()] if self.take("NOT") else self.compared()

    def compared(self):
        left = self.sum()
        if self.peek() in _COMPARE:
            op = self.tokens[self.at][1]
            self.at += 1
            return [op, left, self.sum()]
        if self.take("IS"):
            tree = ["not", ["isNull", left]] if self.take("NOT") else ["isNull", left]
            self.need("NULL")
            return tree
        no = self.take("NOT")
        if self.take("BETWEEN"):
            low = self.sum()
            self.need("AND")
            tree = ["between", left, low, self.sum()]
        elif self.take("LIKE"):
            tree = ["like", left, self.sum()]
        elif self.take("IN"):
            self.need("(")
            tree = ["in", left, self.listed()]
        elif no:
            raise FilterError("expected BETWEEN, LIKE or IN after NOT")
        else:
            return left
        return ["not", tree] if no else tree

    def listed(self) -> list:
        out = []
        if not self.take(")"):
            out.append(self.either())
            while self.take(","):
                out.append(self.either())
            self.need(")")
        return out

    def sum(self):
        left = self.product()
        while self.peek() in ("+", "-"):
            op = self.peek()
            self.at += 1
            left = [op, left, self.product()]
        return left

    def product(self):
        left = self.one()
        while self.peek() in ("*", "/"):
            op = self.peek()
            self.at += 1
            left = [op, left, self.one()]
        return left

    def one(self):
        if self.at >= len(self.tokens):
            raise FilterError("the filter ends too soon")
        if self.take("-"):
            return ["*", -1, self.one()]
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return float(text) if re.search("[.eE]", text) else int(text)
        if kind == "string":
            return text[1:-1].replace("''", "'")
        if kind == "quoted":
            return {"property": text[1:-1].replace('""', '"')}
        if kind != "name":
            raise FilterError(f"unexpected {text!r}")
        upper = text.upper()
        if upper in _RESERVED:
            raise FilterError(f"unexpected {text!r}")
        if upper in ("TRUE", "FALSE"):
            return upper == "TRUE"
        if upper in _GEOMETRIES and self.peek() in ("(", "Z"):
            return {"shape": self.geometry(upper)}
        if self.take("("):
            args = self.listed()
            if upper in ("DATE", "TIMESTAMP"):
                return {upper.lower(): args[0]}
            if upper == "INTERVAL":
                return {"interval": args}
            if upper == "BBOX":
                return {"shape": shapes.box(*(a if not isinstance(a, list) else -a[2] for a in args))}
            return [text.lower(), *args]
        return {"property": text}

    def geometry(self, kind: str):
        """The numbers of a geometry in well-known text, nested as in GeoJSON."""
        depth, words = 0, []
        self.take("Z")
        while True:
            if self.at >= len(self.tokens):
                raise FilterError("the geometry ends too soon")
            text = self.tokens[self.at][1]
            self.at += 1
            depth += (text == "(") - (text == ")")
            words.append(text)
            if not depth:
                break
        return shapes.from_wkt(kind + " " + " ".join(words).replace("- ", "-"))


def parse_text(text: str):
    return _Parser(text).whole()


def parse_json(doc):
    """The tree of a CQL2 JSON filter, given as text or parsed."""
    return _json_tree(json.loads(doc) if isinstance(doc, str) else doc)


def _json_tree(doc):
    if isinstance(doc, list):
        return [_json_tree(x) for x in doc]
    if not isinstance(doc, dict):
        return doc
    if "property" in doc or "date" in doc or "timestamp" in doc or "interval" in doc:
        return doc
    if "op" in doc:
        op, args = doc["op"], doc.get("args", [])
        names = {"neq": "<>", "!=": "<>", "eq": "=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
        return [names.get(op, op), *[_json_tree(a) for a in args]]
    if "coordinates" in doc or "geometries" in doc:
        return {"shape": doc}
    if "bbox" in doc:
        return {"shape": shapes.box(*doc["bbox"])}
    raise FilterError(f"not a CQL2 expression: {doc!r}")


def parse(filter_, lang: str | None = None):
    """Text by default for text, JSON for objects; a language that doesn't fit is an error."""
    found = "cql2-text" if isinstance(filter_, str) and not filter_.lstrip().startswith("{") else "cql2-json"
    if lang not in (None, found) and not (lang == "cql2-text" and isinstance(filter_, str)):
        raise FilterError(f"expected {lang}")
    return parse_json(filter_) if found == "cql2-json" else parse_text(filter_)


def strip_prefixes(filter_: str) -> str:
    """Fields may be named as below an item or its properties."""
    return filter_.replace("item.", "").replace("properties.", "")


class Compiler:
    """Trees to Columns. fields: name to Column; bounds: the four Columns of a footprint's bounding box."""

    def __init__(self, fields: dict[str, Column], bounds: tuple[Column, Column, Column, Column] | None = None, exact: Callable[[str, dict], Column] | None = None):
        self.fields, self.bounds, self.exact = fields, bounds, exact
        self.used: set[str] = set()

    def value(self, node) -> Column:
        if isinstance(node, list):
            return self.column(node)
        if not isinstance(node, dict):
            return F.lit(node)
        if "property" in node:
            name = strip_prefixes(node["property"])
            self.used.add(name)
            return self.fields.get(name, F.lit(None))
        if "date" in node:
            return F.lit(dt.date.fromisoformat(node["date"]))
        if "timestamp" in node:
            return F.lit(_utc(node["timestamp"])).cast("timestamp_ntz")
        raise FilterError(f"no value: {node!r}")

    def column(self, tree) -> Column:
        if not isinstance(tree, list):
            return self.value(tree)
        op, *args = tree
        low = op.lower()
        if low in ("and", "or"):
            out = self.column(args[0])
            for a in args[1:]:
                out = out & self.column(a) if low == "and" else out | self.column(a)
            return out
        if low == "not":
            return ~self.column(args[0])
        if low == "isnull":
            return self.value(args[0]).isNull()
        if low in _SPATIAL:
            return self.spatial(low, *args)
        if low in _TEMPORAL:
            return self.temporal(low, *args)
        if low == "in":
            return self.value(args[0]).isin([a for a in args[1]])
        if low == "between":
            bounds = args[1:] if len(args) == 3 else args[1]
            return self.value(args[0]).between(self.value(bounds[0]), self.value(bounds[1]))
        if low == "like":
            return self.value(args[0]).like(args[1])
        if low in ("casei", "accenti"):
            return F.lower(self.value(args[0]))
        if op in _COMPARE:
            a, b = self._alike(*args)
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op in ("+", "-", "*", "/"):
            a, b = self.value(args[0]), self.value(args[1])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]()
        raise FilterError(f"not supported: {op}")

    def _alike(self, a, b) -> tuple[Column, Column]:
        """A number beside a text field is compared as a number; what isn't one is null."""
        x, y = self.value(a), self.value(b)
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        if number(b):
            x = x.try_cast("double")
        if number(a):
            y = y.try_cast("double")
        return x, y

    def temporal(self, op: str, a, b) -> Column:
        x = self.value(a)
        if isinstance(b, dict) and "interval" in b:
            low, high = b["interval"]
            begin = None if low == ".." else self.value({"timestamp": low} if isinstance(low, str) else low)
            end = None if high == ".." else self.value({"timestamp": high} if isinstance(high, str) else high)
        else:
            begin = end = self.value(b)
        if op == "t_before":
            return x < begin
        if op == "t_after":
            return x > end
        if op == "t_equals":
            return x == begin
        inside = F.lit(True)
        if begin is not None:
            inside = inside & ((x >= begin) if op == "t_intersects" else (x > begin))
        return inside & ((x <= end) if op == "t_intersects" else (x < end)) if end is not None else inside

    def spatial(self, op: str, a, b) -> Column:
        """Bounding boxes that meet are told first; with exact (see spatial.predicate) its answer decides among them.

        Without exact the boxes decide, so s_touches, s_crosses, s_overlaps and s_intersects find all that meet.
        """
        if self.bounds is None:
            raise FilterError("there is no geometry to compare")
        if isinstance(b, dict) and "shape" in b:
            shape = b["shape"]
        else:  # the shape first: what it is within contains it
            shape, op = a["shape"], {"s_within": "s_contains", "s_contains": "s_within"}.get(op, op)
        x0, y0, x1, y1 = (F.lit(float(v)) for v in shapes.envelope(shape))
        own = self.bounds
        meet = (own[0] <= x1) & (own[2] >= x0) & (own[1] <= y1) & (own[3] >= y0)
        if self.exact:
            refined = self.exact(op, shape)
            return ~meet | refined if op == "s_disjoint" else meet & refined
        if op == "s_disjoint":
            return ~meet
        if op == "s_within":
            return (own[0] >= x0) & (own[2] <= x1) & (own[1] >= y0) & (own[3] <= y1)
        if op == "s_contains":
            return (own[0] <= x0) & (own[2] >= x1) & (own[1] <= y0) & (own[3] >= y1)
        if op == "s_equals":
            return (own[0] == x0) & (own[2] == x1) & (own[1] == y0) & (own[3] == y1)
        return meet


def _utc(text: str) -> dt.datetime:
    found = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def compile_filter(filter_, fields: dict[str, Column], bounds=None, lang: str | None = None, exact=None) -> Column:
    try:
        return Compiler(fields, bounds, exact).column(parse(filter_, lang))
    except (KeyError, TypeError, IndexError, ValueError) as error:
        raise error if isinstance(error, FilterError) else FilterError(f"not a valid filter: {error}") from error
