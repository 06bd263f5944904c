"""XML documents as rows, one for each element; readers are groupings of these rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.scalars import strip

#: Comments and instructions, raw text, end tags, start tags with attributes and all, text.
_TOKEN = re.compile(r"""<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<raw>.*?)\]\]>|<![^>]*>|</\s*(?P<end>[^\s>]+)\s*>|<(?P<tag>[^\s/>!?]++)(?P<attrs>[^<>"']*+(?:(?:"[^"]*"|'[^']*')[^<>"']*+)*+)>|(?P<text>[^<]+)""", re.S)
_ATTR = re.compile(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")

#: Elements in a record batch, about.
BATCH = 5_000

ELEMENTS = dict(doc="string", id="bigint", end="bigint", depth="int", tag="string", parent="string", attrs="map<string,string>", text="string", empty="boolean", fault="string")
#: Those of them that a reader can do without.
MORE = ("end", "depth", "parent", "text", "empty", "fault")

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_ATTRS = list(ELEMENTS).index("attrs")

Attributes = list[tuple[str, str]]
#: Written attributes up to so many characters are remembered, the latest of them.
SHORT, REMEMBERED = 200, 4096
#: Documents up to so many characters are cut into tokens at once.
WHOLE = 1 << 16


def _attributes(written: str) -> Attributes:
    """The first of each name; values keep their entities."""
    return _short_attributes(written) if len(written) <= SHORT else _all_attributes(written)


def _all_attributes(written: str) -> Attributes:
    found: dict[str, str] = {}
    for name, a, b in _ATTR.findall(written):
        found.setdefault(name, a or b)
    return list(found.items())


_short_attributes = lru_cache(REMEMBERED)(_all_attributes)


def _maps(values: list[Attributes | None]) -> pa.MapArray:
    offsets, names, texts = [], [], []
    for pairs in values:
        offsets.append(None if pairs is None else len(names))
        for name, value in pairs or ():
            names.append(name)
            texts.append(value)
    return pa.MapArray.from_arrays(pa.array([*offsets, len(names)], pa.int32()), pa.array(names, pa.string()), pa.array(texts, pa.string()))


def _shared(values: tuple) -> tuple[list, pa.Array]:
    """The objects among ``values``, each once, and which of them each value is."""
    ids = list(map(id, values))
    once = dict(zip(ids, values, strict=True))
    number = dict(zip(once, range(len(once)), strict=True))
    return list(once.values()), pa.array(map(number.__getitem__, ids), pa.int32())


@dataclass(frozen=True)
class Asked:
    """What a reader asks for, by tag: elements that become rows, those named as ancestors, with attributes or
    without, and those whose text is kept. ``local`` drops namespaces from tags, ``more`` are columns to give."""

    rows: frozenset[str]
    near: frozenset[str]
    carried: frozenset[str]
    texts: frozenset[str]
    local: bool
    more: tuple[str, ...] = MORE

    @cached_property
    def columns(self) -> dict[str, str]:
        return {c: kind for c, kind in ELEMENTS.items() if c in self.more or c not in MORE}

    @cached_property
    def places(self) -> dict[str, int]:
        """Ancestors' tags in the order in which a row has them."""
        return {tag: i for i, tag in enumerate(sorted(self.near))}

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {kind}" for c, kind in self.columns.items()) + "".join(f", in_{tag} bigint" + f", of_{tag} map<string,string>" * (tag in self.carried) for tag in self.places)


class _Buffers:
    """Elements as they are closed. Equal attributes and ancestors are mostly one object, written once a batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self, asked: Asked | None = None) -> pa.RecordBatch:
        *plain, above = zip(*self.rows, strict=True) if self.rows else ((),) * (len(ELEMENTS) + 1)
        given = asked.columns if asked else ELEMENTS
        columns = {c: pa.array(x, _ARROW[ELEMENTS[c]]) for c, x in zip(ELEMENTS, plain, strict=True) if c in given and c != "attrs"}
        own, which = _shared(plain[_ATTRS])
        columns["attrs"] = _maps(own).take(which)
        columns = {c: columns[c] for c in given}
        around, which = _shared(above)
        for name, i in asked.places.items() if asked else ():
            nearest = [a[i] or (None, None) for a in around]
            columns[f"in_{name}"] = pa.array([n for n, _ in nearest], pa.int64()).take(which)
            if name in asked.carried:
                columns[f"of_{name}"] = _maps([carried for _, carried in nearest]).take(which)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _tokens(content: str) -> Iterable[tuple[str, ...]]:
    """Raw text, end tag, start tag with its attributes, and text: one of them, the others empty."""
    return _TOKEN.findall(content) if len(content) <= WHOLE else (m.groups("") for m in _TOKEN.finditer(content))


def _read(doc: str, content: str, asked: Asked, out: _Buffers) -> None:
    """Add the elements of a document in the order of their ends; those never closed come last without an end.

    Only open elements are held. Raw text goes to the open elements whose text is kept, other text to the innermost
    two elements, if theirs is.
    """
    stack: list[tuple] = []  # tag, name, the row so far, pieces of text, what was above
    places, add = asked.places, out.rows.append
    nowhere = above = (None,) * len(places)  # by place: id and attributes of the nearest ancestor
    kept: list[list[str]] = []
    started = ended = 0
    for raw, end, tag, written, text in _tokens(content.removeprefix("\ufeff")):
        if tag:
            name = tag.rpartition(":")[2] if asked.local else tag
            empty = written.endswith("/")
            started += 1
            attrs = row = None
            if name in asked.rows or name in asked.carried or not stack:
                attrs = _attributes(written)
            if name in asked.rows or not stack:
                row = (started, len(stack), name, stack[-1][1] if stack else None, attrs)
            if empty:
                ended += 1
                if row:
                    add((doc, started, ended, *row[1:], "", True, None, above))
                continue
            pieces = [] if name in asked.texts else None
            if pieces is not None:
                kept.append(pieces)
            stack.append((tag, name, row, pieces, above))
            if name in places:
                i = places[name]
                above = (*above[:i], (started, attrs if name in asked.carried else None), *above[i + 1 :])
        elif end:
            if not stack or stack[-1][0] != end:
                add((doc, None, None, None, None, None, None, None, None, f"XML parse error: unexpected </{end}>", nowhere))
                return
            ended += 1
            _, name, row, pieces, above = stack.pop()
            if pieces is not None:
                kept.pop()
            if row:
                number, depth, _, parent, attrs = row
                add((doc, number, ended, depth, name, parent, attrs, "".join(pieces) if pieces else "", False, None, above))
        elif text:
            for entry in stack[-2:]:
                if entry[3] is not None:
                    entry[3].append(unescape(text))
        elif raw:
            for pieces in kept:
                pieces.append(raw)
    for _, _, row, pieces, above in stack:
        if row:
            add((doc, row[0], None, *row[1:], "".join(pieces or ()), False, None, above))


def elements(docs: DataFrame, *rows: str, near: tuple = (), carried: tuple = (), texts: tuple = (), local: bool = False, more: tuple = MORE) -> DataFrame:
    """Rows :data:`ELEMENTS` of ``docs (doc, content)``: ``id`` by start, ``end`` by end, text with entities decoded.

    Elements with a tag of ``rows``, and the outermost ones, are given. For each tag of ``near`` or ``carried`` there
    is a column with the id of the nearest ancestor that has it, and for the latter one with its attributes, so that
    no join is needed to look them up. Texts are kept for the tags of ``texts`` and empty elsewhere. Of the columns :data:`MORE`, those of ``more`` are there. A mismatched end tag gives a row with ``fault`` and ends its
    document.
    """
    asked = Asked(frozenset(rows), frozenset(near) | frozenset(carried), frozenset(carried), frozenset(texts), local, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Buffers()
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _read(doc, content.as_py() or "", asked, out)
                if len(out.rows) >= BATCH:
                    yield out.batch(asked)
                    out = _Buffers()
            yield out.batch(asked)

    return docs.select(F.col("doc").cast("string"), "content").mapInArrow(run, asked.schema)


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def number(name: str, kind: str = "int") -> Column:
    """A numeric attribute; null if absent or no number."""
    # what is a number as it stands needs no pattern
    return F.coalesce(attr(name).try_cast(kind), strip(attr(name)).try_cast(kind))


def within(tag: str) -> Column:
    """The id of the nearest enclosing element with a tag."""
    return F.col(f"in_{tag}")


def attr_within(tag: str, name: str) -> Column:
    """An attribute of the nearest enclosing element with a tag, which must be a carried one."""
    return F.col(f"of_{tag}")[name]


def owner(tag: str) -> Column:
    """The element's own id if it has the tag, else that of the nearest enclosing element with it."""
    return F.when(F.col("tag") == tag, F.col("id")).otherwise(within(tag))


def only(tag: str, value: Column) -> Column:
    """In a group of rows: the value of the one element with the tag."""
    return F.first(F.when(F.col("tag") == tag, value), ignorenulls=True)
