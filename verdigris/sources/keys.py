"""Keys of JSON texts by a structural index: positions of quotes, braces and commas, and prefix sums over them.

Texts are joined and indexed many at a time, as a small text costs little more than its calls do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTE, _BACKSLASH, _COMMA, _BRACE = b'"\\,{'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_MARK = _STEP != 0
_MARK[_COMMA] = True

#: Bytes of texts that are indexed together, about.
TOGETHER = 1 << 20


def _unescaped_quotes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of quotes after an even number of backslashes, none counting twice."""
    quotes = np.flatnonzero(raw == _QUOTE)
    slashes = np.flatnonzero(raw == _BACKSLASH)
    if not len(slashes) or not len(quotes):
        return quotes
    start = np.flatnonzero(np.append(True, np.diff(slashes) != 1))  # of runs of backslashes
    ends = slashes[np.append(start[1:], len(slashes)) - 1]
    length = np.diff(np.append(start, len(slashes)))
    run = np.searchsorted(ends, quotes - 1)
    after = (run < len(ends)) & (ends[np.minimum(run, len(ends) - 1)] == quotes - 1)
    odd = after & (length[np.minimum(run, len(ends) - 1)] % 2 == 1)
    # outside a string a backslash escapes nothing, so a quote there opens one whatever stands before it
    kept = np.cumsum(~odd)
    of = np.searchsorted(starts, quotes, "right") - 1
    first = np.searchsorted(quotes, starts)
    outside = odd & ((kept - np.append(0, kept)[first][of]) % 2 == 0)
    if not outside.any():
        return quotes[~odd]
    good = ~odd
    for i in np.unique(of[outside]).tolist():
        inside = False
        for at in range(first[i], first[i + 1] if i + 1 < len(first) else len(quotes)):
            good[at] = not (inside and odd[at])
            inside ^= bool(good[at])
    return quotes[good]


class Texts:
    """The structure of some texts: the quotes that open strings, and braces, brackets and commas outside strings,
    with depths before them. Depth never falls below 0."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.starts, self.ends = np.append(0, ends)[:-1], ends - 1
        self.quotes = _unescaped_quotes(self.raw, self.starts)
        first = np.searchsorted(self.quotes, self.starts)
        opening = (np.arange(len(self.quotes)) - first[self._of(self.quotes)]) % 2 == 0
        marks = np.flatnonzero(_MARK[self.raw])
        marks = marks[(np.searchsorted(self.quotes, marks) - first[self._of(marks)]) % 2 == 0]
        self.at = np.sort(np.concatenate([self.quotes[opening], marks]))
        self.of, self.kind = self._of(self.at), self.raw[self.at]
        self.step = _STEP[self.kind]
        begin = np.searchsorted(self.of, np.arange(len(texts)))
        total = np.append(0, np.cumsum(self.step, dtype=np.int64))
        total = total[1:] - total[begin][self.of]
        # each text's sums lie below those of the text before, so a running minimum starts anew with a text
        apart = self.of * (2 * len(self.at) + 1)
        depth = total - np.minimum(np.minimum.accumulate(total - apart) + apart, 0)
        self.before = np.append(0, depth)[:-1]
        self.before[begin[begin < len(self.at)]] = 0

    def _of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def keys(self, depth: int, first_object: bool = False) -> pa.ListArray:
        """Each text's keys at a depth of braces and brackets: strings that follow a brace or a comma there.

        With ``first_object`` the scan ends where the first bracket closes.
        """
        wanted = ((self.step == 1) & (self.before == depth - 1)) | (((self.kind == _COMMA) | (self.kind == _QUOTE)) & (self.before == depth))
        if first_object:
            closed, stop = np.flatnonzero((self.step == -1) & (self.before <= 1)), np.full(len(self.starts), len(self.at))
            of, at = np.unique(self.of[closed], return_index=True)
            stop[of] = closed[at]
            wanted &= np.arange(len(self.at)) < stop[self.of]
        events = np.flatnonzero(wanted)
        kind, of = self.kind[events], self.of[events]
        begins = np.append(False, ((kind == _BRACE) | (kind == _COMMA))[:-1])[: len(events)]
        begins[1:] &= of[1:] == of[:-1]
        found = events[(kind == _QUOTE) & begins]
        start, of = self.at[found] + 1, self.of[found]
        close = np.searchsorted(self.quotes, start)
        stop = np.minimum(np.append(self.quotes, len(self.raw))[close], self.ends[of])
        size = stop - start
        offsets = np.append(0, np.cumsum(size))
        held = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
        words = pa.StringArray.from_buffers(len(found), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.raw[held]))
        return pa.ListArray.from_arrays(np.searchsorted(of, np.arange(len(self.starts) + 1)).astype(np.int32), words)


def keys(text: bytes, depth: int, first_object: bool = False) -> list[str]:
    """The same for one text."""
    return Texts([text]).keys(depth, first_object).to_pylist()[0]


def _together(texts: list[bytes]) -> Iterator[list[bytes]]:
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > TOGETHER:
            yield texts[lo:i]
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield texts[lo:]


def both(texts: pa.Array, depth: int) -> pa.StructArray:
    """``top`` and ``deep`` keys of texts, as :func:`scanned` gives them."""
    known, kind = texts.is_valid(), pa.list_(pa.string())
    top, deep = [pa.array([], kind)], [pa.array([], kind)]
    for part in _together([x.encode() for x in texts.filter(known).to_pylist()]):
        index = Texts(part)
        objects = pa.array([t.lstrip(b"\t\n\r ").startswith(b"{") for t in part])
        top.append(pc.if_else(objects, index.keys(1, True), pa.scalar(None, kind)))
        deep.append(index.keys(depth))
    place = pc.if_else(known, pc.subtract(pc.cumulative_sum(known.cast(pa.int32())), 1), None)
    return pa.StructArray.from_arrays([pa.concat_arrays(parts).take(place) for parts in (top, deep)], ["top", "deep"])


@cache
def _scan(depth: int):
    return F.arrow_udf(lambda texts: both(texts, depth), "struct<top: array<string>, deep: array<string>>")


def scanned(text: Column, depth: int = 2) -> Column:
    """``top`` keys of the first object, and the ``deep`` ones at a depth, nulls for a null text.

    Columns over one text are one scan of it, however often they are used in a projection.
    """
    return _scan(depth)(text)
