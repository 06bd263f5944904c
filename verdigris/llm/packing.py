"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two, the longest first, so that a piece
is a whole sequence: no sequence crosses documents and none needs padding. Pieces of equal length
share a bucket, and batches are drawn from one bucket at a time. The work is one pass over the
documents without a shuffle; a lost executor's partitions are simply cut again.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.text import batches, trim

#: Distinct words, and as many parts of words, whose ids a task remembers; beyond that it starts anew.
CACHE_WORDS = 350_000


class _Ids:
    """Ids of words by one tokenizer; it never joins what a space or a line end parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"\n": _CLOSED}
        spec = json.loads(self.tokenizer.to_str())
        #: Latin words may go straight to the model where the steps before it are the ones known here.
        self.direct = spec["normalizer"] == _NORMALIZER and [x["type"] for x in spec["pre_tokenizer"].get("pretokenizers", [])] == ["Split", "ByteLevel"]
        if self.direct:
            self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")

    def of(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*split).difference(self.words))
        if new:
            self._learn(new)
        of = self.words.__getitem__
        return [b"".join(map(of, words)) for words in split]

    def forget(self, most: int = 0) -> None:
        """Drop the words, or the parts, if they are more than so many."""
        if len(self.words) > most:
            self.words = {"": b""}
        if len(self.parts) > most:
            self.parts = {"\n": _CLOSED}

    def _learn(self, new: list[str]) -> None:
        latin = [w for w in new if _LATIN.fullmatch(w) and "<|" not in w] if self.direct else []
        if latin:
            # one string of all words, each closed by a line end, which splits and stands for itself
            found = self.split.findall("\n".join(latin).lower() + "\n")
            self._learn_parts(list(set(found).difference(self.parts)))
            self.words.update(zip(latin, b"".join(map(self.parts.__getitem__, found)).split(_CLOSED)[:-1], strict=True))
            new = [w for w in new if w not in self.words]
        for w, got in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False) if new else (), strict=True):
            self.words[w] = np.array(got.ids, "<u4").tobytes()

    def _learn_parts(self, new: list[str]) -> None:
        tokenize, parts = self.model.tokenize, self.parts
        for part in new:
            ids = tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS))
            parts[part] = array("I", [t.id for t in ids]).tobytes()


#: Ends the ids of a word. No id is so large, and each id's last byte is 0, so it stands nowhere else.
_CLOSED = b"\xff" * 4

#: Words of visible Latin characters whose lower case is one character wherever they stand.
_LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")

_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}

#: Byte-level models write each byte as a letter: visible ones as themselves, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

_ids: dict[str, _Ids] = {}


def token_ids(texts: list[str], path: str, words: int = CACHE_WORDS) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of whole texts, without special tokens."""
    if path not in _ids:
        _ids[path] = _Ids(path)
    _ids[path].forget(words)
    return _ids[path].of(texts)


def lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to ``n``, none above ``longest``, in falling order."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


OUT = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int"


def decompose(docs: DataFrame, tokenizer_file: str, end_id: int = 2, longest: int = 4096, words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents, one row each: ``doc_id, start, length, ids, doc_tokens, bucket,
    sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit token ids; each document ends with ``end_id``. A null or
    empty text is the end id alone. Rows are taken as they come: repeated rows, ties and null ids give
    pieces of their own, and other columns of ``docs`` are not read. ``longest`` is a power of two.
    Tasks remember the ids of ``words`` words, some 200 bytes each, and of as many parts of words.
    ``bucket`` is the length's binary logarithm; ``sequence_id`` is unique and ``offset`` always 0.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in OUT.split(", ")]

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in batches(texts, 2 << 20):
                cols: list[list] = [[] for _ in names]
                for key, ids in zip(keys[lo:hi], token_ids(texts[lo:hi], tokenizer_file, words), strict=True):
                    ids += end
                    total, at = len(ids) // 4, 0
                    for n in lengths(total, longest):
                        for col, v in zip(cols, (key, at, n, ids[4 * at : 4 * (at + n)], total, n.bit_length() - 1), strict=True):
                            col.append(v)
                        at += n
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        if tokenizer_file in _ids:
            _ids[tokenizer_file].forget()  # the worker may live on for other steps
        trim()

    pieces = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, OUT)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str, seed: int = 0) -> None:
    """Write pieces for training: one folder for each length, rows within it in hashed order.

    Every row is written once, repeated ones and those with null ids as well; an empty table makes no folder.
    """
    mixed = F.xxhash64(F.lit(seed), "doc_id", "start")
    pieces.withColumn("turn", mixed).sortWithinPartitions("bucket", "turn").write.partitionBy("bucket").parquet(path)
