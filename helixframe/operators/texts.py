"""Columns of text as one run of bytes, for functions that take Arrow batches without making Python strings of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols that are worked on together: their intermediate arrays then stay in a core's cache.
TOGETHER = 1 << 17


@dataclass
class Texts:
    """Texts end to end, a byte for each character; characters beyond Latin-1 are question marks."""

    bytes: np.ndarray
    sizes: np.ndarray

    def __len__(self) -> int:
        return len(self.sizes)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        return cls(np.frombuffer("".join(texts).encode("latin-1", "replace"), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.intp))

    @classmethod
    def read(cls, column: pa.Array) -> Texts:
        """Nulls count as empty."""
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        if not len(column) or data is None:
            return cls(np.zeros(0, dtype=np.uint8), np.zeros(len(column), dtype=np.intp))
        ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
        return cls.of(column.to_pylist()) if whole.max(initial=0) > 127 else cls(whole, np.diff(ends))

    def take(self, rows: np.ndarray) -> Texts:
        """Some texts, by their places."""
        sizes = self.sizes[rows]
        at = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return Texts(self.bytes[np.repeat(at, sizes) + np.arange(sizes.sum())], sizes)

    def cut(self, first: np.ndarray, sizes: np.ndarray) -> Texts:
        """So many characters of each text, from a place on."""
        at = self.starts + first - (np.cumsum(sizes) - sizes)
        return Texts(self.bytes[np.repeat(at, sizes) + np.arange(sizes.sum())], sizes)

    def strings(self) -> list[str]:
        whole, ends = self.bytes.tobytes().decode("latin-1"), np.cumsum(self.sizes).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    def differ(self, other: Texts) -> np.ndarray:
        """Whether a text is another than the one at its place there."""
        out = self.sizes != other.sizes
        alike = np.flatnonzero(~out)
        a, b = self.take(alike), other.take(alike)
        out[alike[np.repeat(np.arange(len(alike)), a.sizes)[a.bytes != b.bytes]]] = True
        return out

    def rows(self, first: int, last: int) -> Texts:
        """Some texts that follow each other."""
        at = int(self.sizes[:first].sum())
        return Texts(self.bytes[at : at + int(self.sizes[first:last].sum())], self.sizes[first:last])


def end_to_end(parts: list[Texts]) -> Texts:
    """Texts of several columns one behind the other, row by row."""
    sizes = np.sum([p.sizes for p in parts], axis=0)
    out, first = np.zeros(int(sizes.sum()), dtype=np.uint8), np.cumsum(sizes) - sizes
    for p in parts:
        out[np.repeat(first - p.starts, p.sizes) + np.arange(len(p.bytes))] = p.bytes
        first = first + p.sizes
    return Texts(out, sizes)


def chunks(sizes: np.ndarray, together: int) -> Iterator[tuple[int, int]]:
    """[first, last) of rows of at most so many symbols, of one row at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        at = ends[first] - sizes[first]
        last = max(int(np.searchsorted(ends, at + together, side="right")), first + 1)
        yield first, last
        first = last


def arrow(kind: pa.DataType, values) -> pa.Array:
    """Numbers as an Arrow array, NaN for none; what is one already stays."""
    if isinstance(values, pa.Array):
        return values
    return pa.array(values, mask=np.isnan(values)) if values.dtype.kind == "f" else pa.array(values).cast(kind)


ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def text_udf(run: Callable[..., dict], fields: dict[str, str], n: int = 1, together: int = TOGETHER):
    """A function of n columns of texts and any of whole numbers, to a struct of fields (names and types of Spark) that run makes of a chunk of rows.

    run returns an array for each field; an Arrow array where the type is not one of ARROW.
    """

    def made(read: list[Texts], given: list[np.ndarray]) -> list[pa.Array]:
        out = run(*read, *given)
        return [arrow(ARROW.get(kind), out[name]) for name, kind in fields.items()]

    def batch(*columns: pa.Array) -> pa.Array:
        read = [Texts.read(c) for c in columns[:n]]
        given = [c.to_numpy(zero_copy_only=False) for c in columns[n:]]
        parts = [made([t.rows(*at) for t in read], [x[slice(*at)] for x in given]) for at in chunks(np.sum([t.sizes for t in read], axis=0), together)]
        return pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*(parts or [made(read, given)]))], list(fields))

    return F.arrow_udf(batch, ", ".join(f"`{name}` {kind}" for name, kind in fields.items()))


def over_texts(run: Callable[..., dict], fields: dict[str, str], texts: list, numbers: list = (), together: int = TOGETHER) -> Column:
    """text_udf() of columns of texts and of numbers."""
    return text_udf(run, fields, len(texts), together)(*texts, *numbers)
