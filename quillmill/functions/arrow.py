"""Arrow columns in and out of functions over single texts.

A batch's texts are Python objects only for a stretch of so many bytes at a time; what comes of them is kept as Arrow
arrays. So a worker needs no more for a batch of many tokens than its Arrow arrays and one stretch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at a time; a longer text is a stretch of its own.
STRETCH = 1 << 18


def stretches(text: pa.Array, *others: pa.Array, most: int = STRETCH) -> Iterator[tuple[pa.Array, ...]]:
    """The columns in stretches of rows that hold some `most` bytes of the first one; one empty stretch for no rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64) + 64
    number = (np.cumsum(sizes) - 1) // most
    cuts = [0, *(np.nonzero(np.diff(number))[0] + 1).tolist(), len(text)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield tuple(c.slice(a, b - a) for c in (text, *others))


def lists(sizes: Sequence[int], values: pa.Array, known: Sequence[bool] | None = None) -> pa.ListArray:
    """A list column of so many values each; null where `known` is false, whose size is 0."""
    ends = pa.array(np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))), pa.int32())
    null = None if known is None or all(known) else pa.array(~np.asarray(known, bool))
    return pa.ListArray.from_arrays(ends, values, mask=null)


def structs(kinds: Iterable[tuple[str, pa.DataType]], columns: Sequence[Sequence]) -> pa.StructArray:
    """A struct column of plain columns; what is not a number counts as null."""
    kinds = list(kinds)
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k, from_pandas=True) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def whole(parts: Iterable[pa.Array]) -> pa.Array:
    return pa.concat_arrays(list(parts))


def joined(texts: pa.ListArray) -> pa.Array:
    """The texts of each list as one: what stretches() measures lists of texts by."""
    return pc.binary_join(texts, "")
