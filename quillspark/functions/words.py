"""Arrow-batched helpers for functions of one word or one text that have no built-in form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results kept per worker; beyond it the memo starts anew.
MEMO = 200_000
#: Longer values are not kept.
MEMO_WORD = 64
#: Bytes of text, and elements of arrays, that are Python objects at a time.
PIECE_BYTES, PIECE_ITEMS = 1 << 20, 100_000

_KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string())}


def _pieces(sizes: pa.Array, most: int):
    """(start, length) of runs of rows that have ``most`` together, or of one row."""
    ends, at = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        end = max(end, at + 1)
        yield at, end - at
        at = end


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def per_word(fn: Callable, kind: str) -> Callable[..., Column]:
    """A Column function from a Python function of strings; null gives null, and each distinct value is computed once."""

    def run(*series: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for args in zip(*series):
            if any(a is None for a in args):
                out.append(None)
                continue
            if sum(map(len, args)) > MEMO_WORD:
                out.append(fn(*args))
                continue
            if args not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[args] = fn(*args)
            out.append(memo[args])
        return pd.Series(out, dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    one.__annotations__ = {"a": pd.Series, "return": pd.Series}
    two.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def per_text(fn: Callable, kind: str) -> Callable[[Column], Column]:
    """A Column function from a Python function of a whole text; null gives null.

    Nothing is kept from text to text, and a batch stays in Arrow but for one piece of it.
    """
    told = _KINDS[kind]

    def each(texts: pa.Array) -> pa.Array:
        pieces = (texts.slice(at, n).to_pylist() for at, n in _pieces(pc.binary_length(texts), PIECE_BYTES))
        return _joined([pa.array([None if t is None else fn(t) for t in piece], told) for piece in pieces], told)

    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return lambda column: F.arrow_udf(each, kind)(column)


def per_array(fn: Callable, kind: str) -> Callable[[Column], Column]:
    """A Column function over ``array<string>``: ``fn`` of each element, memoised; a batch stays in Arrow but for the distinct words of one piece."""
    told = _KINDS[kind]

    def each(lists: pa.Array) -> pa.Array:
        memo: dict = {}

        def get(w):
            if len(w) > MEMO_WORD:
                return fn(w)
            if w not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = fn(w)
            return memo[w]

        def piece(part: pa.Array) -> pa.Array:
            coded = part.flatten().dictionary_encode()
            values = pa.array(list(map(get, coded.dictionary.to_pylist())), told).take(coded.indices)
            ends = np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, mask=part.is_null())

        return _joined([piece(lists.slice(at, n)) for at, n in _pieces(lists.value_lengths(), PIECE_ITEMS)], pa.list_(told))

    each.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return lambda column: F.arrow_udf(each, f"array<{kind}>")(column)
