"""Arrow-batch helpers for the operators that scan whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenspark.plans.scratch import free_name

SLICE_BYTES = 2_000_000


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each, one row at least, so that working arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def texts_of(text: pa.Array) -> list[str]:
    return ["" if x is None else x for x in text.to_pylist()]


class Recent:
    """What was computed for recent keys, about `limit` bytes of it at most whatever the texts hold.

    There are two generations: new and found entries go to the younger one, which replaces the older one when it holds
    half of the limit. Keys of over LONG characters aren't kept.
    """

    LONG, ENTRY = 200, 220  # an entry takes about so many bytes besides its key and value

    def __init__(self, limit: int = 256_000_000):
        self.half, self.held = limit // 2, 0
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def find(self, keys: list[str], make: Callable[[list[str]], list], size: Callable[[object], int] = len) -> list:
        """The values of distinct keys; make(keys) gives those that aren't known, none of them None."""
        out = list(map(self.young.get, keys))
        lost = [i for i, v in enumerate(out) if v is None]
        if not lost:
            return out
        names = [keys[i] for i in lost]
        values = list(map(self.old.get, names))
        at = [i for i, v in enumerate(values) if v is None]
        for i, v in zip(at, make([names[i] for i in at]) if at else [], strict=True):
            values[i] = v
        for i, v in zip(lost, values, strict=True):
            out[i] = v
        if len(max(names, key=len)) > self.LONG:
            names, values = zip(*[(k, v) for k, v in zip(names, values, strict=True) if len(k) <= self.LONG] or [((), ())], strict=True)
        for i in range(0, len(names), 10_000):
            some = values[i : i + 10_000]
            self.young.update(zip(names[i : i + 10_000], some, strict=True))
            self.held += self.ENTRY * len(some) + sum(map(len, names[i : i + 10_000])) + sum(map(size, some))
            if self.held > self.half:
                self.old, self.young, self.held = self.young, {}, 0
        return out


def distinct_pieces(pieces: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct strings of lists whose strings hold no space, the place of each string among them, and the lists' ends."""
    found = pieces.flatten().dictionary_encode()
    known = found.dictionary
    ends = pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()
    if not len(known):
        return [], np.zeros(0, np.int64), ends
    # one string that is cut again: far cheaper than a Python object per Arrow value
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(known)], known), " ")[0].as_py()
    return joined.split(" "), found.indices.to_numpy().astype(np.int64), ends


def gather(values: list[bytes] | pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[places] in one buffer, and the ends of the single values in it."""
    every = (values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())).take(pa.array(places))
    offsets = np.frombuffer(every.buffers()[1], np.int64)[every.offset : every.offset + len(every) + 1]
    data = np.frombuffer(every.buffers()[2], np.uint8) if every.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def map_arrays(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], fn: Callable[[pa.Array], list[list]], limit: int = SLICE_BYTES) -> DataFrame:
    """One output row per input row: the `keep` columns and what `fn(texts)` returns, a list of values per field.

    Only `keep` and `text` are read. A name in both keeps the computed column.
    """
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    source = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].cast("string").alias(free_name(df, "text_")))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(b.num_columns - 1)
            for i, j in slices(t, limit):
                part = b.slice(i, j - i)
                made = fn(part.column(b.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(v, k) for v, k in zip(made, kinds, strict=True)]], names=[*b.schema.names[:-1], *names])

    return source.mapInArrow(run, schema)


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], fn: Callable[[list[str]], list[list]]) -> DataFrame:
    """map_arrays() for functions of a list of strings. Null texts reach `fn` as empty ones."""
    return map_arrays(df, keep, text, fields, lambda t: fn(texts_of(t)))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of a partition sorted by `key`, cut again so that no key's rows are in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        if held and held[-1].column(key)[-1] != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = k[b.num_rows - 1]
        begin = pc.index(k, last).as_py()
        if begin > 0:
            yield pa.Table.from_batches([*held, b.slice(0, begin)])
            held = [b.slice(begin)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
