"""Benchmark decontamination by exact word windows.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A window is 13
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. The windows' hashes are
broadcast after a check of their size (MAX_ITEM_BYTES of text, whose index takes about eight times that); each task scans the rolling hashes of its documents' words as arrays, verifies
every hit word for word, and marks the words inside occurrences. Benchmarks beyond the size limit are scanned in blocks
of items that each fit it, one after the other: a block's marks are stored before the next block is read, and united per
document in the end. Each block is one scan of the documents.

Cases: a null or empty text has no words; null items count as empty; items with equal texts are all listed; repeated
documents are judged alike; empty tables on either side give no rows or no hits; other columns aren't read by the scan
and are kept by the filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.llm.batches import map_texts
from lumenspark.plans.scratch import materialize, with_row_id

WINDOW = 13
MAX_ITEM_BYTES = 16_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1)
_FILTER_BITS = 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


_INV = {int(_BASE): _inverse(_BASE), int(_STEP): _inverse(_STEP)}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


class Words:
    """Word places and hashes of several texts at once, over one array of their bytes."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "replace") for t in texts]
        self.data = b" ".join([*raw, b""]).translate(_TABLE)
        b = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = b != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(b)), out=sums[1:])
            self.hash = (sums[self.end] - sums[self.start]) * _powers(_INV[int(_BASE)], len(b))[self.start]
            self.hash ^= self.hash >> np.uint64(29)
            self._sums = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * _powers(_STEP, len(self.hash)), out=self._sums[1:])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on; places whose window would leave the array aren't there."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = (self._sums[n:] - self._sums[:-n]) * _powers(_INV[int(_STEP)], len(self.hash) - n + 1)
            return h ^ (h >> np.uint64(31))

    def text(self, place: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[place] : self.end[place + n - 1]].split())


@dataclass
class Index:
    """The benchmark's windows: by their length, sorted hashes with the places where they begin, and a bit filter.

    A place is a word of `words`, the items' texts as one array of bytes, so a window takes 16 bytes besides its words,
    of which each takes 12 and its text: about 8 bytes of memory a byte of text.
    """

    data: bytes = b""
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    end: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # each item's first word
    ids: list = field(default_factory=list)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    places: dict[int, np.ndarray] = field(default_factory=dict)
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    known: dict[tuple[int, int], dict[bytes, list]] = field(default_factory=dict)  # windows that were met

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Index:
        w = Words([text or "" for _, text in rows])
        out = Index(w.data, w.start.astype(np.uint32), w.end.astype(np.uint32), w.first, [item for item, _ in rows])
        counts = np.diff(w.first)
        for n in np.unique(np.minimum(counts, WINDOW)).tolist():
            if not n:
                continue
            which = np.flatnonzero(np.minimum(counts, WINDOW) == n)
            sizes = counts[which] - n + 1
            at = np.repeat(w.first[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            h = w.windows(n)[at]
            order = np.argsort(h, kind="stable")
            out.hashes[n], out.places[n] = h[order], at[order].astype(np.uint32)
            out.filters[n] = np.zeros(1 << _FILTER_BITS, bool)
            out.filters[n][h & np.uint64((1 << _FILTER_BITS) - 1)] = True
        return out

    @property
    def nbytes(self) -> int:
        arrays = [self.start, self.end, self.first, *self.hashes.values(), *self.places.values(), *self.filters.values()]
        return len(self.data) + sum(x.nbytes for x in arrays)

    def items_of(self, n: int, h: np.uint64, text: bytes) -> list:
        """The items with the window `text` of n words and hash h. Its hash's windows are read once, then remembered."""
        key = (n, int(h))
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            low, high = np.searchsorted(self.hashes[n], h, "left"), np.searchsorted(self.hashes[n], h, "right")
            by_text: dict[bytes, dict] = {}
            for p in self.places[n][low:high].tolist():
                own = b" ".join(self.data[self.start[p] : self.end[p + n - 1]].split())
                by_text.setdefault(own, {})[self.ids[int(np.searchsorted(self.first, p, side="right")) - 1]] = None
            self.known[key] = {t: list(x) for t, x in by_text.items()}
        return self.known[key].get(text, [])

    def scan(self, w: Words) -> tuple[np.ndarray, dict[int, set]]:
        """How many occurrences start or stop to cover each word, summed: over 0 is hit; and the items by document."""
        cover, found = np.zeros(len(w.start) + 1, np.int32), {}
        for n, hashes in self.hashes.items():
            h = w.windows(n)
            may = np.flatnonzero(self.filters[n][h & np.uint64((1 << _FILTER_BITS) - 1)])
            if not len(may):
                continue
            at = np.searchsorted(hashes, h[may])
            may = may[hashes[np.minimum(at, len(hashes) - 1)] == h[may]]
            doc = np.searchsorted(w.first, may, side="right") - 1
            for p, d in zip(may.tolist(), doc.tolist(), strict=True):
                if p + n <= w.first[d + 1] and (items := self.items_of(n, h[p], w.text(p, n))):
                    cover[p] += 1
                    cover[p + n] -= 1
                    found.setdefault(d, set()).update(items)
        return np.cumsum(cover[:-1]), found


def block_count(benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES) -> int:
    total = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-int(total) // max_bytes))


def load_blocks(benchmark: DataFrame, parts: int) -> Iterator[Index]:
    """The benchmark as `parts` indexes, each read when it is asked for."""
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for k in range(parts):
        block = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield Index.of([(r["item_id"], r["text"]) for r in block.collect()])


_SPANS = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


def _ranges(hit: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.tolist()


def spans(docs: DataFrame, shared: Broadcast, keep: list[str]) -> DataFrame:
    """`keep` columns, n_words, spans (first, end, first, end ... of hit words) and items (ids as text) per document.

    shared: the broadcast index.
    """

    def run(texts: list[str]) -> list[list]:
        w = Words(texts)
        hit, found = shared.value.scan(w)
        first = w.first.tolist()
        return [
            [first[d + 1] - first[d] for d in range(len(texts))],
            [_ranges(hit[first[d] : first[d + 1]] > 0) if d in found else [] for d in range(len(texts))],
            [sorted(str(x) for x in found[d]) if d in found else [] for d in range(len(texts))],
        ]

    return map_texts(docs, keep, "text", _SPANS, run)


def _united(docs: DataFrame, benchmark: DataFrame, keep: list[str], max_bytes: int) -> DataFrame:
    """Spans over all blocks of the benchmark. Several blocks meet per row id, each row's spans being few."""
    context = docs.sparkSession.sparkContext
    count = block_count(benchmark, max_bytes)
    if count == 1:
        return spans(docs, context.broadcast(next(load_blocks(benchmark, 1))), keep)
    numbered, parts = with_row_id(docs, "__row"), []
    for index in load_blocks(benchmark, count):
        shared = context.broadcast(index)
        del index
        marks = spans(numbered, shared, ["__row"])
        # all rows once, for their number of words; later blocks add those with hits
        parts.append(materialize(marks.filter(F.size("spans") > 0) if parts else marks, "marks"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.select("__row", *[F.col(f"`{c}`") for c in keep]).join(merged, "__row").drop("__row").select(*[F.col(f"`{c}`") for c in keep], "n_words", "spans", "items")


def _hit_words(pairs: list[int]) -> int:
    covered, end = 0, -1
    for a, b in sorted(zip(pairs[0::2], pairs[1::2], strict=True)):
        covered += max(0, b - max(a, end))
        end = max(end, b)
    return covered


def report(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    found = _united(docs, benchmark, ["doc_id"], max_bytes)
    schema = T.StructType([found.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")], T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = b.column("n_words").to_pylist()
            n_hit = [_hit_words(s) if s else 0 for s in b.column("spans").to_pylist()]
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("n_words"),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() if i else nothing for i in items], pa.string()),
                    pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()),
                ],
                names=schema.names,
            )

    return found.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with their columns and whole texts."""
    names = [f"__c{i}" for i in range(len(docs.columns))]  # so that no column clashes with the ones computed here
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    found = _united(plain, benchmark, names, max_bytes)
    hit = F.aggregate(_merged("spans"), F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.filter(~((hit > 0) & (20 * hit >= F.col("n_words")))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _merged(name: str) -> F.Column:
    """Span pairs as disjoint structs (a, b), in order."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(name) / 2).cast("int")), lambda i: F.struct(F.get(name, 2 * i).alias("a"), F.get(name, 2 * i + 1).alias("b"))))
    pairs = F.filter(pairs, lambda s: s["a"].isNotNull())
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"))
    fold = F.aggregate(
        pairs,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            F.concat(acc["out"], F.array(F.struct(F.greatest(acc["end"], s["a"]).alias("a"), F.greatest(acc["end"], s["b"]).alias("b")))).alias("out"),
        ),
    )
    return fold["out"]
