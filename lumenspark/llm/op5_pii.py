"""PII: pattern detection, then information-theoretic sanitisation of the terms around it.

Base spans are e-mail addresses, IPv4 addresses, card numbers (12 to 19 digits, Luhn) and phone numbers (9 to 15 digits),
leftmost and non-overlapping per kind; a match that fails its check is dropped without a retry. Values of 16 characters
or more that are assigned to a name like token, secret or password are secrets: they tell all by themselves, so they are
spans of kind `term`, too.

The base values found are the protected entities. A term (a word of 2 letters or digits or more, lower-cased) anywhere in the
documents that hold a value may reveal it. From the corpus come the documents of each entity n(e), of each term n(t), and
of both together n(e, t). Its disclosure is PMI(e; t) / IC(e) = 1 + log2 p(e | t) / log2(N / n(e)), 1 when the term never occurs without
the entity. p(e | t) is estimated as (n(e, t) + SMOOTHING p(e)) / (n(t) + SMOOTHING): few documents are weak evidence, no
value is too rare to be scored, and the same passage in several documents counts in each. Terms that
reach THRESHOLD go: all their occurrences outside values, in every document that holds the entity, become spans of kind
`term`, which sanitised() removes; all other spans become their kind in brackets. Nothing is capped: co-occurrences meet
by (entity, term), term counts by term. Terms are told apart by 64-bit hashes.

As n(e, t) is n(e) at most, a term can only reach the threshold if n(t) <= (n(e) + SMOOTHING p(e)) (N / n(e)) ** (1 - THRESHOLD)
- SMOOTHING. So terms of which more documents than that were counted already, in a bounded table of the most frequent
ones, are left out before anything is shuffled, which changes no result.

Values that stand in the same documents are revealed alike by every term, so one of them stands for all: a page of thousands
of addresses that stand nowhere else makes as many candidates as it has terms, not as many times that.

Cases: a null or empty text has no spans; repeated rows count as documents of their own; null
doc_ids are kept; an empty table gives no rows; columns besides doc_id and text aren't read by report() and kept as they
are by sanitised().
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from lumenspark.llm.batches import slices, texts_of
from lumenspark.plans.scratch import free_name, materialize, with_row_id

SMOOTHING = 1.0
THRESHOLD = 0.9
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W_]{2,}")
_BUCKETS = 1 << 22
OFTEN = 200_000
#: Candidates of a worker's output batch, about.
PIECE = 1_000_000
_ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|(?:api|access|private)[_-]?key)[\"']?\s{0,3}[:=]"
_SECRET = re.compile(_ASSIGNED + r"\s{0,3}[\"']?([A-Za-z0-9_+/=-]{16,})", re.A)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one @, so the longest local part before each @ decides where it begins."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort()
    return out


def secret_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Secrets that no base span overlaps."""
    return [(s, 4, e) for m in _SECRET.finditer(text) for s, e in [m.span(1)] if not any(a < e and s < b for a, _, b in spans)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The distinct values of a text as hashes."""
    values = {f"{KINDS[k]}:{text[s:e].lower()}" for s, k, e in spans}
    return [int.from_bytes(hashlib.blake2b(v.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for v in values]


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms outside of all spans, which come in order."""
    out, at, covered = [], 0, 0
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][2])
            at += 1
        if covered <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


_PLACES = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("s", "z")]))
_BASE = T.StructType(
    [T.StructField("row", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_email", "n_ip", "n_card", "n_phone", "n_secret")], T.StructField("base_sha256", T.StringType()), T.StructField("base", T.StringType())]
    + [T.StructField("values", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("t", "s", "z")])))]
    + [T.StructField("secrets", _PLACES), T.StructField("often", T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("n", T.LongType())])))]
)


def term_hash(term: str) -> int:
    h = xxh3_64_intdigest(term.encode("utf-8", "replace"))
    return h - (h >> 63 << 64)


def _structs(lists: list[list[tuple[int, ...]]], names: str) -> pa.Array:
    """Lists of tuples of longs as lists of structs."""
    flat = np.array([x for part in lists for x in part], np.int64).reshape(-1, len(names))
    offsets = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(len(names))], names=list(names)))


class Often:
    """How many texts hold the most frequent terms: too low perhaps, never too high, in bounded memory."""

    def __init__(self, most: int = 400_000):
        self.counts, self.most = Counter(), most

    def add(self, text: str) -> None:
        self.counts.update({x.lower() for x in set(_TERM.findall(text))})
        if len(self.counts) > self.most:
            least = 1
            while len(self.counts) > self.most // 2:
                self.counts = Counter({t: n for t, n in self.counts.items() if n > least})
                least *= 2

    def top(self) -> list[tuple[int, int]]:
        return [(term_hash(t), n) for t, n in self.counts.most_common(OFTEN // 4) if n > 1]


def detect(numbered: DataFrame) -> DataFrame:
    """doc_id, row, the base columns, the values and, if there are any, the terms with their places, one row per document.

    A last row of each partition, with `often` only, holds its most frequent terms.
    """
    schema = T.StructType([numbered.schema["doc_id"], *_BASE.fields])
    id_type = to_arrow_type(numbered.schema["doc_id"].dataType)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Often()
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                texts = texts_of(part.column("text"))
                found = [base_spans(t) for t in texts]
                for t in texts:
                    often.add(t)
                assigned = pc.fill_null(pc.match_substring_regex(part.column("text"), _ASSIGNED), False).to_pylist()
                secrets = [secret_spans(x, f) if some else [] for x, f, some in zip(texts, found, assigned, strict=True)]
                every = [sorted([*f, *s]) for f, s in zip(found, secrets, strict=True)]
                counts = np.array([[sum(k == kind for _, k, _ in f) for kind in range(5)] for f in every], np.int64).reshape(-1, 5)
                joined = [_joined(f) for f in found]
                held = [[(term_hash(t), a, z) for t, a, z in terms_of(x, e)] if f else [] for x, f, e in zip(texts, found, every, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row"),
                        *[pa.array(counts[:, k]) for k in range(5)],
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                        pa.array(joined),
                        pa.array([entities_of(x, f) for x, f in zip(texts, found, strict=True)], pa.list_(pa.int64())),
                        _structs(held, "tsz").cast(kinds[-3]),
                        _structs([[(a, z) for a, _, z in x] for x in secrets], "sz").cast(kinds[-2]),
                        pa.nulls(len(texts), kinds[-1]),
                    ],
                    names=schema.names,
                )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *[pa.nulls(1, k) for k in kinds[1:-1]], _structs([often.top()], "tn").cast(kinds[-1])], names=schema.names)

    return numbered.select("doc_id", "row", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, n_t): documents of the corpus that hold each wanted term.

    A bit per hash bucket of the wanted terms, 4 million at most whatever the corpus, keeps other words off the shuffle.
    """
    bucket = F.pmod("t", F.lit(_BUCKETS)).cast("int")
    bits = np.zeros(_BUCKETS // 8, np.uint8)
    for r in wanted.select(F.shiftright(bucket, 16).alias("hi"), bucket.alias("b")).groupBy("hi").agg(F.collect_set("b").alias("bs")).toLocalIterator():
        at = np.array(r["bs"], np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, counts = shared.value, {}, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], names=["t", "n"])
            counts.clear()
            return out

        def wanted_hash(term: str) -> int | None:
            h = term_hash(term)
            at = h % _BUCKETS
            return h if bits[at >> 3] >> (at & 7) & 1 else None

        for b in batches:
            for text in texts_of(b.column("text")):
                words = {x.lower() for x in set(_TERM.findall(text))}
                for w in words.difference(known):
                    known[w] = wanted_hash(w)
                counts.update({h for w in words if (h := known[w]) is not None})
                if len(known) > 500_000:
                    known.clear()
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    counted = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").mapInArrow(run, "t long, n long")
    return counted.groupBy("t").agg(F.sum("n").alias("n_t")).join(wanted, "t", "left_semi")


def candidates(marked: DataFrame, often: DataFrame, total: int, threshold: float) -> DataFrame:
    """(row, e, t) once for every value and term of a document that may reach the threshold. marked: row, held, and es, its values with n_e."""
    top = often.groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(OFTEN).toPandas().sort_values("t")  # OFTEN rows
    shared = marked.sparkSession.sparkContext.broadcast((top["t"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def made(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *o]), pa.int64()) for o in out], names=["row", "e", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for b in batches:
            out, size = [[], [], []], 0
            for row, held, es in zip(b.column("row").to_pylist(), b.column("held"), b.column("es").to_pylist(), strict=True):
                t = np.unique(held.values.field("t").to_numpy())
                at = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
                least = np.where(known[at] == t, counts[at], 0) if len(known) else np.zeros(len(t), np.int64)
                for e in es:
                    n = e["n_e"]
                    if n < total:
                        most = (n + SMOOTHING * n / total) * (total / n) ** (1 - threshold) - SMOOTHING
                        some = t[least <= most * (1 + 1e-9) + 1e-9]
                        for values, one in zip(out, (np.full(len(some), row), np.full(len(some), e["e"]), some), strict=True):
                            values.append(one)
                        size += len(some)
                        if size > PIECE:
                            yield made(out)
                            out, size = [[], [], []], 0
            yield made(out)

    return marked.select("row", "held", "es").mapInArrow(run, "row long, e long, t long")


def alike(valued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(e, n_e) of one value for all that stand in the same documents, and (row, e, n_e) of the documents that hold it.

    valued: row and e, once per document and value. A term reveals such values alike, so one stands for all: a page of
    addresses that stand nowhere else has one. A set of documents is known by its size and 128 bits of its rows' hashes.
    """
    marks = [F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]
    counted = materialize(valued.groupBy("e").agg(F.count("*").alias("n_e"), *marks), "entities")
    firsts = materialize(counted.groupBy("n_e", "x", "y").agg(F.min("e").alias("e")).select("e", "n_e"), "alike")
    return firsts, valued.join(firsts, "e")


def disclosing_terms(docs: DataFrame, met: DataFrame, entities: DataFrame, total: int, threshold: float) -> DataFrame:
    """(e, t): terms that reveal an entity. `met` has e and t once per document that holds both, `entities` has e and n_e."""
    pairs = materialize(met.groupBy("e", "t").agg(F.count("*").alias("n_et")), "pairs")
    if pairs.isEmpty():
        return pairs.select("e", "t")
    both = pairs.join(term_counts(docs, pairs.select("t").distinct()), "t").join(entities, "e")
    content = F.log2(F.lit(float(total)) / F.col("n_e"))
    disclosure = 1 + F.log2((F.col("n_et") + SMOOTHING * F.col("n_e") / F.lit(float(total))) / (F.col("n_t") + SMOOTHING)) / content
    return both.filter((content > 0) & (disclosure >= threshold)).select("e", "t")


def _places(marked: DataFrame, gone: DataFrame) -> DataFrame:
    """(row, terms): where the terms that go stand. gone: row and ts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = []
            for held, ts in zip(b.column("held"), b.column("ts").to_pylist(), strict=True):
                own = held.values
                at = np.isin(own.field("t").to_numpy(), np.array(ts, np.int64))
                terms.append(list(zip(own.field("s").to_numpy()[at].tolist(), own.field("z").to_numpy()[at].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("row"), _structs(terms, "sz").cast(to_arrow_type(_PLACES))], names=["row", "terms"])

    return marked.join(gone, "row").select("row", "held", "ts").mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), T.StructField("terms", _PLACES)]))


def _found(numbered: DataFrame, threshold: float) -> DataFrame:
    """row, doc_id, the counts, base_sha256 and spans of every document (row, doc_id, text)."""
    stored = materialize(detect(numbered), "spans")
    found = stored.filter("row is not null")
    total = found.count()
    valued = found.select("row", F.explode("values").alias("e"))
    entities, valued = alike(valued)
    es = valued.groupBy("row").agg(F.collect_set(F.struct("e", "n_e")).alias("es"))  # a document's own values
    held = found.filter(F.size("held") > 0).select("row", "held")
    often = stored.filter("row is null").select(F.explode("often").alias("x")).select("x.*")
    met = materialize(candidates(held.join(es, "row"), often, total, threshold), "met")
    terms = materialize(disclosing_terms(numbered, met.select("e", "t"), entities, total, threshold), "terms")
    gone = met.join(terms, ["e", "t"], "left_semi").groupBy("row").agg(F.collect_set("t").alias("ts"))
    more = _places(held, gone)
    placed = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"), x.alias("x")))
    gone = F.concat("secrets", F.coalesce("terms", F.array().cast("array<struct<s:bigint,z:bigint>>")))
    extra = F.transform(gone, lambda t: F.struct(t["s"].alias("s"), F.lit(len(KINDS)).cast("long").alias("k"), F.concat_ws(":", F.lit("term"), t["s"].cast("string"), t["z"].cast("string")).alias("x")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(placed, extra)), lambda y: y["x"]), ",")
    kinds = ("n_email", "n_ip", "n_card", "n_phone")
    n_found = sum((F.col(c) for c in (*kinds, "n_secret")), F.lit(0)).cast("long").alias("n_found")
    return found.join(more, "row", "left").select("row", "doc_id", *kinds, "base_sha256", F.when(F.size(gone) == 0, F.col("base")).otherwise(spans).alias("spans"), "n_secret", n_found)


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base ones, secrets and terms), n_secret and n_found (all but terms)."""
    return _found(with_row_id(docs.select("doc_id", "text"), "row"), threshold).drop("row")


def sanitise(text: str, spans: str) -> str:
    """text with spans generalised to their kind and terms removed; of overlapping spans the first one counts."""
    out, at = [], 0
    for x in filter(None, spans.split(",")):
        kind, s, e = x.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], "" if kind == "term" else f"[{kind}]"]
            at = int(e)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _sanitise(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or not s else sanitise(t, s) for t, s in zip(text, spans, strict=True)])


def sanitised(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each text sanitised; null texts stay null and all other columns as they are."""
    row, mark = free_name(docs, "row"), free_name(docs, "spans")
    numbered = with_row_id(docs, row)
    spans = _found(numbered.select(F.col(row).alias("row"), "doc_id", "text"), threshold).filter("spans <> ''").select(F.col("row").alias(row), F.col("spans").alias(mark))
    both = numbered.join(spans, row, "left")
    return both.select(*[(_sanitise(F.col("text"), F.coalesce(mark, F.lit(""))).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
