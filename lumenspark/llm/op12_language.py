"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile lists the most frequent grams of one to three letters, the most frequent first, equal counts in the order of the
grams' code points. A word is a run of letters and combining marks in simple lower case; everything else counts as a space,
and a gram may begin or end with the space before or behind a word. A document gets the language whose profile is nearest to
its own: each of the document's grams is as far off as its ranks differ, or PROFILE places if the profile lacks it.

Profiles are learned from the counts of all training documents. Three code points fit in one long, so grams are counted
exactly, as numbers: within a slice first, then by partial aggregation; the first PROFILE of each language are the model. It
is broadcast; with over MAX_LANGUAGES languages, which then are hardly languages, the job stops before that. Texts are
counted in pieces of PIECE characters that overlap by two, so a very long text takes no more memory than its distinct grams.

score is the winner's share of nearness: 1 - distance / (grams * PROFILE), divided by its sum over all languages, to six
decimals; 0 if no profile has a gram of the document.

Cases: a null, empty or letterless text is `und` with score 0, and so is every text if no language could be learned; a null
lang teaches nothing; equal distances go to the language that comes first in UTF-8 bytes; repeated documents get equal
results (and count again in training); a null doc_id counts as held out; an empty table gives no rows; further columns
aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.llm.batches import map_texts, runs, slices, texts_of
from lumenspark.llm.op1_quality import held_out

PROFILE = 1000
MAX_LANGUAGES = 200
PIECE = 1 << 20
UNKNOWN = "und"
_SPACE, _POINT = 32, 21  # bits of a code point
_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """By code point: what it counts as (a letter or mark in lower case, else a space), and whether it is a letter."""
    if not _tables:
        kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        letter = np.array([k == "L" for k in kinds])
        plain = np.full(0x110000, _SPACE, np.uint32)
        for i in np.flatnonzero([k in "LM" for k in kinds]).tolist():
            low = chr(i).lower()
            plain[i] = ord(low) if len(low) == 1 else i
        _tables.extend([plain, letter])
    return _tables


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str], size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Code points of texts with a space on either side, their texts' numbers, and how many of them a gram may begin at."""
    held: list[tuple[int, str]] = []
    count = 0

    def joined() -> tuple[np.ndarray, np.ndarray, int]:
        owner = np.repeat([i for i, _ in held], [len(t) for _, t in held])
        return tables()[0][points("".join(t for _, t in held))], owner, len(owner)

    for i, t in enumerate(texts):
        if count and count + len(t) + 2 > size:
            yield joined()
            held, count = [], 0
        if len(t) + 2 <= size:
            held.append((i, f" {t} "))
            count += len(t) + 2
            continue
        whole = f" {t} "
        for begin in range(0, len(whole), size):
            codes = tables()[0][points(whole[begin : begin + size + 2])]
            yield codes, np.full(len(codes), i), min(size, len(whole) - begin)
    if held:
        yield joined()


def _count(codes: np.ndarray, owner: np.ndarray, begins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, grams and counts, in the order of owner and gram."""
    known = np.unique(codes)
    small = np.zeros(int(known[-1]) + 1, np.int64)
    small[known] = np.arange(1, len(known) + 1)
    base, first = len(known) + 1, int(owner[0])
    if (int(owner[-1]) - first + 1) * base**3 >= 2**63:  # so many scripts at once that owner and gram exceed a long
        cut = int(np.searchsorted(owner, (first + int(owner[-1])) // 2 + 1))
        halves = [_count(codes[:cut], owner[:cut], min(begins, cut)), _count(codes[cut:], owner[cut:], begins - cut)]
        return tuple(np.concatenate(x) for x in zip(*halves, strict=True))
    c, letter = small[codes], codes != _SPACE
    at = (owner - first) * base**3
    one = (at + c * base**2)[:begins][letter[:begins]]
    two = (at[:-1] + c[:-1] * base**2 + c[1:] * base)[:begins][(letter[:-1] | letter[1:])[:begins]]
    three = (at[:-2] + c[:-2] * base**2 + c[1:-1] * base + c[2:])[:begins][letter[1:-1][:begins]]
    cell, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
    full = np.concatenate([[0], known]).astype(np.int64)
    gram = full[cell // base**2 % base] << (2 * _POINT) | full[cell // base % base] << _POINT | full[cell % base]
    return cell // base**3 + first, gram, n


def count_grams(texts: list[str], size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of texts, grams and how often each text has each of its grams, in order of text and gram."""
    owner, gram, n = (np.zeros(0, np.int64) for _ in range(3))
    done: list[tuple] = []
    for piece in pieces(texts, size):
        new = _count(*piece)
        if not len(new[0]):
            continue
        if len(owner) and owner[-1] == new[0][0]:  # a long text goes on
            owner, gram, n = (np.concatenate(x) for x in zip((owner, gram, n), new, strict=True))
            order = np.lexsort((gram, owner))
            owner, gram, n = owner[order], gram[order], n[order]
            begin = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]))
            owner, gram, n = owner[begin], gram[begin], np.add.reduceat(n, begin)
        else:
            done.append((owner, gram, n))
            owner, gram, n = new
    return tuple(np.concatenate(x) for x in zip(*done, (owner, gram, n), strict=True))


def gram_text(gram: int) -> str:
    """A gram in letters; spaces stand for a word's ends."""
    return "".join(chr(x) for x in (gram >> (2 * _POINT), gram >> _POINT & (1 << _POINT) - 1, gram & (1 << _POINT) - 1) if x)


def profiles(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, gram, n, rank): the most frequent grams of each language of (lang, text), rank 1 the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text"), PIECE):
                part = b.slice(i, j - i)
                lang = part.column("lang").dictionary_encode()
                owner, gram, n = count_grams(texts_of(part.column("text")))
                code = lang.indices.to_numpy()[owner]
                order = np.lexsort((gram, code))
                code, gram, n = code[order], gram[order], n[order]
                begin = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (code[1:] != code[:-1])])) if len(gram) else np.zeros(0, np.int64)
                sums = np.add.reduceat(n, begin) if len(begin) else n
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(code[begin])), pa.array(gram[begin]), pa.array(sums)], names=["lang", "gram", "n"])

    plain = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    counts = plain.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= profile)


class Model:
    """The languages in order and, for each gram that some profile has, its rank in each of them (`profile` where it hasn't)."""

    def __init__(self, rows: list[tuple[str, int, int]], profile: int):
        self.profile, self.langs = profile, sorted({r[0] for r in rows}, key=lambda x: x.encode())
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int16)  # the last row: grams that none has
        place = {lang: i for i, lang in enumerate(self.langs)}
        at = np.searchsorted(self.grams, [r[1] for r in rows])
        for i, (lang, _, rank) in zip(at.tolist(), rows, strict=True):
            self.ranks[i, place[lang]] = rank - 1

    def predict(self, texts: list[str]) -> list[list]:
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return [out, scores]
        spoken = np.array([bool(tables()[1][points(t)].any()) for t in texts], bool)
        owner, gram, n = count_grams(texts)
        order = np.lexsort((gram, -n, owner))
        owner, gram = owner[order], gram[order]
        begin = runs(owner)
        rank = np.arange(len(owner)) - np.repeat(begin[:-1], np.diff(begin))
        use = (rank < self.profile) & spoken[owner]
        owner, gram, rank = owner[use], gram[use], rank[use]
        begin = runs(owner)
        step = max(1, 4_000_000 // (self.profile * len(self.langs)))  # documents at a time
        for k in range(0, len(begin) - 1, step):
            ends = begin[k : k + step + 1]
            g, r = gram[ends[0] : ends[-1]], rank[ends[0] : ends[-1]]
            at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
            theirs = self.ranks[np.where(self.grams[at] == g, at, len(self.grams))]
            off = np.where(theirs < 0, self.profile, np.abs(theirs.astype(np.int64) - r[:, None]))
            far = np.add.reduceat(off, ends[:-1] - ends[0])
            near = 1 - far / (np.diff(ends) * self.profile)[:, None]
            best, total = far.argmin(axis=1), near.sum(axis=1)
            for i, b, x, t in zip(owner[ends[:-1]].tolist(), best.tolist(), near.max(axis=1).tolist(), total.tolist(), strict=True):
                out[i], scores[i] = self.langs[b], round(x / t, 6) if t > 0 else 0.0
        return [out, scores]


def learn(docs: DataFrame, profile: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> Model:
    """The profiles of all rows with a lang, the held-out ones left aside."""
    some = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    rows = profiles(some, profile).select("lang", "gram", "rank").limit(profile * max_languages + 1).collect()
    if len(rows) > profile * max_languages or len({r["lang"] for r in rows}) > max_languages:
        raise ValueError(f"lang has more than {max_languages} values")
    return Model([tuple(r) for r in rows], profile)


def identify(docs: DataFrame, model: Model, keep: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`keep` columns of docs, predicted language and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return map_texts(docs, keep, "text", fields, lambda texts: shared.value.predict(texts))


def report(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return identify(docs, learn(docs, profile), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
