"""BPE encoding and decoding.

Encoding merges with a priority queue of merge ranks over a doubly linked list of symbols, skipping entries that a later
merge has made stale. Decoding concatenates vocabulary strings, with a space between tokens where the tokenizer file
names no decoder, as the library's decode does. Normalising and pre-tokenizing are the file's own steps.

Texts are cut at ASCII white space, which no token of this kind of vocabulary contains. What recent pieces and words gave
is kept, so that only unknown words are merged.

Cases: a null text counts as empty and gives no ids; special tokens in a text are recognised as the library does;
repeated rows give repeated rows; an empty table gives none; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenspark.llm.batches import Recent, distinct_pieces, gather, map_arrays
from lumenspark.llm.op2_arrow_ids import byte_letters

SLICE = 4_000_000
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: ASCII and Latin letters that NFC leaves alone and that lower-case to one letter; and what _PATTERN finds among them.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_SHORT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏⱥⱦ]+|[0-9]| |[^ a-z0-9ß-öø-ɏⱥⱦ]+")


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges to symbols, lowest rank first, leftmost first among equals.

    ranks: left << 32 | right to rank; merged: by rank. The queue holds rank << 32 | position; an entry is stale if the
    pair that begins at its position has another rank by now.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    pair, sym, left, right = ranks.get, list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    now = [pair(a << 32 | b, -1) for a, b in zip(sym, sym[1:], strict=False)]
    now.append(-1)
    queue = [r << 32 | i for i, r in enumerate(now) if r >= 0]
    heapify(queue)
    while queue:
        top = heappop(queue)
        i, r = top & 0xFFFFFFFF, top >> 32
        if now[i] != r:
            continue
        j = right[i]
        sym[i] = new = merged[r]
        sym[j] = now[j] = -1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            r = now[i] = pair(new << 32 | sym[k], -1)
            if r >= 0:
                heappush(queue, r << 32 | i)
        else:
            now[i] = -1
        h = left[i]
        if h >= 0:
            r = now[h] = pair(sym[h] << 32 | new, -1)
            if r >= 0:
                heappush(queue, r << 32 | h)
    return [s for s in sym if s >= 0]


class Bpe:
    """A BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        v = self.vocab
        self.ranks = {v[a] << 32 | v[b]: i for i, (a, b) in reversed([*enumerate(pairs)])}
        self.merged = [v[a + b] for a, b in pairs]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.string = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.joint = "" if library.decoder is not None else " "
        self.library_decode = library.decoder.decode if library.decoder is not None else None
        self.pieces, self.words = Recent(136_000_000), Recent(64_000_000)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        n = max(self.string) + 1
        self.width = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        # each id as digits and as its string, behind a separator
        self.digits = pa.array([b" %d" % i for i in range(n)], pa.large_binary())
        self.strings = pa.array([(self.joint + self.string[i]).encode() if i in self.string else b"" for i in range(n)], pa.large_binary())
        #: Pieces of these characters take the short way if the file's steps are the ones that _SHORT stands for.
        self.short = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and all("<|" in x for x in self.special)

    def word(self, word: str) -> list[int]:
        """Ids of a pre-token."""
        symbols = list(word)
        symbols[-1] += self.suffix
        return merge([self.vocab[s] for s in symbols if s in self.vocab], self.ranks, self.merged)

    def chunk(self, text: str) -> list[int]:
        """Ids of a text by the file's own steps, one special token or pre-token after the other."""
        out = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.normalizer.normalize_str(part) if self.normalizer is not None else part
                for w, _ in self.pre.pre_tokenize_str(normal):
                    out += self.word(w)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        return [np.array(self.word(w), self.width).tobytes() for w in "\0".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[0])]

    def _unknown(self, pieces: list[str]) -> list[bytes]:
        plain = [self.short and _PLAIN.fullmatch(p) is not None and "<|" not in p for p in pieces]
        easy = [p for p, fine in zip(pieces, plain, strict=True) if fine]
        values = []
        if easy:
            # one list of pre-tokens with a space behind each piece
            flat = _SHORT.findall(" ".join([*easy, ""]).lower())
            words = list(dict.fromkeys(flat))
            words.remove(" ")
            at = {w: i for i, w in enumerate(words)} | {" ": len(words)}
            places = np.fromiter(map(at.__getitem__, flat), np.int64, len(flat))
            data, ends = gather([*self.words.find(words, self._words), b""], places)
            data, bounds = data.tobytes(), [0, *ends[places == len(words)].tolist()]
            values = [data[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        if len(easy) == len(pieces):
            return values
        given = iter(values)
        return [next(given) if fine else np.array(self.chunk(p), self.width).tobytes() for p, fine in zip(pieces, plain, strict=True)]

    def decode(self, ids: list[int]) -> str:
        tokens = [self.string[i] for i in ids if i in self.string]
        return self.library_decode(tokens) if self.library_decode else self.joint.join(tokens)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's end."""
        pieces, places, ends = distinct_pieces(_cut(texts))
        data, upto = gather(self.pieces.find(pieces, self._unknown), places)
        return data.view(self.width), np.concatenate([[0], upto])[ends] // self.width.itemsize

    def digests(self, texts: pa.Array) -> list[list]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        ids, ends = self.encode(texts)
        sizes = np.diff(ends, prepend=0)

        def parts(values: pa.Array, skip: int) -> list[bytes]:
            data, upto = gather(values, ids)
            bounds, data = np.concatenate([[0], upto])[np.concatenate([[0], ends])].tolist(), data.tobytes()
            return [data[min(a + skip, b) : b] for a, b in zip(bounds, bounds[1:], strict=False)]

        if self.library_decode is None:
            shown = parts(self.strings, len(self.joint))
        else:
            shown = [self.decode(x.tolist()).encode("utf-8", "replace") for x in np.split(ids, ends[:-1])]
        return [sizes, [hashlib.sha256(x).hexdigest() for x in parts(self.digits, 1)], [hashlib.sha256(x).hexdigest() for x in shown]]


def _cut(texts: pa.Array) -> pa.ListArray:
    """Pieces between ASCII white space; empty ones, which encode to nothing, where some stands at an end."""
    return pc.ascii_split_whitespace(pc.fill_null(texts, ""))


_models: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return map_arrays(docs, ["doc_id"], "text", FIELDS, lambda texts: model(tokenizer).digests(texts), SLICE)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids, for writers of token files."""

    def run(texts: pa.Array) -> list[list]:
        ids, ends = model(tokenizer).encode(texts)
        return [[x.tolist() for x in np.split(ids, ends[:-1])]]

    return map_arrays(docs, ["doc_id"], "text", [T.StructField("ids", T.ArrayType(T.IntegerType()))], run, SLICE)
