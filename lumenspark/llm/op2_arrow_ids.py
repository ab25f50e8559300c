"""Token-ID output in Arrow stream files of fixed-size-list batches.

Every text is encoded with a byte-level BPE of the tokenizers library; the end id closes each document. Shards hold
consecutive documents in ascending doc_id order. A shard is an Arrow stream of equal-length sequences,

    input_ids  fixed_size_list<uint16 or uint32>[L]   the narrower one that holds the vocabulary
    mask       fixed_size_list<bool>[L]               false for padding (end of the last sequence only)

so that sequence i of a memory-mapped shard is a zero-copy slice. Batches hold 64 sequences each (the last one fewer), so its
place follows from i: nothing before it is read. Beside it, a second stream lists the shard's
documents (doc_id, start, n_tokens), start counting the ids of earlier documents in the shard. Files are written under a
temporary name and renamed, with the same bytes for every attempt, so a task that runs again does no harm.

Cases: a null text counts as empty and gives the end id alone; doc_ids that are equal or null keep their rows (null
first, ties by text); an empty table gives no shard with documents; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.llm.batches import Recent, distinct_pieces, gather, slices
from lumenspark.plans.scratch import materialize, new_path

LENGTH = 2048
#: Sequences of a batch, and text of a shard as Spark estimates it.
BATCH = 64
SHARD_BYTES = 256_000_000
MOST_SHARDS = 100_000
END = 0
SLICE = 4_000_000
_WHITE = r"\x09-\x0d\x20\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Odd texts have a space beside other white space or at an end, so that pre-tokens don't always begin at spaces (or they
#: hold a special token).
_ODD = f" [{_WHITE}]|[{_WHITE}] |^[{_WHITE}]|[{_WHITE}]$"
#: A single line break between other characters is a pre-token of its own.
_BREAK = rf"([^{_WHITE}])\n([^{_WHITE}])"

#: Pieces of printable ASCII characters and Latin letters, perhaps behind a line break, and their pre-tokens.
_PLAIN = re.compile("\n?[\x21-\x7eÀ-ÖØ-öø-ɏ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ɏ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ɏ]+|\n")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes texts by their distinct pieces, cut before single spaces and line breaks, where the pre-tokenizer cuts too.

    Pieces and pre-tokens are looked up among recent ones. Of a piece that isn't known, plain ones are cut into
    pre-tokens here and go to the library's BPE model; all others, and odd texts as a whole, go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([_ODD, *[re.sub(r"([^\w\s])", r"\\\1", t) for t in special]])
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces, self.words = Recent(224_000_000), Recent(80_000_000)
        self.end = np.array([END], self.width).tobytes()

    def library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 20_000):
            out += [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.model.tokenize, "\0".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[0])))
        data = np.array([t.id for x in found for t in x], self.width).tobytes()
        ends = (np.cumsum(list(map(len, found))) * self.width.itemsize).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _unknown(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces behind a space, or behind a line break where they begin with one."""
        behind = [p if p[:1] == "\n" else " " + p for p in pieces]
        plain = list(map(_PLAIN.fullmatch, pieces))
        easy = [p for p, fine in zip(behind, plain, strict=True) if fine]
        # one list of pre-tokens: only the first one of a piece begins with a space or a line break
        flat = _WORDS.findall("".join(easy))
        words = list(dict.fromkeys(flat))
        at = {w: i for i, w in enumerate(words)}
        data, ends = gather(self.words.find(words, self._words), np.fromiter(map(at.__getitem__, flat), np.int64, len(flat)))
        first = np.flatnonzero(np.fromiter((w[0] in " \n" for w in flat), bool, len(flat)))
        bounds, data = [*np.concatenate([[0], ends])[first].tolist(), len(data)], data.tobytes()
        values = [data[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        if len(easy) == len(pieces):
            return values
        hard = iter(self.library([p for p, fine in zip(behind, plain, strict=True) if not fine]))
        given = iter(values)
        return [next(given if fine else hard) for fine in plain]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END after each one, and how many each has with it. Null texts are empty."""
        text = pc.fill_null(text, "")
        odd = pc.match_substring_regex(text, self.odd).to_numpy(zero_copy_only=False)
        usual = pc.replace_substring_regex(pc.if_else(pa.array(odd), "", text), _BREAK, "\\1 \n\\2")
        lists = pc.split_pattern(usual, " ")
        pieces, places, ends = distinct_pieces(lists)
        # the first piece of a text has no space before it; an odd text counts as one first piece
        begins = np.concatenate([[0], ends[:-1]])
        firsts = lists.flatten().take(pa.array(begins)).to_pylist()
        for i in np.flatnonzero(odd).tolist():
            firsts[i] = text[i].as_py()
        inner = np.ones(len(places), bool)
        inner[begins] = False
        used = np.zeros(len(pieces), bool)
        used[places[inner]] = True
        known = np.flatnonzero(used).tolist()
        moved = np.zeros(len(pieces), np.int64)
        moved[known] = np.arange(len(known))
        values = [*self.pieces.find([pieces[i] for i in known], self._unknown), *self.library(firsts), self.end]
        places = moved[places]
        places[begins] = len(known) + np.arange(len(firsts))
        places = np.insert(places, ends, len(values) - 1)
        data, upto = gather(values, places)
        sizes = np.diff(upto[ends + np.arange(len(ends))], prepend=0) // self.width.itemsize
        return data.view(self.width), sizes


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class _Shard:
    """Writes one shard's two streams, one sequence batch at a time."""

    def __init__(self, folder: str, part: int, attempt: int, length: int, id_type: pa.DataType, width: np.dtype):
        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.names = [f"{root}/shard-{part:06d}.{kind}" for kind in ("tokens.arrow", "docs.arrow")]
        self.temporary = [f"{n}.attempt-{attempt}" for n in self.names]
        self.length, self.width = length, width
        self.schemas = [
            pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.bool_(), length))]),
            pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())]),
        ]
        self.files = [self.fs.open_output_stream(n) for n in self.temporary]
        self.writers = [pa.ipc.new_stream(f, s) for f, s in zip(self.files, self.schemas, strict=True)]
        self.ids, self.held, self.start = [], 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents and the ids of all of them, with the number that each one has."""
        starts = self.start + np.cumsum(sizes) - sizes
        self.ids.append(ids)
        self.held += len(ids)
        self.start += len(ids)
        self.writers[1].write_batch(pa.record_batch([doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=self.schemas[1]))
        if self.held >= BATCH * self.length:
            self._sequences(False)

    def _sequences(self, last: bool) -> None:
        """Write all whole batches of BATCH sequences, at the end also what is left: so all but the last are of one size."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, self.width)
        real, unit = len(ids), BATCH * self.length
        whole = real // unit * unit
        if last and whole < real:
            whole = -(-real // self.length) * self.length
            ids = np.concatenate([ids, np.zeros(whole - real, self.width)])
        mask = np.arange(whole) < real
        for k in range(0, whole, unit):
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[k : min(whole, k + unit)]), self.length) for x in (ids, mask)]
            self.writers[0].write_batch(pa.record_batch(columns, schema=self.schemas[0]))
        self.ids, self.held = [ids[whole:]], max(0, real - whole)

    def close(self) -> None:
        self._sequences(True)
        for w, f, t, n in zip(self.writers, self.files, self.temporary, self.names, strict=True):
            w.close()
            f.close()
            self.fs.move(t, n)


def write(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """Write docs' token shards to `folder`, a URI that every executor reaches; returns (shard, tokens), one row each."""
    from pyspark.sql.pandas.types import to_arrow_type

    n = partitions or shard_count(docs.select("doc_id", "text"))
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, enc = None, encoder(tokenizer)
        for b in batches:
            if shard is None and b.num_rows:
                shard = _Shard(folder, context.partitionId(), context.taskAttemptId(), length, id_type, enc.width)
            for i, j in slices(b.column("text"), SLICE):
                shard.add(b.column("doc_id").slice(i, j - i), *enc.encode(b.column("text").slice(i, j - i)))
        if shard:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([shard.start], pa.int64())], names=["shard", "tokens"])

    return rows.mapInArrow(run, "shard int, tokens long")


def read_documents(shards: DataFrame, folder: str, id_type: T.DataType) -> DataFrame:
    """Read shards back: doc_id, start in the shard, n_tokens, ids_crc32, the shard's number and tokens.

    Tokens stream through one batch at a time; each document's ids are taken from its place among them and must be
    real ones by the mask, the last of them the end id.
    """
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")] + [T.StructField("shard", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("shard").to_pylist():
                yield from _documents(folder, shard)

    return shards.select("shard").mapInArrow(run, schema)


def _documents(folder: str, shard: int) -> Iterator[pa.RecordBatch]:
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/shard-{shard:06d}.tokens.arrow") as tf, fs.open_input_stream(f"{root}/shard-{shard:06d}.docs.arrow") as df:
        tokens = pa.ipc.open_stream(tf)
        ids, mask, base = np.zeros(0, np.uint16), np.zeros(0, bool), 0
        for docs in pa.ipc.open_stream(df):
            starts, sizes, crcs = docs.column(1).to_numpy(), docs.column(2).to_numpy(), []
            for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                more_ids, more_mask, held = [ids], [mask], len(ids)
                while base + held < s + n:
                    t = tokens.read_next_batch()
                    more_ids.append(t.column(0).flatten().to_numpy())
                    more_mask.append(t.column(1).flatten().to_numpy(zero_copy_only=False))
                    held += len(more_ids[-1])
                if len(more_ids) > 1:
                    cut = s - base
                    ids, mask, base = np.concatenate(more_ids)[cut:], np.concatenate(more_mask)[cut:], s
                own, marks = ids[s - base : s - base + n], mask[s - base : s - base + n]
                if not marks.all() or own[-1] != END:
                    raise ValueError(f"shard {shard}: no document ends at {s + n}")
                crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), docs.column(2), pa.array(crcs, pa.int64()), pa.array([shard] * len(crcs), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def sequence(folder: str, shard: int, i: int) -> tuple[pa.Array, pa.Array]:
    """Random access to sequence i of a shard, and its mask.

    All batches but the last have one size, so the first tells where the batch of any sequence begins: two messages are
    read wherever it stands. Of a local file they are slices of the mapped file, not copies.
    """
    if i < 0:
        raise IndexError(i)
    fs, root = _filesystem(folder)
    name = f"{root}/shard-{shard:06d}.tokens.arrow"
    with pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name) as source:
        schema = pa.ipc.read_schema(source)
        begin = source.tell()
        try:
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
            k, at = divmod(i, batch.num_rows)
            if k:
                place = begin + k * (source.tell() - begin)
                if place >= source.size():
                    raise IndexError(i)
                source.seek(place)
                batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        except EOFError:
            raise IndexError(i) from None
    if at >= batch.num_rows:
        raise IndexError(i)
    length = schema.field(0).type.list_size
    return tuple(c.flatten().slice(at * length, length) for c in batch.columns)


def shard_count(docs: DataFrame) -> int:
    """As many shards as shuffle partitions, more for tables of over SHARD_BYTES each by Spark's estimate; at most MOST_SHARDS."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-size // SHARD_BYTES)))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Write docs to Arrow shards, read them back: doc_id, start over all shards, n_tokens, ids_crc32."""
    folder = folder or new_path(spark, "token-shards")
    shards = materialize(write(docs, folder, tokenizer, length), "shards")
    before, offsets = 0, []
    for r in shards.orderBy("shard").collect():  # one row per shard
        offsets.append((r["shard"], before))
        before += r["tokens"]
    if not offsets:
        return spark.createDataFrame([], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]))
    known = spark.createDataFrame(offsets, "shard int, before long")
    found = read_documents(shards.repartition(len(offsets), "shard"), folder, docs.schema["doc_id"].dataType)
    return found.join(F.broadcast(known), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
