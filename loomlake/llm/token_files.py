"""Token ids of documents in binary files that can be read in part: independent zstandard frames with a seek table.

A folder holds part files and `_manifest.json`, which is written last and names the files that belong to the
folder, in order, with their documents, tokens, first and last id.  A part file is

    data frames | index (a skippable frame) | seek table (a skippable frame)

Data frames are plain zstandard frames of ids as little-endian unsigned 32-bit integers.  A frame holds
consecutive whole documents up to about FRAME bytes; a document above LONG bytes goes over several frames.  The seek
table is that of the seekable zstandard format: compressed size, size and checksum (low half of XXH64) of
every frame, their number and a magic number at the very end.  The index has the id and number of tokens of every
document, so that a reader knows which frames it needs: it reads the end of the file, and those frames.
Any zstandard decoder reads the whole file as the plain sequence of ids.

`token_frames` is a Spark data source for such folders.  Its writer takes (doc_id, ids), sorted as they shall stand,
and streams each partition into one file, a frame at a time; files of attempts that are not committed are
not in the manifest.  Its reader gives (doc_id, start, n_tokens, ids), skips files by the ids' range and
frames by the index for equality, IN and ranges of doc_id, and checks every frame it opens.

Null ids come first; equal ids stand by a hash of their texts, rows repeated exactly in any order.  Null
texts are empty: they have the end id alone.  An empty table makes a folder without part files.  Very long
texts are documents like others.  Further columns of the input do not matter.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from xxhash import xxh64_intdigest

from .bpe import Codec, Model, is_far, tokenizer_path
from .common import documents, python_ready, scratch, worker_cache

#: The id that ends a document; bytes of ids of a frame, about, and of a document from which it is split; bytes of texts of a file, about, and files at most; words that a worker keeps, and words encoded together.
END, FRAME, LONG = 1, 256 << 10, 64 << 20
FILE, FILES, COMMON, TOGETHER = 64 << 20, 65_536, 262_144, 200
#: Magic numbers of skippable frames (the index; the seek table) and of the seek table's end.
INDEX, SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_NOTE = np.dtype([("null", "u1"), ("doc", "<i8"), ("n", "<u8")])


class Corrupt(ValueError):
    """A frame or table of a part file is not what was written."""


class FileWriter:
    """Streams documents into one part file."""

    def __init__(self, sink):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.held, self.size, self.frames, self.notes, self.tokens = [], 0, [], [], 0

    def _frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        self.held, self.size = [], 0

    def add(self, doc: int | None, ids: bytes) -> None:
        self.notes.append((doc is None, doc or 0, len(ids) // 4))
        self.tokens += len(ids) // 4
        if self.size and self.size + len(ids) > FRAME:
            self.flush()
        if len(ids) > LONG:
            for a in range(0, len(ids), LONG):
                self._frame(ids[a : a + LONG])
            return
        self.held.append(ids)
        self.size += len(ids)

    def close(self) -> None:
        self.flush()
        index = self.pack.compress(np.array(self.notes, _NOTE).tobytes())
        self.sink.write(struct.pack("<II", INDEX, len(index)) + index)
        table = np.array(self.frames, _ENTRY).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SEEK, len(table)) + table)


class FileReader:
    """The documents of one part file; `opened` counts the frames decompressed so far."""

    def __init__(self, source):
        self.source, self.unpack, self.opened = source, zstandard.ZstdDecompressor(), 0
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise Corrupt("no seek table")
        top = size - 17 - n * _ENTRY.itemsize
        if top < 0 or struct.unpack("<II", self._at(top, 8)) != (SEEK, n * _ENTRY.itemsize + 9):
            raise Corrupt("seek table of another length")
        self.frames = np.frombuffer(self._at(top + 8, n * _ENTRY.itemsize), _ENTRY)
        self.at = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        self.until = np.concatenate(([0], np.cumsum(self.frames["size"], dtype=np.int64)))
        head = struct.unpack("<II", self._at(int(self.at[-1]), 8))
        if head != (INDEX, top - int(self.at[-1]) - 8):
            raise Corrupt("index of another length")
        try:
            self.notes = np.frombuffer(self.unpack.decompress(self._at(int(self.at[-1]) + 8, head[1])), _NOTE)
        except zstandard.ZstdError as e:
            raise Corrupt("index") from e
        self.first = np.concatenate(([0], np.cumsum(self.notes["n"], dtype=np.int64)))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        try:
            raw = self.unpack.decompress(self._at(int(self.at[k]), int(f["packed"])))
        except zstandard.ZstdError as e:
            raise Corrupt(f"frame {k}") from e
        if len(raw) != f["size"] or xxh64_intdigest(raw) & 0xFFFFFFFF != f["check"]:
            raise Corrupt(f"frame {k}")
        self.opened += 1
        return raw

    def documents(self, which: np.ndarray) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, tokens before it in the file, ids) of the documents at these positions, ascending; each frame is opened once at most."""
        last, raw = -1, b""
        for p in which.tolist():
            a, b = int(self.first[p]) * 4, int(self.first[p + 1]) * 4
            got = []
            for k in range(int(np.searchsorted(self.until, a, "right")) - 1, int(np.searchsorted(self.until, b, "left"))):
                if k != last:
                    last, raw = k, self.frame(k)
                base = int(self.until[k])
                got.append(raw[max(0, a - base) : b - base])
            yield None if self.notes["null"][p] else int(self.notes["doc"][p]), a // 4, b"".join(got)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    docs: int
    tokens: int
    least: int | None
    most: int | None
    nulls: bool


@dataclass
class Part(InputPartition):
    file: str
    base: int


class Writer(DataSourceArrowWriter):
    """Each partition becomes a file."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, at = pa.fs.FileSystem.from_uri(self.path)
        file = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        out, least, most, nulls = None, None, None, False
        for batch in iterator:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    fs.create_dir(at, recursive=True)
                    sink = fs.open_output_stream(f"{at}/{file}", compression=None)  # else the name would decide
                    out = FileWriter(sink)
                out.add(doc, ids.as_py())
                if doc is None:
                    nulls = True
                else:
                    least, most = doc if least is None else min(least, doc), doc if most is None else max(most, doc)
        if out is None:
            return Written(part, "", 0, 0, None, None, False)
        out.close()
        sink.close()
        return Written(part, file, len(out.notes), out.tokens, least, most, nulls)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = pa.fs.FileSystem.from_uri(self.path)
        fs.create_dir(at, recursive=True)
        parts = [vars(m) for m in sorted((m for m in messages if m and m.docs), key=lambda m: m.part)]
        with fs.open_output_stream(f"{at}/_manifest.tmp") as f:
            f.write(json.dumps({"dtype": "<u4", "parts": parts}).encode())
        fs.move(f"{at}/_manifest.tmp", f"{at}/_manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = pa.fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{at}/{m.file}")


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted, self.low, self.high = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ids to look for; Spark applies every filter again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("doc_id",):
                if isinstance(f, (EqualTo, In)):
                    ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.wanted = ids if self.wanted is None else self.wanted & ids
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def _bounded(self) -> bool:
        return self.wanted is not None or self.low is not None or self.high is not None

    def partitions(self) -> Sequence[Part]:
        fs, at = pa.fs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{at}/_manifest.json") as f:
            parts = json.loads(f.read())["parts"]
        out, base = [], 0
        for p in parts:
            if not self._bounded() or p["least"] is not None and self._within(p["least"], p["most"]):
                out.append(Part(p["file"], base))
            base += p["tokens"]
        return out or [Part("", 0)]

    def _within(self, least: int, most: int) -> bool:
        if self.low is not None and most < self.low or self.high is not None and least > self.high:
            return False
        return self.wanted is None or any(least <= w <= most for w in self.wanted if w is not None)

    def chosen(self, notes: np.ndarray) -> np.ndarray:
        if not self._bounded():
            return np.arange(len(notes))
        keep = notes["null"] == 0
        if self.wanted is not None:
            keep &= np.isin(notes["doc"], [w for w in self.wanted if w is not None])
        if self.low is not None:
            keep &= notes["doc"] >= self.low
        if self.high is not None:
            keep &= notes["doc"] <= self.high
        return np.flatnonzero(keep)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, at = pa.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(f"{at}/{partition.file}") as f:
            r = FileReader(f)
            rows, size = [], 0
            for doc, before, ids in r.documents(self.chosen(r.notes)):
                rows.append((doc, partition.base + before, len(ids) // 4, ids))
                size += len(ids)
                if size > 4 << 20 or len(rows) == 5000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


class TokenFrames(DataSource):
    """format("token_frames"), option path: a URI that pyarrow can open."""

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def _ready(spark: SparkSession) -> None:
    python_ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFrames)


def word_ids(model: Model, words: list[str], known: dict[str, bytes] | None = None) -> dict[str, bytes]:
    """The ids of words.  Words of near characters are cut into the model's units here, and each unit is looked up among the ids already known or tokenized once; the library cuts the others, TOGETHER at a time: blanks between words are no units' part."""
    out, far, tokenize = {}, [], model.tok.model.tokenize
    near, units = model.near_units, {} if known is None else known
    fresh: dict[str, bytes] = {}
    for w in words:
        if w[0] == " ":  # an added token
            out[w] = model.encode_word(w)
        elif near is None or not w.isascii() and is_far(w):
            far.append(w)
        else:
            ids = []
            for u in near[0].findall(w):
                got = units.get(u) or fresh.get(u)
                if got is None:
                    got = fresh[u] = np.array([t.id for t in tokenize(u.translate(near[1]))], model.dtype).tobytes()
                ids.append(got)
            out[w] = b"".join(ids)
    for a in range(0, len(far), TOGETHER):
        some = far[a : a + TOGETHER]
        several: list[list[int]] = [[] for _ in some]
        k, end = 0, len(some[0])
        for unit, (at, _) in model.tok.pre_tokenizer.pre_tokenize_str(" ".join(some)):
            while at >= end:
                k += 1
                end += 1 + len(some[k])
            several[k] += [t.id for t in tokenize(unit)]
        out.update((w, np.array(x, model.dtype).tobytes()) for w, x in zip(some, several))
    return out


def encoded(rows: DataFrame, tokenizer: str, common: int | None = None) -> DataFrame:
    """(doc_id, ids) of rows (doc_id, text), each where it is and in the order it has: every whole text's ids and the end, as little-endian unsigned 32-bit integers.

    The commonest words of a bounded sample are encoded once a worker; of the others each distinct word once a batch
    of rows, so memory is bounded by both.  Which words are common changes no result.
    """
    codec = Codec(rows.sparkSession, tokenizer)
    codec.common = COMMON if common is None else common
    sent, key = rows.sparkSession.sparkContext.broadcast((codec.spec.value, codec.commonest(rows))), uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache(key)
        if "ids" not in kept:
            kept["model"] = Model(sent.value[0])
            kept["ids"] = word_ids(kept["model"], sent.value[1])
        model, ids = kept["model"], kept["ids"]
        end = np.array([END], "<u4").tobytes()
        for batch in it:
            words, sizes = [], []
            for t in batch.column(1):
                own = model.words(t.as_py())
                words += own
                sizes.append(len(own))
            got = list(map(ids.get, words))
            missed = [i for i, x in enumerate(got) if x is None]
            rest = word_ids(model, list({words[i] for i in missed}), ids)
            for i in missed:
                got[i] = rest[words[i]]
            out, a = [], 0
            for n in sizes:
                out.append(np.frombuffer(b"".join(got[a : a + n]), model.dtype).astype("<u4").tobytes() + end)
                a += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def save(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every whole text's ids to the folder at path (a URI), in ascending order of id over all files: texts are dealt by ranges of ids, and encoded and written by the task that has them in order."""
    spark = docs.sparkSession
    _ready(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // max(FILE, -(-total // FILES))))
    order = ["doc_id", "h", "tie"]
    laid = rows.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    encoded(laid, tokenizer or tokenizer_path()).write.format("token_frames").mode("append").option("path", path).save()


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens before it in the folder), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    _ready(spark)
    return spark.read.format("token_frames").option("path", path).load()


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    save(documents(spark, sf_dir), path)
    return load(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
