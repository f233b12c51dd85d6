"""BPE encoding and decoding through a distinct-word table.

A word is a maximal run without white space in the normalised text (or the literal string of an added
token); pieces never cross it.

1. The COMMON commonest words of a bounded sample of documents (which words these are does not change any
   result) are the only ones that travel by number.
2. One pass splits every text.  Its documents go in chunks of about CHUNK characters: places of common
   words, and places in the chunk's own list of the others, each listed once however often it occurs.
3. The distinct-word table: the chunks' words meet by hash in buckets of about BUCKET words, whose number
   follows from the words listed, and each distinct word is encoded once, there.  Common words likewise.
4. A bucket's words return their ids to the chunks that listed them, by place in the list, and the
   documents' ids are put together in the chunk's task, by position.
5. Decoding joins ids to the table of pieces, whose size is the vocabulary's.  decode() does so for any
   table of ids; the digests of the query join in the task that completes the ids, against the same table
   broadcast, because every further shuffle of ids or pieces costs as much disk as the texts.

A hot word is listed once a chunk at most, so what meets in its bucket grows with the chunks, not with its
count.  The normaliser, splitter and model are the tokenizers library's, read from a tokenizer file given
by path; texts within Latin letters take a shortcut that does what the file's normaliser does there.

Null texts are empty: no ids, empty decoded text.  A very long text is a chunk of its own.  Rows that
repeat are encoded alike, each for itself, and null ids are ids like any other; empty tables give empty
tables; further columns of the input do not matter.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from pathlib import Path
from unicodedata import category
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, documents, expand, pack, python_ready, squeeze, unpack, worker_cache

#: Words that travel by number (some 100 bytes each in a worker), and documents they are learnt from.
COMMON, SAMPLE = 131_072, 10_000
#: Characters of a chunk's texts, about; words of a bucket, about.
CHUNK, BUCKET = 4 << 20, 500_000
#: Pieces up to which the table of pieces is broadcast.
BROADCAST_PIECES = 1_000_000
_FAR = re.compile("[̀-\U0010ffff]")
#: The splitter whose units of near characters (up to U+02FF) Python's re gives alike.
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def is_far(text: str) -> bool:
    """Whether a character is beyond the near ones."""
    return _FAR.search(text) is not None


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    """A tokenizer file's own parts, and how they cut a text into words."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.size = max(self.tok.get_vocab(with_added_tokens=True).values(), default=0) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.near_units = self._near()

    def _plain(self, text: str) -> list[str]:
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):  # these separate words for str.split() only
            if text.isascii():
                return text.lower().split()
            try:
                text.encode("latin-1")
                return text.lower().split()
            except UnicodeEncodeError:
                if not _FAR.search(text):
                    return text.lower().split()
        return [w for w in self.tok.normalizer.normalize_str(text).split(" ") if w]

    def words(self, text: str | None) -> list[str]:
        """Added tokens stand as they are, marked by a leading space."""
        if not text:
            return []
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        out: list[str] = []
        for part in self.split_added.split(text):
            out += [" " + part] if part in self.added else self._plain(part) if part else []
        return out

    def encode_word(self, word: str) -> bytes:
        if word[0] == " ":
            ids = [self.added[word[1:]]]
        else:
            ids = [t.id for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(word) for t in self.tok.model.tokenize(piece)]
        return np.array(ids, self.dtype).tobytes()

    def _near(self) -> tuple[re.Pattern, dict[int, str]] | None:
        """(units of a word of near characters, how the model writes their characters), if the file's splitter is the known one."""
        pre = self.tok.pre_tokenizer
        if pre is None or json.loads(pre.__getstate__()) != _SPLITTER:
            return None
        kinds: dict[str, str] = {"L": "", "N": ""}
        written = {}
        for c in map(chr, range(0x300)):
            kind = category(c)[0]
            if kind in kinds:
                kinds[kind] += c
            if got := pre.pre_tokenize_str(c):  # nothing: white space
                written[ord(c)] = got[0][0]
        letters, numbers = (re.escape(kinds[k]) for k in "LN")
        blanks = re.escape("".join(chr(k) for k in range(0x300) if k not in written))
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+"), written

    def pieces(self) -> list[str]:
        return [self.tok.id_to_token(i) or "" for i in range(self.size)]


def _join(words: list[str]) -> bytes:
    return squeeze("\n".join(words).encode("utf-8", "surrogatepass"))


def _split(b: bytes, n: int) -> list[str]:
    return expand(b).decode("utf-8", "surrogatepass").split("\n") if n else []


class Codec:
    """Encoding and decoding of whole tables with one tokenizer file."""

    def __init__(self, spark: SparkSession, path: str, common: int = COMMON):
        python_ready(spark)
        self.spark, self.common, self.key = spark, min(common, COMMON), uuid.uuid4().hex
        self.spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
        self.own = Model(self.spec.value)
        self.dtype = self.own.dtype.str

    def model(self) -> Callable[[], Model]:
        spec, key = self.spec, self.key

        def get() -> Model:
            kept = worker_cache(key)
            if "model" not in kept:
                kept["model"] = Model(spec.value)
            return kept["model"]

        return get

    def pieces(self) -> DataFrame:
        """(id, piece): as many rows as the vocabulary has."""
        return self.spark.createDataFrame(pd.DataFrame({"id": np.arange(self.own.size, dtype=np.int32), "piece": self.own.pieces()}), "id int, piece string")

    def commonest(self, docs: DataFrame, text_col: str = "text") -> list[str]:
        """Words of a sample of about SAMPLE documents that occur most often there, at most `common`."""
        get = self.model()
        rate = max(1, docs.count() // SAMPLE)
        pick = docs.select(F.col(text_col).alias("t")).where(F.pmod(F.xxhash64("t", F.lit(3)), F.lit(rate)) == 0)

        def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = get().words
            for pdf in it:
                seen = Counter()
                for text in pdf["t"]:
                    seen.update(words(text))
                if seen:
                    yield pd.DataFrame({"word": list(seen), "n": np.fromiter(seen.values(), np.int64, len(seen))})

        if not self.common:
            return []
        found = pick.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
        return [r.word for r in found.orderBy(F.desc("n"), "word").limit(self.common).select("word").collect()]

    def answers(self, listed: DataFrame) -> DataFrame:
        """(chunk, at, lens, ids, n) of listed (bucket, chunk, at, words, n): a bucket's distinct words encoded once, their ids for every chunk that listed them."""
        get = self.model()

        def encode(pdf: pd.DataFrame) -> pd.DataFrame:
            encode_word, ids, out = get().encode_word, {}, []
            for k, at, packed, n in zip(pdf["chunk"], pdf["at"], pdf["words"], pdf["n"]):
                own = _split(packed, n)
                for w in own:
                    if w not in ids:
                        ids[w] = encode_word(w)
                got = [ids[w] for w in own]
                out.append((k, at, pack(np.array([len(x) for x in got], np.int32)), squeeze(b"".join(got)), n))
            return pd.DataFrame(out, columns=["chunk", "at", "lens", "ids", "n"])

        return listed.groupBy("bucket").applyInPandas(encode, "chunk long, at binary, lens binary, ids binary, n int")

    def lookup(self, words: list[str]):
        """(words, their ids, where these end in bytes, all pieces) as a broadcast of bounded size."""
        at = pack(np.arange(len(words), dtype=np.int32))
        listed = self.spark.createDataFrame([(0, -1, bytearray(at), bytearray(_join(words)), len(words))], "bucket int, chunk long, at binary, words binary, n int")
        got = self.answers(listed).first()
        ends = np.concatenate(([0], np.cumsum(unpack(bytes(got.lens), "<i4"), dtype=np.int64)))
        pieces = [r.piece for r in self.pieces().orderBy("id").collect()]  # the vocabulary
        return self.spark.sparkContext.broadcast((words, expand(bytes(got.ids)), ends, pieces))

    def encoded(self, docs: DataFrame, finish: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """finish(id, ids, texts of the words in order) for every document, as rows of schema.

        finish works in the task that completes the ids, so that these need not travel further.
        """
        get, key, dtype = self.model(), self.key, self.dtype
        table = self.lookup(self.commonest(docs, text_col))
        most = len(table.value[0])
        names = [x.split()[0] for x in schema.split(", ")]
        idt = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

        def chunk(ids: list, texts: list, m: Model, of: dict[str, int]) -> tuple:
            lens, places, others, own = [], [], [], {}
            for t in texts:
                words = m.words(t)
                at = np.fromiter(map(of.get, words, [most] * len(words)), np.int32, len(words))
                lens.append(len(words))
                places.append(at)
                others += [own.setdefault(words[i], len(own)) for i in np.flatnonzero(at == most).tolist()]
            others = np.array(others, np.int32)
            return ids, pack(np.array(lens, np.int32)), pack(np.concatenate(places)), pack(np.diff(others, prepend=np.int32(0))), _join(list(own)), len(own)

        def frames(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, kept = get(), worker_cache(key)
            if "places" not in kept:
                kept["places"] = {w: i for i, w in enumerate(table.value[0])}
            task, n = TaskContext.get().partitionId() << 32, 0
            for pdf in it:
                part = pdf["t"].map(lambda t: len(t) if t else 0).cumsum() // CHUNK
                for _, own in pdf.groupby(part, sort=False):
                    yield pd.DataFrame([(task + n, *chunk(list(own["id"]), list(own["t"]), m, kept["places"]))], columns=["chunk", "doc", "lens", "places", "others", "words", "n"])
                    n += 1

        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        made = cut(rows.mapInPandas(frames, f"chunk long, doc array<{idt}>, lens binary, places binary, others binary, words binary, n int"), "chunks")
        buckets = max(1, (made.agg(F.sum("n")).first()[0] or 0) // BUCKET)

        def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for k, packed, n in zip(pdf["chunk"], pdf["words"], pdf["n"]):
                    words = _split(packed, n)
                    of = np.array([crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], np.int64)
                    order = np.argsort(of, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                        if len(part):
                            yield pd.DataFrame([(int(of[part[0]]), k, pack(np.diff(part, prepend=0).astype(np.int32)), _join([words[i] for i in part.tolist()]), len(part))], columns=["bucket", "chunk", "at", "words", "n"])

        listed = made.select("chunk", "words", "n").mapInPandas(deal, "bucket int, chunk long, at binary, words binary, n int")
        width = np.dtype(dtype).itemsize

        def fill(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            common, blob, ends, pieces = table.value
            kept = worker_cache(key)
            if "said" not in kept:
                first = np.frombuffer(blob, dtype).tolist()
                kept["said"] = [" ".join([pieces[x] for x in first[a:b]]) for a, b in zip((ends[:-1] // width).tolist(), (ends[1:] // width).tolist())]
            out = []
            for docs_of, lens, places, others, n in zip(left["doc"], left["lens"], left["places"], left["others"], left["n"]):
                own = [b""] * n
                for at, sizes, ids in zip(right["at"], right["lens"], right["ids"]):
                    raw, a = expand(ids), 0
                    for i, b in zip(np.cumsum(unpack(at, "<i4")).tolist(), np.cumsum(unpack(sizes, "<i4")).tolist()):
                        own[i] = raw[a:b]
                        a = b
                flat = np.frombuffer(blob + b"".join(own), dtype)
                until = np.concatenate((ends, ends[-1] + np.cumsum([len(x) for x in own], dtype=np.int64))) // width
                say = (kept["said"] + [" ".join([pieces[x] for x in np.frombuffer(w, dtype).tolist()]) for w in own]).__getitem__
                at = unpack(places, "<i4").astype(np.int64)
                hole = np.flatnonzero(at == len(common))
                at[hole] = len(common) + np.cumsum(unpack(others, "<i4"), dtype=np.int64)
                a = 0
                for doc, k in zip(docs_of, unpack(lens, "<i4").tolist()):
                    p = at[a : a + k]
                    a += k
                    size = until[p + 1] - until[p]
                    stop = np.cumsum(size)
                    ids = flat[np.repeat(until[p] - stop + size, size) + np.arange(stop[-1] if k else 0)]
                    out.append(finish(doc, ids, filter(None, map(say, p.tolist()))))
            return pd.DataFrame(out, columns=names, dtype=object)

        return made.drop("words").groupBy("chunk").cogroup(self.answers(listed).groupBy("chunk")).applyInPandas(fill, schema)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, ids): the ids of every whole text."""
        return self.encoded(docs, lambda i, ids, _: (i, ids.astype(np.int32)), f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>", id_col, text_col)

    def decode(self, ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """(doc_id, text): each id joined to its piece, pieces in order; a null or empty list gives an empty text.

        The table of pieces is as large as the vocabulary.  A row's pieces are gathered where it is, before
        rows move, so a long row is as large as its text and no larger.
        """
        rows = cut(ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("__v"), F.monotonically_increasing_id().alias("__row")), "ids")
        each = rows.select("__row", F.posexplode("__v").alias("pos", "id")).join(bounded(self.pieces(), BROADCAST_PIECES), "id")
        text = each.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
        return rows.select("doc_id", "__row").join(text, "__row", "left").select("doc_id", F.coalesce(F.array_join("p.piece", " "), F.lit("")).alias("text"))


def _digest(doc, ids: np.ndarray, texts: Iterator[str]) -> tuple:
    return doc, len(ids), sha256(ids.astype("<u4").tobytes()).hexdigest(), sha256(" ".join(texts).encode()).hexdigest()


def digests(docs: DataFrame, path: str, common: int = COMMON) -> DataFrame:
    return Codec(docs.sparkSession, path, common).encoded(docs, _digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: counts and digests of every document's ids and decoded text."""
    return digests(docs, tokenizer_path())
