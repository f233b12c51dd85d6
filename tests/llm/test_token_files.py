"""Token files: the format by hand and by any decoder, partial reads, corruption, order and odd rows against the tokenizers library."""

import io
import json
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from loomlake.llm import token_files
from loomlake.llm.bpe import tokenizer_path


def ids(*values):
    return np.array(values, "<u4").tobytes()


def written(docs):
    sink = io.BytesIO()
    w = token_files.FileWriter(sink)
    for doc, raw in docs:
        w.add(doc, raw)
    w.close()
    return sink.getvalue()


def opened(raw):
    return token_files.FileReader(pa.PythonFile(io.BytesIO(raw), "r"))


def test_only_the_frames_asked_for_are_opened(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 40)
    monkeypatch.setattr(token_files, "LONG", 80)
    docs = [(None, ids(9)), (1, ids(*range(5))), (2, ids()), (3, ids(*range(8))), (4, ids(*range(100, 150))), (5, ids(7, 7))]
    raw = written(docs)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() for _ in range(1))
    assert whole == b"".join(b for _, b in docs)
    r = opened(raw)
    assert [(d, b) for d, _, b in r.documents(np.arange(len(docs)))] == docs and r.opened == len(r.frames)
    assert [a for _, a, _ in opened(raw).documents(np.arange(len(docs)))] == [0, 1, 6, 6, 14, 64]
    r = opened(raw)
    assert list(r.documents(np.array([1, 5]))) == [(1, 1, docs[1][1]), (5, 64, docs[5][1])] and r.opened == 2
    r = opened(raw)
    assert list(r.documents(np.array([4]))) == [(4, 14, docs[4][1])] and r.opened == 3  # 200 bytes in frames of 80


def test_seek_table_is_that_of_the_format():
    raw = written([(1, ids(1, 2, 3)), (2, ids(4))])
    assert raw[-4:] == bytes.fromhex("b1ea928f") and int.from_bytes(raw[-9:-5], "little") == 1 and raw[-5] == 0x80
    table = raw[-9 - 12 - 8 :]
    assert int.from_bytes(table[:4], "little") == 0x184D2A5E and int.from_bytes(table[4:8], "little") == 12 + 9
    packed, size, check = np.frombuffer(table[8:20], "<u4")
    from xxhash import xxh64_intdigest

    assert size == 16 and zstandard.ZstdDecompressor().decompress(raw[:packed]) == ids(1, 2, 3, 4) and check == xxh64_intdigest(ids(1, 2, 3, 4)) & 0xFFFFFFFF


def test_damage_is_seen():
    raw = written([(i, ids(*range(i, i + 50))) for i in range(20)])
    for at in range(0, len(raw), 7):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        try:
            got = list(opened(bytes(bad)).documents(np.arange(20)))
        except (token_files.Corrupt, OSError):
            continue
        assert [b for _, _, b in got] == [ids(*range(i, i + 50)) for i in range(20)], at  # what is not read may differ
    with pytest.raises(token_files.Corrupt):
        opened(raw[:-1])


TEXTS = ["", None, "Hello  World", "x" * 3000, "the cat " * 4000, "Ünï çode\n\ttabs", "<|endoftext|> a", "the cat"]


@pytest.fixture
def docs(spark):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)], "s", 0) for i in range(101)] + [(5, "again", "s", 0), (5, "again", "s", 0), (5, "Other", "s", 0), (None, "no id", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


def plain(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    return [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows]


def test_folder_against_the_library(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE", 40_000)
    monkeypatch.setattr(token_files, "COMMON", 3)
    path = f"file://{tmp_path}/folder"
    token_files.save(docs, path)
    parts = json.loads(Path(tmp_path, "folder/_manifest.json").read_text())["parts"]
    assert len(parts) > 1 and sum(p["docs"] for p in parts) == docs.count()
    got = token_files.load(spark, path).orderBy("start", "n_tokens").collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [r.doc_id for r in got] == [i for i, _ in sorted(want, key=key)]
    assert sorted((key((r.doc_id,)), bytes(r.ids)) for r in got) == sorted((key((i,)), b) for i, b in want)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    some = token_files.load(spark, path).where(F.col("doc_id").isin(5, 8)).collect()
    assert sorted(bytes(r.ids) for r in some) == sorted(b for i, b in want if i in (5, 8))
    assert {r.doc_id for r in token_files.load(spark, path).where("doc_id >= 90 and doc_id < 93").collect()} == {90, 91, 92}


def test_a_bad_file_fails_the_query_and_strays_do_not(spark, docs, tmp_path):
    path = f"file://{tmp_path}/folder"
    token_files.save(docs, path)
    Path(tmp_path, "folder/part-000000-stray.ids.zst").write_bytes(b"left by a lost attempt")
    assert token_files.load(spark, path).count() == docs.count()
    file = next(p for p in Path(tmp_path, "folder").glob("part-*.zst") if "stray" not in p.name)
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 3] ^= 1
    file.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="Corrupt|frame|index"):
        token_files.load(spark, path).select(F.sum(F.crc32("ids"))).collect()


def test_query_and_empty_table(spark, sf, tmp_path):
    rows = token_files.op12_token_files(spark, sf).orderBy("doc_id").collect()
    want, at = plain(sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())), 0
    for r, (i, b) in zip(rows, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(b) // 4, crc32(b))
        at += len(b) // 4
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.op12_token_files(spark, str(tmp_path)).collect() == []


def test_words_together_are_words_apart():
    import random

    from loomlake.llm.bpe import Model

    model, rng = Model(Path(tokenizer_path()).read_text()), random.Random(2)
    pool = ["a", "Z", "é", "É", "ß", "İ", "'s", "n't", "9", "-", ".", "数", "🙂", "ﬁ", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "\u200b", "\x1c", " ", "\t"]
    for _ in range(150):
        words = model.words("".join(rng.choice(pool) for _ in range(rng.randrange(400))))
        assert token_files.word_ids(model, words) == {w: model.encode_word(w) for w in words}


def test_near_words_are_cut_as_the_library_cuts_them():
    import random
    from types import SimpleNamespace

    from loomlake.llm.bpe import Model

    model, rng = Model(Path(tokenizer_path()).read_text()), random.Random(3)
    near = [c for c in map(chr, range(0x300)) if not c.isspace() and model.tok.pre_tokenizer.pre_tokenize_str(c)]
    words = sorted({c for c in near} | {a + b for a in "a1-é'²ª\x7f" for b in near} | {"".join(rng.choices("'stremvld9.é_", k=rng.randint(1, 9))) for _ in range(3000)})
    want = {w: model.encode_word(w) for w in words}
    got = token_files.word_ids(model, words)
    assert got == want
    some = set(rng.sample(words, 500))
    assert token_files.word_ids(model, words, {w: want[w] for w in some}) == want

    class Spy:  # the library's splitter is slow: near words do without it
        def pre_tokenize_str(self, text):
            raise AssertionError(text)

    spied = SimpleNamespace(tok=SimpleNamespace(model=model.tok.model, pre_tokenizer=Spy()), dtype=model.dtype, near_units=model.near_units, encode_word=model.encode_word)
    assert token_files.word_ids(spied, words) == want
    with pytest.raises(AssertionError):
        token_files.word_ids(spied, ["数"])


def test_another_splitter_is_left_to_the_library():
    from loomlake.llm.bpe import Model

    spec = json.loads(Path(tokenizer_path()).read_text())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}|[^\s\p{L}]+"
    model = Model(json.dumps(spec))
    assert model.near_units is None
    words = ["they're", "a1b2", "é.é"]
    assert token_files.word_ids(model, words) == {w: model.encode_word(w) for w in words}
