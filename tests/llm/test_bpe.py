import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import bpe, queries

ODD = [None, "", " \n\t ", "one", "Ünïcode 😀 é <|endoftext|> İ", "x" * 40_000, " " * 9_000 + "y", "ab<|endoftext|>" * 900, "日本語" * 5_000, "á‍" * 4_000, "'s don't  we'll\n\n\n  x\t\t\t9,9.9!!" * 300]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts(rng, n):
    parts = ["the ", " of", "ing", "'s", "'", " ", "  ", "\n", "\n\n ", "\t", "<|endoftext|>", "<|", "|>", "endof", "é", "😀", "日本", "12", " 3.4", "!!", " --", " ", " ", "Ab", "zz"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(n)]


def test_joined_chunks_equal_the_library_whatever_the_cuts(library):
    """Cuts anywhere between characters, also inside words, runs of spaces and special tokens, and many in a few bytes."""
    rng, enc = random.Random(3), bpe.ChunkEncoder(bpe.default_path())
    for t in texts(rng, 1500):
        raw = t.encode()
        places = [k for k in range(1, len(raw)) if raw[k] & 0xC0 != 0x80]
        ends = sorted(rng.sample(places, min(len(places), rng.randrange(9)))) + [len(raw)]
        want = library.encode(t, add_special_tokens=False).ids
        assert enc.joined(raw, ends, enc.encode(bpe.chunks_of(raw, ends))).tolist() == want, (t, ends)
        assert [x.tolist() for x in enc.texts([(b"", []), (raw, ends), (raw, [len(raw)])], {})] == [[], want, want], (t, ends)


def test_characters_that_are_cut_into_units_here(library):
    """Every plain character, alone, doubled, and between letters, digits, marks and spaces, is cut as the library cuts it."""
    enc = bpe.ChunkEncoder(bpe.default_path())
    plain = [c for c in map(chr, range(0x600)) if bpe._PLAIN.fullmatch(c)]
    assert len(plain) > 1_080 and not set("\x1c\x85\xa0\x0b\x0c") & set(plain)
    texts = [t for c in plain for t in (c, c + c, f"a{c}b {c} 1{c}2 !{c}?  {c}{c}  '{c}\n{c}a")]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids, _ in enc.encode([t.encode() for t in texts])] == want


def test_units_start_anew_beyond_their_bound(library, monkeypatch):
    monkeypatch.setattr(bpe, "UNITS", 3)
    enc = bpe.ChunkEncoder(bpe.default_path())
    for t in ("a bc d e", "bc f", "g h i j bc", "", "k"):
        assert enc.encode([t.encode()])[0][0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_chunks_cover_texts_and_follow_their_content():
    rng = random.Random(5)
    prose = " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(20_000))
    column = pa.array([prose, "Another beginning. " * 30 + prose, None, "é" * 30_000], pa.string())
    got = list(bpe.chunked(column.slice(0, 4)))
    for (text, ends), t in zip(got, column.to_pylist(), strict=True):
        assert text == (t or "").encode() and (ends[-1:] or [0]) == [len(text)]
        sizes = np.diff([0, *ends])
        assert (sizes <= bpe.MOST).all() and (sizes[:-1] >= min(bpe.LEAST, bpe.MOST - 3)).all()
        assert b"".join(bpe.chunks_of(text, ends)) == text and all(c.decode() is not None for c in bpe.chunks_of(text, ends))
    a, b = (set(bpe.chunks_of(*x)) for x in got[:2])
    assert len(a & b) > 0.95 * len(a)
    assert [x[1] for x in bpe.chunked(column.slice(1, 1))] == [got[1][1]]


def test_blocks_of_the_hash_make_no_difference(monkeypatch):
    data = np.random.default_rng(1).integers(32, 120, 50_000, dtype=np.uint8)
    whole = bpe._candidates(data).tolist()
    monkeypatch.setattr(bpe, "BLOCK", 777)
    assert bpe._candidates(data).tolist() == whole and len(whole) > 20


@pytest.mark.parametrize("most", [0, 4_000, bpe.DICTIONARY])
def test_table_equals_the_library(spark, library, most):
    rng = random.Random(11)
    base = " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(3_000))
    rows = [t for t in ODD] + [base, base, "Before. " + base, base[:9_000] + " inserted " + base[9_000:]] + texts(rng, 40)
    docs = spark.createDataFrame([(k if k % 7 else None, t, "old", k) for k, t in enumerate(rows)], "doc_id bigint, text string, ids string, digest int").repartition(3)
    encoded = bpe.encode(docs, most=most).cache()
    assert encoded.columns == ["doc_id", "digest", "ids"]
    got = {r.digest: r.ids for r in encoded.collect()}
    assert got == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(rows)}
    back = {r.digest: r.text for r in bpe.decode(encoded).collect()}
    assert back == {k: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for k, t in enumerate(rows)}


def test_shared_chunks_are_chosen_by_what_they_save(spark):
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(n))
    often, seldom = line(2_000), line(2_000)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([often] * 50 + [seldom] * 2 + [line(400) for _ in range(20)])], "doc_id bigint, text string")
    counts = bpe.chunk_counts(docs)
    n = {bytes(r.digest): r.n for r in counts.collect()}
    assert set(n.values()) == {2, 50}
    assert set(bpe.chosen(counts)) == set(n)
    few = bpe.chosen(counts, most=len(often) + 64 * len(n))
    assert few and all(n[k] == 50 for k in few)
    made = bpe.dictionary(docs, bpe.default_path())
    assert set(made) == set(n)


def test_empty_table_and_broken_bytes(spark, library):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(empty)).collect() == []
    broken = spark.createDataFrame([(1, b"a\xff b")], "doc_id bigint, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    assert bpe.encode(broken).first().ids == library.encode("a� b", add_special_tokens=False).ids


def test_query_digests(spark, sf, library):
    got = {r.doc_id: r for r in queries.op13_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
