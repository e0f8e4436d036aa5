import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyarrow import orc
from tokenizers import Tokenizer

from lodestone.llm import op4_bpe, op6_orc, op9_packing
from lodestone.llm.tokens import CachedEncoder, encoder

ODD = ["", " ", "  two  spaces \n x", "a  b", "\xa0 x y\x85 z ", "it's They'LL  don't \n\n  x\t y", "١٢ ²³ ½ ÀÉ ǅ Σας İ é ́x", "<|endoftext|> a<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b <|startoftext|>c", "<|endoftext|>\n\n x <|endoftext", "<|END", "\x1c \x1f a  b", "漢字 かな😀 x", "A\rB \r\n C", "x" * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_is_the_library(name, rows):
    library = Tokenizer.from_file(P.path(name))
    texts = ODD + [r[1] or "" for r in rows]
    want = [np.array(e.ids, np.uint16).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder(name).encode(texts) == want
    small = CachedEncoder(P.path(name), "byte" in name)
    for table in (small.pieces, small.mids, small.heads):
        table.limit = 3  # full tables change nothing
    assert small.encode(texts) == want


def test_bpe_roundtrip(spark, odd, rows, empty):
    k = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op4_bpe.ranks(op4_bpe.FILE), special_tokens={})
    got = op4_bpe.encode_decode(odd, block_bytes=20_000).collect()
    want = [(r[0], np.array(k.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows]
    key = lambda r: (str(r[0]), r[2])
    assert sorted([(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got], key=key) == sorted(want, key=key)
    assert op4_bpe.encode_decode(empty).count() == 0


def test_orc_files(spark, odd, rows, empty, tmp_path):
    path = str(tmp_path / "ids")
    op6_orc.write_orc(odd, path, block_bytes=20_000)
    files = op6_orc.read_orc(spark, path)
    got = op6_orc.checksums(files).join(op6_orc.starts(files), "block").selectExpr("doc_id", "before + start as start", "n_tokens", "ids_crc32").orderBy("start").collect()
    library = Tokenizer.from_file(P.path(op6_orc.FILE))
    order = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert files.where("doc_id = 12").count() == sum(r[0] == 12 for r in rows)
    op6_orc.write_orc(empty, str(tmp_path / "none"))


def test_orc_prunes(spark, tmp_path):
    """Index strides are skipped by their least and largest ids, and ids that are not there by the Bloom filters; files have stripes."""
    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat('some words of text ', id) as text")
    path = str(tmp_path / "ids")
    op6_orc.write_orc(docs, path, block_bytes=200_000)
    parts = sorted((tmp_path / "ids").glob("*.orc"))
    files = [orc.ORCFile(str(f)) for f in parts]
    assert len(files) > 1 and all(f.nstripes >= 1 for f in files)
    ids = [i for f in files for i in f.read(columns=["doc_id"]).column("doc_id").to_pylist()]
    assert ids == list(range(0, 40_000, 2))  # ascending within files and by their names

    def scanned(where):
        df = op6_orc.read_orc(spark, path).where(where).select("doc_id")
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert scanned("doc_id is null or doc_id is not null") == 20_000
    assert 1 <= scanned("doc_id = 20000") <= 2 * op6_orc.ROW_INDEX
    assert scanned("doc_id = 20001") == 0


def check_packing(pieces, texts, window=2048):
    """Every id once, sequences gapless, no padding but at lengths that are no power of two."""
    library = Tokenizer.from_file(P.path(op9_packing.FILE))
    left = {}
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        left.setdefault((doc_id, len(ids)), []).append(ids)
    whole = sum(n * len(v) for (_, n), v in left.items())
    assert whole == sum(r["length"] for r in pieces)
    for (doc_id, n), copies in left.items():
        own = [r for r in pieces if r["doc_id"] == doc_id and r["doc_tokens"] == n]
        crcs = {(r["start"], r["length"], r["ids_crc32"]) for r in own}
        assert all(any(zlib.crc32(ids[s : s + m].tobytes()) == c for ids in copies) for s, m, c in crcs)
        cover = np.zeros(n, int)
        for r in own:
            cover[r["start"] : r["start"] + r["length"]] += 1
        assert (cover == len(copies)).all()
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark, odd, rows, empty):
    pieces = op9_packing.pack(odd).collect()
    assert check_packing(pieces, [(r[0], r[1]) for r in rows]) == 0
    assert op9_packing.pack(empty).count() == 0


@pytest.mark.parametrize("docs", [1, 7, 500, 20_000])
def test_plan_fills_windows(docs):
    rng = np.random.default_rng(4)
    lengths = np.minimum(1 + rng.exponential(700, docs).astype(int), 2047)
    counts = np.bincount(lengths, minlength=2049)
    made = op9_packing.plan(counts)
    total = int((counts * np.arange(2049)).sum())
    assert (made.taken <= counts).all() and made.windows == total // 2048
    r = np.sort(lengths)
    rank = np.arange(docs) - np.searchsorted(r, r)
    seen = {}
    for pieces in op9_packing.place(made, 2048, r, r, rank, np.zeros(docs, np.int64)):
        for _, length, window, offset in pieces:
            seen.setdefault(window, []).append((offset, length))
    for window, parts in seen.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or (window >= made.windows and at & (at - 1) == 0)
    assert sum(n for parts in seen.values() for _, n in parts) == total
    if docs == 20_000:
        assert made.solved > 0.5 * total and made.solved + made.fitted > 0.98 * total and made.cut < 0.02 * docs
        assert made.off <= 1e-3
    assert op9_packing.tail_cuts(1300) == [0, 1024, 1280, 1296, 1300]


def test_sha_of_ids(spark, sf):
    from lodestone.llm.queries import queries

    got = queries()["op4_bpe_roundtrip"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)
