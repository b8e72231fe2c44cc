"""Token ids, token files, length histogram and packing against the plain
encoding of whole texts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm import length_histogram, packing, token_files, tokens
from llm.common import documents
from turnlens.session import scratch_dir

from odd_rows import collected, frame, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(5)
    letters = "aAbZ.,;:!?'\" \n\t\réÉßİΣσςıſḰ̈½9²ªº🙂日한-_/<|>"
    odd = ["", "éa b̈.", "İ:", "don't you're I'LL", "x..,, y!?", "ﬁ ǆ ẞ", "a\x85d\x1ce",
           "<|endoftext|> a<|startoftext|>b", "क़.", "क़. :", "ΑΣ. ς"]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, found in zip(odd, tokens.Encoder()(odd), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == ids_of(tokenizer, text).tolist(), text


def test_token_files_round_trip(spark, tokenizer):
    folder = scratch_dir(spark, "files")
    manifest = token_files.write(frame(spark), folder).cache()
    found = sorted(collected(token_files.read_digests(manifest, folder)),
                   key=lambda r: (r["start"]))
    plain = sorted(((i is not None, i or 0, zlib.crc32(x.tobytes()), len(x))
                    for i, t in rows() for x in [ids_of(tokenizer, t)]))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"], r["n_tokens"]) for r in found] == plain
    ends = np.cumsum([r["n_tokens"] for r in found])
    assert [r["start"] for r in found] == [0, *ends[:-1].tolist()]
    got = token_files.read_documents(manifest, folder, [7, 9, 404])
    assert got[404] == [] and len(got[9]) == 2
    assert got[7][0].tolist() == ids_of(tokenizer, dict(rows())[7]).tolist()


def test_damaged_frame_is_noticed(spark):
    import pyarrow.fs as pafs

    folder = scratch_dir(spark, "files")
    row = token_files.write(frame(spark, [(1, "some words here")]), folder).first()
    with open(row.path, "r+b") as f:
        data = bytearray(f.read())
        data[6] ^= 0xFF
        f.seek(0)
        f.write(data)
    with pafs.LocalFileSystem().open_input_file(row.path) as source, pytest.raises(Exception):  # noqa: B017
        list(token_files.FrameReader(source))


def test_several_frames_for_one_document(monkeypatch, tmp_path):
    writer = token_files.FrameWriter((tmp_path / "f").open("wb"), 2)
    import xxhash
    import zstandard
    ids = np.arange(1000, dtype="<u2")
    parts = [ids[:600].tobytes(), ids[600:].tobytes()]
    writer.add(3, [(zstandard.compress(p), len(p), xxhash.xxh64_intdigest(p) & 0xFFFFFFFF) for p in parts])
    writer.finish()
    writer.out.close()
    import pyarrow.fs as pafs
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        reader = token_files.FrameReader(source)
        assert reader.document(reader.find([3])[0]).tolist() == ids.tolist()


def test_empty_tables(spark):
    empty = frame(spark, [])
    folder = scratch_dir(spark, "files")
    assert token_files.read_digests(token_files.write(empty, folder), folder).count() == 0
    assert packing.pack(empty).count() == 0
    sums = length_histogram.suffix_sums(length_histogram.histogram(empty))
    assert sums.count() == 0
    assert length_histogram.at_limit(sums, 10) == {"docs_cut": 0, "tokens_kept": 0, "tokens_lost": 0}
    assert length_histogram.quantile(sums, 0.5) is None


def test_length_histogram(spark, tokenizer):
    sums = length_histogram.suffix_sums(length_histogram.histogram(frame(spark))).cache()
    n = np.array([len(ids_of(tokenizer, t)) for _, t in rows()])
    found = collected(sums)
    assert sorted(r["length"] for r in found) == sorted(set(n.tolist()))
    for r in found:
        limit = r["length"]
        assert r["n_docs"] == (n == limit).sum()
        assert (r["docs_from"], r["tokens_from"]) == ((n >= limit).sum(), n[n >= limit].sum())
        assert (r["docs_cut"], r["tokens_kept"]) == ((n > limit).sum(), np.minimum(n, limit).sum())
        assert r["share_up_to"] == pytest.approx((n <= limit).mean())
    for limit in (1, 17, 10_000_000):
        assert length_histogram.at_limit(sums, limit) == {
            "docs_cut": (n > limit).sum(), "tokens_kept": np.minimum(n, limit).sum(),
            "tokens_lost": np.maximum(n - limit, 0).sum()}
    for q in (0.1, 0.5, 1.0):
        assert length_histogram.quantile(sums, q) == np.quantile(n, q, method="inverted_cdf")


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert list(p.add(6, "a")) == [] and list(p.add(7, "b")) == []
    assert list(p.add(3, "c")) == [(1, 10, [("b", 0), ("c", 7)])]  # free 3, not 4
    assert list(p.add(8, "d")) == []
    assert list(p.add(5, "e")) == [(2, 8, [("d", 0)])]  # both in use: the fuller closes
    assert sorted(n for n, _, _ in p.rest()) == [0, 3]


def check_packing(found, texts, tokenizer, size):
    for r in found:
        ids = ids_of(tokenizer, texts[r["doc_id"]])[r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        assert r["start"] == r["piece"] * size
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, tokenizer):
    texts = {k: t for k, (_, t) in enumerate(rows())}
    found = collected(packing.pack(frame(spark, list(texts.items()))))
    assert {r["doc_id"] for r in found} == set(texts)
    total = sum(len(ids_of(tokenizer, t)) for t in texts.values())
    assert sum(r["length"] for r in found) == total
    assert check_packing(found, texts, tokenizer, 4096) == -(-total // 4096)
    assert packing.pack(frame(spark)).count() == len(found)  # null and equal ids pack row by row


def test_packing_comes_close_to_the_bound_over_many_tasks(spark, sf_small, tokenizer):
    docs = documents(spark, sf_small).repartition(40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = collected(packing.pack(docs, size=512, open_bins=16))
    total = sum(r["length"] for r in found)
    assert check_packing(found, texts, tokenizer, 512) <= 1.04 * -(-total // 512)
