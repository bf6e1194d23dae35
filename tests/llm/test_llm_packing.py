"""Packing: ids against the tokenizers library, places against their rules, round trips."""

import random
import zlib

import fixture
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fieldtrial.llm import packing, token_output
from fieldtrial.llm.tokens import TOKENIZER, encoder, pieces

AWKWARD = ["", " ", "a\u0085b c", "naïve café — “q”", "\x1c\x1d x", "<|endoftext|> y", "日本語 текст 🙂", "I'll we've  don't\n\n\tx ", "12345 67.8"]


def exact_ids(text):
    exact = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    exact.encode_special_tokens = True
    return exact.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_the_library():
    encode = encoder()
    for text in AWKWARD + [t or "" for t in fixture.texts()]:
        assert encode(text).tolist() + [2] == exact_ids(text)


def test_pieces():
    assert pieces(5, 8) == [(0, 5)] and pieces(8, 8) == [(0, 8)]
    assert pieces(16, 8) == [(0, 8), (8, 8)]
    assert pieces(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_plan_uses_every_length_and_is_tight():
    rng = random.Random(3)
    for size, n in ((64, 4000), (64, 30), (1024, 3000)):
        lengths = [rng.choice((rng.randrange(1, size + 1), rng.randrange(1, size // 4))) for _ in range(n)]
        counts = {}
        for x in lengths:
            counts[x] = counts.get(x, 0) + 1
        used, rows = {}, 0
        for group, times in packing.plan(counts, size):
            assert sum(group) <= size
            rows += times
            for x in group:
                used[x] = used.get(x, 0) + times
        assert used == counts
        least = -(-sum(lengths) // size)
        assert rows <= least * 1.01 + 1


def test_packed_documents(spark):
    docs = fixture.documents()
    docs.loc[len(docs)] = docs.loc[20]  # a repeated row
    df = spark.createDataFrame(docs).repartition(5)
    rows = packing.pack_documents(df, scratch=None).collect()
    ids = {r.doc_id: exact_ids(r.text) for r in docs.itertuples()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, own in ids.items():
        times = (docs.doc_id == doc_id).sum()
        expected = [(k, s, n) for k, (s, n) in enumerate(pieces(len(own), 1024))] * times
        assert sorted(by_doc[doc_id]) == sorted(expected)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_matrices_round_trip(spark, tmp_path):
    docs = fixture.documents()
    df = spark.createDataFrame(docs).repartition(3)
    blocks = token_output.write_packed(df, f"{tmp_path}/packed", size=256, block_tokens=5000)
    back = {}
    for b in blocks.collect():
        flat = np.frombuffer(b.ids, "<u2")
        assert len(flat) == b.n_rows * 256
        used = np.zeros(len(flat), bool)
        for doc, start, at, end, crc in zip(b.doc_ids, b.starts, b.position_resets, b.cu_seqlens, b.crc32s):
            assert at // 256 == (end - 1) // 256 and not used[at:end].any()
            used[at:end] = True
            own = flat[at:end].astype("<u4")
            assert zlib.crc32(own.tobytes()) == crc
            back.setdefault(doc, []).append((start, own.tolist()))
        assert not flat[~used].any()
    for r in docs.itertuples():
        assert sum((p for _, p in sorted(back[r.doc_id])), []) == exact_ids(r.text)
    assert token_output.segments(blocks).count() == sum(map(len, back.values()))
    assert token_output.write_packed(df.limit(0), f"{tmp_path}/none").count() == 0


def test_segment_tree_finds_the_tightest_row():
    rng = random.Random(2)
    space, held = token_output.FreeSpace(50), []
    for row in range(400):
        if rng.random() < 0.6:
            capacity = rng.randrange(0, 51)
            space.push(capacity, row)
            held.append(capacity)
        need = rng.randrange(1, 51)
        fits = [c for c in held if c >= need]
        found = space.pop(need)
        assert (found[0] if found else None) == (min(fits) if fits else None)
        if found:
            held.remove(found[0])
