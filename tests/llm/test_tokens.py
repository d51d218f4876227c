from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import frame, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from prismal.llm import bpe, huffman_store, tier_packing, token_counts

PATH = bpe.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


texts = st.lists(st.sampled_from([*"ab é1'ls\n\n \t .,#漢\u00a0\u3000\U0001f600\x1c\x00\x01Ž", "<|endoftext|>", "  ", " the", "Ċ", "Ġ", "\n\n", "'ll", "wörd.", "end.\nNew"]), max_size=30).map("".join)


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_pieces_encode_as_the_library(text):
    tok = bpe.encoder(PATH)
    want = tok.tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tok.encode(text), "<u4").tolist() == want
    assert bpe.counter(PATH).count(text) == len(want)


def test_merging_is_leftmost_of_the_lowest_rank():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "aa"): 2}
    assert bpe.merge_count(list("aaa"), ranks) == 2
    assert bpe.merge_count(list("baaa"), ranks) == 2
    assert bpe.merge_count(["a"], ranks) == 0


def test_counts(spark, library):
    rows = odd_rows()
    out = token_counts.count_tokens(frame(spark, rows), PATH).collect()
    want = sorted(((i or -1), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted(((r["doc_id"] or -1), r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in out)
    assert token_counts.count_tokens(frame(spark, rows).limit(0), PATH).count() == 0


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(spark, library):
    rows = [(i, t) for i, (_, t, *_) in enumerate(odd_rows())] + [(100 + k, prose(random.Random(k), 5 * k)) for k in range(60)]
    ids = {i: whole(library, t) for i, t in rows}
    out = tier_packing.pack(frame(spark, rows), PATH).collect()
    at, ends = {}, {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at.get(r["doc_id"], 0) and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in ends.values())
    assert tier_packing.pack(frame(spark, rows).limit(0), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60), st.sampled_from([4, 64, 4096]))
def test_packer_fills_every_sequence(sizes, pool):
    p = tier_packing.TierPacker(pool=pool)
    for k, n in enumerate(sizes):
        p.add(k, n)
    p.finish()
    done = p.take()
    assert all(sum(n for _, _, n in pieces) == w and w & (w - 1) == 0 for w, pieces in done)
    covered = sorted((k, s, n) for _, pieces in done for k, s, n in pieces)
    at = {}
    for k, s, n in covered:
        assert s == at.get(k, 0)
        at[k] = s + n
    assert at == dict(enumerate(sizes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=80), st.integers(7, 18))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    lengths = huffman_store.code_lengths(counts, limit).astype(int)
    used = counts > 0
    assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max() <= limit
    if used.sum() > 1:
        assert sum(2.0**-x for x in lengths[used]) == 1


def test_code_lengths_are_as_good_as_huffman():
    import heapq

    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, 300)
    heap = list(map(int, counts))
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((huffman_store.code_lengths(counts, 18).astype(int) * counts).sum()) == cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=500))
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype="<u4")
    lengths = huffman_store.code_lengths(np.bincount(ids))
    marks, payload = huffman_store.encode_block(ids, huffman_store.canonical_codes(lengths), lengths)
    assert (huffman_store.decode_block(len(ids), marks, payload, huffman_store.decoding_table(lengths)) == ids).all()


def test_store(spark, library):
    rows = odd_rows() + [(100 + k, prose(random.Random(k), 3 * k)) for k in range(40)]
    out = huffman_store.round_trip(spark, frame(spark, rows), PATH).collect()
    want = sorted(((-1 if i is None else i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, *_ in rows for ids in [whole(library, t)])
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert huffman_store.round_trip(spark, frame(spark, rows).limit(0), PATH).count() == 0


def test_ids_are_counted_in_the_pass_that_tokenises(spark, library, monkeypatch):
    monkeypatch.setattr(huffman_store, "COUNT_IDS", 50)
    rows = odd_rows()
    written = huffman_store._ordered_ids(spark, frame(spark, rows), PATH, 0, 3)
    got = huffman_store.id_counts(written.drop("ids"))  # no id is read again
    want = np.bincount([i for _, t, *_ in rows for i in whole(library, t)])
    assert got.tolist() == want.tolist()
    assert written.where("seen is null").count() == len(rows)
    assert len(huffman_store.id_counts(huffman_store._ordered_ids(spark, frame(spark, rows).limit(0), PATH, 0, 3))) == 1


@pytest.mark.parametrize("most", [0, 3, 10_000])
def test_new_pieces_go_to_the_model_as_they_are(library, most, monkeypatch):
    letters = [c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº"]
    texts = ["".join(letters), *(f"{c}x a{c}b, {c}\n{c}{c}.\n\n{c}!" for c in letters), "one one, one\none one."]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    tok, asked = bpe.PieceEncoder(PATH, most), []
    whole_text = tok._whole
    monkeypatch.setattr(tok, "_whole", lambda t: asked.append(t) or whole_text(t))
    for _ in range(2):
        assert [np.frombuffer(tok.encode(t), "<u4").tolist() for t in texts] == want
    assert len(tok.pieces) <= most
    assert not any(c.isalpha() for t in asked for c in t)  # words never take the way of whole texts
