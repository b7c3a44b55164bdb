"""Encoding, decoding, token files and packing against the libraries on whole texts."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netfell.llm import bytebpe, packing, piececache, tokenfile
from netfell.llm.piececache import PieceEncoder
from tests.llm.conftest import odd_rows

WORD, BYTE, MULTI = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


def whole(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a", "a  b", "\n\n\nB c\n", "naïve ﬁ ½ é́x É é", "I'll don't WE'RE 'S x's", "漢字 한글 각", "x\x1cy \x1f z\x85w", "İ ΑΣ ς", "a\tb\r\nc", "<|endoftext|>", "12 1.5 a1b2", "µ ª º ß ÿ × ÷", "</w> w</w>", "a ", "é ́y", "!!  ??", "\u2016 a\u2016b"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_give_the_whole_texts_ids(path, monkeypatch):
    texts = ODD + [f"{a} {b}" for a in ODD for b in ODD] + [r[1] for r in odd_rows()]
    monkeypatch.setattr(piececache, "SEGMENT", 2000)
    got = PieceEncoder(path).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == whole(path)(texts)


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("most", [1, 4000, 40_000])
def test_a_full_table_forgets_but_still_encodes(path, most):
    own, texts = PieceEncoder(path, most=most), [r[1] for r in odd_rows()] + ODD
    want = whole(path)(texts)
    for _ in range(2):
        for at in range(0, len(texts), 7):
            got = own.encode(texts[at : at + 7])
            assert [np.frombuffer(g, "<u2").tolist() for g in got] == want[at : at + 7]
            assert own.held <= most
            assert own.held == sum(piececache.PART_BYTES + len(p) for p in own.known)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé '.\n\t1漢́\u00a0"), max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    for path in (WORD, BYTE):
        assert [np.frombuffer(g, "<u2").tolist() for g in piececache.encoder(path).encode(texts)] == whole(path)(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_ranks_round_trip(ranks):
    control, data = tokenfile.pack_ranks(np.array(ranks, np.uint32))
    assert tokenfile.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)).tolist() == ranks
    assert len(data) == sum(max(1, (r.bit_length() + 7) // 8) for r in ranks) + -len(ranks) % 4


def test_token_file(odd, none):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = tokenfile.token_file(odd, WORD).collect()
    assert len(got) == len(rows)
    at, want = 0, defaultdict(list)
    groups = defaultdict(list)
    for r, ids in zip(rows, whole(WORD)([r[1] for r in rows]), strict=True):
        groups[r[0]].append(ids + [1])
    for doc, lists in groups.items():
        for ids in lists:  # equal doc_ids here have equal texts
            want[doc].append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == want
    assert tokenfile.token_file(none, WORD).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(bytebpe.CHUNK, bytebpe.OVERLAP), (200, 16)])
def test_chunks_stitch_to_whole_texts(odd, none, multi, chunk, overlap):
    rows = odd_rows()
    want = sorted((str(r[0]), multi.encode_ordinary(r[1] or "")) for r in rows)
    encoded = bytebpe.encode(odd, MULTI, P.PATTERN, chunk, overlap)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()) == want
    back = bytebpe.decode(encoded, MULTI, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.data)) for r in back) == sorted((str(r[0]), (r[1] or "").encode()) for r in rows)
    assert bytebpe.encode(none, MULTI, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '.\n\t1漢ls"), max_size=120), st.integers(1, 20), st.integers(1, 8))
def test_stitching(text, chunk, overlap):
    own = bytebpe.encoder(MULTI, P.PATTERN)
    parts = []
    for at, part in bytebpe.chunks(text, chunk, overlap):
        ends = bytebpe.sure_ends(part, own.ends(part), at + len(part) == len(text))
        parts.append((at, [at + e for e in ends]))
    assert bytebpe.stitch(parts, len(text)) == own.ends(text)


def test_digests(odd, multi):
    row = next(r for r in bytebpe.digests(odd, MULTI, P.PATTERN).collect() if r.doc_id == 65)
    text = next(r[1] for r in odd_rows() if r[0] == 65)
    ids = multi.encode_ordinary(text)
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def check_packing(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(odd, none):
    rows = packing.pack_documents(odd, BYTE).collect()
    n = check_packing(rows, 1024)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 1024) + 2
    have = defaultdict(list)
    for r in rows:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    docs = odd_rows()
    for doc, ids in zip((r[0] for r in docs), whole(BYTE)([r[1] for r in docs]), strict=True):
        raw = np.array([*ids, 2], "<u4").tobytes()
        copies = sum(d[0] == doc for d in docs)
        own = sorted(have[doc])[::copies]
        assert [p[0] for p in own] == list(range(len(own))) and [p[2] for p in own[1:]] == [1024] * (len(own) - 1)
        assert all(zlib.crc32(raw[4 * s : 4 * (s + k)]) == c for _, s, k, c in own) and sum(p[2] for p in own) == len(raw) // 4
    assert packing.pack_documents(none, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_hold_every_length_once(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    planned = packing.plan(histogram)
    used = np.zeros(65, int)
    for pattern, n in planned:
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] += n
    assert (used == histogram).all()
    places = packing.Places(planned, 64)
    seen = set()
    for n in set(lengths):
        for s, o in zip(*places.find(n, np.arange(histogram[n])), strict=True):
            assert not {(s, x) for x in range(o, o + n)} & seen
            seen |= {(s, x) for x in range(o, o + n)}


def test_plan_is_near_the_bound_on_even_lengths():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 1025, 50_000), minlength=1025)
    n = sum(k for _, k in packing.plan(histogram))
    assert n <= 1.005 * np.ceil((histogram * np.arange(1025)).sum() / 1024)
