"""Token counts, packing and SentencePiece against the libraries themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelloom.llm import bytebpe, packing, sentpiece, tokencount
from pixelloom.llm.queries import op7_sentencepiece, op8_token_counts, op9_best_fit_packing

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
CHUNKS = [" ", " ", "  ", "\n", "\t", "a", "The", "'s", " '", "1", "23", "!", "é", "é", "\xa0", "　", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>", "▁", "\x00", "​", "", "日本", "🎉", "\r\n", "ﬁ", "İ", "Σ", "ς", "thing", "ing"]
texts = st.lists(st.sampled_from(CHUNKS), max_size=30).map("".join)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_pre_tokens_count_alone(word):
    assert tokencount.splits_at_space(WORD) and not tokencount.splits_at_space(BYTE)
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice(CHUNKS) for _ in range(rng.randrange(25)))
        parts = t.encode().split()
        assert sum(tokencount.encode_lengths(WORD, parts)) == len(word.encode(t, add_special_tokens=False).ids), repr(t)


def test_joined_lengths(word):
    rng = random.Random(2)
    parts = ["".join(rng.choice([*CHUNKS, "~", "x~", "|", "'", "ll", "\u0301"]) for _ in range(rng.randrange(1, 8))) for _ in range(4000)]
    parts = [q for p in parts for q in p.encode().split()] + [b"~", b"~~", b"z" * 5000]
    assert tokencount.encode_lengths(WORD, parts) == [len(word.encode(p.decode(), add_special_tokens=False).ids) for p in parts]


def test_counts_with_a_tiny_cache(spark, docs, prose, word, monkeypatch):
    rows = [(i, prose(200, i)) for i in range(5)]
    second = {b"kept": 1}
    monkeypatch.setattr(tokencount, "CACHE", 3)
    got = tokencount._lengths([b"kept", b"other", b"alpha", b"more"], {b"more": 1}, second, WORD)
    assert got.tolist() == [1, *(len(word.encode(w, add_special_tokens=False).ids) for w in ("other", "alpha")), 1] and len(second) <= 3
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs(rows), WORD, table_size=2).collect()}
    assert got == {i: len(word.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_count_query(spark, docs, awkward, prose, word, tmp_path, monkeypatch):
    rows = [*awkward, *[(100 + i, prose(300, i)) for i in range(20)]]
    docs(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op8_token_counts(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in rows:
        n = len(word.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 2048)
    assert got == want and got[8][2]


def test_count_needs_a_splitting_tokenizer(docs):
    with pytest.raises(ValueError, match="white space"):
        tokencount.count_tokens(docs([]), BYTE)


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_byte_ids(batch):
    tok = tokencount.load(BYTE)
    assert bytebpe.token_ids(batch, BYTE) == [tok.encode(t, add_special_tokens=False).ids for t in batch]


def test_byte_ids_with_a_tiny_cache(monkeypatch, byte):
    monkeypatch.setattr(bytebpe, "CACHE", 20)
    monkeypatch.setattr(bytebpe, "_encoders", {})
    rng = random.Random(4)
    for _ in range(300):
        batch = ["".join(rng.choice(CHUNKS) for _ in range(rng.randrange(25))) for _ in range(10)] + ["z" * 700]
        assert bytebpe.token_ids(batch, BYTE) == [byte.encode(t, add_special_tokens=False).ids for t in batch]


def test_byte_ids_need_a_byte_level_tokenizer():
    with pytest.raises(ValueError, match="byte-level"):
        bytebpe.Encoder(WORD)


def held(fillings):
    out = Counter()
    for filling, times in fillings.items():
        for s, n in filling:
            out[s] += n * times
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_plans_hold_the_histogram(counts):
    plan = packing.plan(counts, 40, tries=((10, 10.0, 1.0), (10, 10.0, 0.0)))
    assert held(plan) == Counter(counts) and all(sum(s * n for s, n in f) <= 40 for f in plan)
    assert held(packing.best_fit(counts, 40)) == Counter(counts)
    _, _, bound = packing.configuration_lp(counts, 40, 20)
    assert bound <= sum(plan.values()) + 1e-6


def test_knapsack_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        price = np.concatenate([[0], rng.random(15) * (rng.random(15) < 0.6)])
        best, took = packing.knapsack(price, 15)
        slow = [0.0] * 16
        for room in range(1, 16):
            slow[room] = max([slow[room - 1], *(slow[room - s] + price[s] for s in range(1, room + 1) if price[s] > 0)])
        assert np.allclose(best, slow)


def test_program_beats_plain_best_fit():
    counts = {1025: 1000, 600: 1000, 424: 500}
    plan, plain = packing.plan(counts, 2048), packing.best_fit(counts, 2048)
    assert sum(plan.values()) < sum(plain.values()) and sum(plan.values()) <= 1.02 * packing.configuration_lp(counts, 2048, 100)[2]


def test_the_program_makes_the_plan(byte):
    """On real lengths a twentieth of the pieces at most is left to best-fit, and the plan is near the dual bound."""
    texts = [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).to_pylist()]
    lengths = [(len(ids) % 2048) + 1 for ids in bytebpe.token_ids(texts, BYTE)]
    counts = {s: n for s, n in Counter(lengths).items() if s < 2048}
    chosen, left = packing.rounded(counts, 2048, *packing.TRIES[0])
    assert sum(left.values()) <= 0.05 * sum(counts.values()) and held(chosen) + left == Counter(counts)
    assert sum(packing.plan(counts, 2048).values()) <= 1.01 * packing.configuration_lp(counts, 2048, 50)[2]


def check_packing(rows, got, byte, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids = byte.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            assert r["start"] == at and (r["length"] == capacity or r["piece"] == 0)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert set(by_doc) == {i for i, _ in rows}
    return len(by_sequence)


def test_packing_query(spark, docs, awkward, prose, byte, tmp_path):
    rows = [*awkward, *[(100 + i, prose(20 + 37 * i, i)) for i in range(50)]]
    docs(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_best_fit_packing(spark, str(tmp_path)).collect()
    n = check_packing(rows, got, byte)
    assert n == -(-sum(r["length"] for r in got) // 2048)


def test_packing_of_hot_lengths_and_repeated_rows(spark, docs, byte):
    rows = [(1, "one two three"), (1, "one two three")] + [(i, "four five") for i in range(2, 400)]
    cut = packing.pieces(docs(rows), BYTE, 64)
    got = packing.pack(packing.C.stored(cut, "test"), 64, groups=8, least=50).collect()
    assert len(got) == 400 and len({(r["sequence_id"], r["offset"]) for r in got}) == 400
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [q(spark, str(tmp_path)).count() for q in (op7_sentencepiece, op8_token_counts, op9_best_fit_packing)] == [0, 0, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_pieces(batch):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    p = sentpiece.load(PIECE)
    got = sentpiece.encode_texts(batch, PIECE)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == lib.encode(batch)
    assert [sentpiece.decode_ids(x, p) for x in got] == [lib.decode(lib.encode(t)) for t in batch]


def test_long_chunks_and_tiny_cache(monkeypatch, sp):
    monkeypatch.setattr(sentpiece, "CACHE", 10)
    monkeypatch.setattr(sentpiece, "TEXT", 50)
    rng = random.Random(8)
    batch = ["".join(rng.choice("theinganor123é") for _ in range(n)) for n in (255, 256, 257, 1000, 5000)] + ["   " * 100 + "x", "word " * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in sentpiece.encode_texts(batch, PIECE)] == sp.encode(batch)


def test_long_chunks_over_many_windows(sp):
    p, rng = sentpiece.load(PIECE), random.Random(11)
    chunks = ["▁" + "".join(rng.choice("theinganorstéaaa1") for _ in range(n)) for n in (3, 300, 1500, 256, 257, 2)]
    codes = np.frombuffer("\0".join(chunks).encode("utf-32-le") + b"\0\0\0\0", "<u4")
    assert np.array_equal(sentpiece._edges(codes, p, 50), sentpiece._edges(codes, p))
    got = sentpiece.encode_chunks(chunks, p)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [sp.encode(c[1:]) for c in chunks]


def test_other_models_are_refused():
    spec = sentencepiece.SentencePieceProcessor(model_file=PIECE).serialized_model_proto()
    sentpiece.check("x", spec)
    fields = sentpiece._fields(spec)
    assert len(fields[1]) == 32000 or len(fields[1]) > 1000
    for changed in (b"", b"\x12\x02\x18\x01", spec + b"\x12\x05\x18\x01\x98\x02\x01", spec + b"\x1a\x02\x18\x00"):
        with pytest.raises(ValueError, match="lacks"):
            sentpiece.check("x", changed)


def test_suffix_array_finds_every_occurrence():
    rng = random.Random(9)
    text = "".join(rng.choice("ab\0") for _ in range(300))
    codes = np.array([ord(c) for c in text], np.uint32)
    order = sentpiece.suffix_array(codes, 8)
    patterns = ["a", "ab", "aba", "bb", "abab", "bbbbb", "zz"]
    chars = np.zeros((len(patterns), 7), np.uint32)
    for i, t in enumerate(patterns):
        chars[i, : len(t)] = [ord(c) for c in t]
    lo, hi = sentpiece.occurrence_ranges(codes, order, chars, np.array([len(t) for t in patterns]))
    for t, a, b in zip(patterns, lo, hi):
        assert sorted(order[a:b].tolist()) == [i for i in range(len(text)) if text.startswith(t, i)]


def test_piece_operators_on_awkward_rows(spark, docs, awkward, sp, tmp_path):
    docs(awkward, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    encoded = sentpiece.encode(docs(awkward, extra=True), PIECE)
    texts_ = {i: t or "" for i, t in awkward}
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: sp.encode(t) for i, t in texts_.items()}
    assert {r["doc_id"]: r["text"] for r in sentpiece.decode(encoded, PIECE).collect()} == {i: sp.decode(sp.encode(t)) for i, t in texts_.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in op7_sentencepiece(spark, str(tmp_path)).collect()}
    assert got == {i: (len(sp.encode(t)), zlib.crc32(np.array(sp.encode(t), "<u4").tobytes())) for i, t in texts_.items()}
