"""Operators 1 and 8 against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from elotrail.llm import encoding, pfor
from elotrail.llm.queries import tokenizer_path
from elotrail.llm.token_counts import token_counts
from elotrail.llm.token_files import document_digests, read_token_files, write_token_files

PARTS = [" ", "  ", "\n", "a", "Bc", "é", "$", "<|endoftext|>", "'s", "1", "\t", "日本", "x y",
         "　", "\x1c", "\u180e", "don't", "The.\nThed", "éü$$", "😀", "word, ", ".\n "]
TEXTS = [None, "", " ", "one", "one two  three\n four <|endoftext|> five", "word " * 3000 + "end",
         "x" * 5000, "same text", "same text"]


def library(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("limit", [1 << 20, 7])
def test_encoder_gives_the_library_ids(limit, monkeypatch):
    rng = random.Random(limit)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    monkeypatch.setattr(encoding.segments, "__defaults__", (limit,))
    monkeypatch.setattr(encoding, "CACHE_PIECES", 500)  # emptied again and again
    enc = encoding.Encoder(tokenizer_path())
    assert enc.cut_safely
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == library(texts)


ODD = [*"aZé×÷ßÿĀжع中 '.,!?;_-09²½", "\n", "\r", "\t", "\x0b", "\x0c", "\x1c", "\x00", "\x7f", "\x85",
       "\u00a0", "\u0301", "\u1680", "\u180e", "\u2003", "\u2019", "\u201c", "\u2028", "\u202f",
       "\u205f", "\u3000", "\u3001", "\ufeff", "😀", "<|endoftext|>", "<|endof", "'re", "'S", " ", " ", "\n"]


@pytest.mark.parametrize("group", [1 << 22, 40])
def test_cuts_between_any_two_characters(group, monkeypatch):
    texts = [x + y + z + "b" for x in ODD for y in ODD for z in ("", " ", "\n", "'")]
    rng = random.Random(group)
    texts += ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(6000)]
    monkeypatch.setattr(encoding, "GROUP_BYTES", group)
    monkeypatch.setattr(encoding.segments, "__defaults__", (15,))
    enc = encoding.Encoder(tokenizer_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == library(texts)


def asked(enc, texts):
    """The bytes that the library is given for these texts."""
    sent, give = [], enc.encode_batch
    enc.encode_batch = lambda xs: sent.extend(xs) or give(xs)
    try:
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
    finally:
        enc.encode_batch = give
    assert got == library(texts)
    return len("".join(sent).encode())


def test_known_words_with_new_marks_are_not_encoded_again():
    enc = encoding.Encoder(tokenizer_path())
    assert asked(enc, ["one wordabcd other.\nNext größe, last"]) > 0
    assert asked(enc, ["one wordabcd. other,\nNext größe last", "one, größe.\nNext wordabcd"]) == 0


def test_a_full_cache_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_PIECES", 200)
    enc = encoding.Encoder(tokenizer_path())
    asked(enc, ["x steadyword steadyother"])
    for i in range(50):
        new = "".join(f" w{'abcdefghij'[k]}{'klmnopqrst'[i % 10]}{'uvwxy'[i // 10]}" for k in range(10))
        assert asked(enc, [f"x steadyword steadyother{new}"]) <= len(new)
        assert len(enc.cache) + len(enc.older) <= 400


def test_long_pieces_are_not_kept():
    enc = encoding.Encoder(tokenizer_path())
    list(enc.encode(["short " + "x" * 5000]))
    assert max(map(len, enc.cache)) <= encoding.CACHE_BYTES


def test_segments_join_to_the_text_at_safe_boundaries():
    text = "ab cd  ef gh\n ij kl"
    for limit in range(1, 20):
        parts = list(encoding.segments(text, limit))
        assert "".join(parts) == text
        assert all(p[0] == " " and not p[1].isspace() for p in parts[1:])


def test_batches_are_balanced_by_bytes():
    batches = list(encoding.byte_batches(["x" * 10] * 10 + ["y" * 100], 30))
    assert [len(b) for b in batches] == [3, 3, 3, 2]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(name):
    enc = encoding.Encoder(tokenizer_path(name))
    texts = ["Hello  world", "", " a b", "Größe 12"]
    if name.endswith(".model"):
        import sentencepiece
        want = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(texts)
    else:
        from tokenizers import Tokenizer
        want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(
            texts, add_special_tokens=False)]
    assert not enc.cut_safely
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want


def test_token_counts(spark):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")  # a clashing name
    out = {r["doc_id"]: r for r in token_counts(docs, tokenizer_path(), limit=100).collect()}
    want = library(TEXTS)
    for i, t in enumerate(TEXTS):
        assert out[i]["n_tokens"] == len(want[i])
        assert out[i]["n_bytes"] == len((t or "").encode())
        assert out[i]["over_limit"] == (len(want[i]) > 100)
    assert token_counts(docs.limit(0), tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70), st.integers(0, 2**32 - 1)), max_size=3000))
def test_pfor_round_trip(values):
    ids = np.array(values, np.uint32)
    data = pfor.encode(ids)
    assert pfor.decode(data).tolist() == values
    assert pfor.decode(data, 1, 2).tolist() == values[pfor.BLOCK:2 * pfor.BLOCK]


def test_pfor_outliers_do_not_widen_a_block():
    ids = np.full(pfor.BLOCK, 7, np.uint32)
    ids[::100] = 2**32 - 1
    data = pfor.encode(ids)
    assert len(data) < 200 and pfor.decode(data).tolist() == ids.tolist()


def digests(spark, docs, tmp_path, name):
    path = str(tmp_path / name)
    write_token_files(docs, path, tokenizer_path())
    return document_digests(read_token_files(spark, path))


def test_token_files_read_back(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[0] = None
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in zip(ids, texts)],
                                 "doc_id long, text string, part int, start int").repartition(5)
    out = sorted(map(tuple, digests(spark, docs, tmp_path, "a").collect()),
                 key=lambda r: (r[0] is not None, r[0]))
    at = 0
    by_id = sorted(zip(ids, library(texts)), key=lambda r: (r[0] is not None, r[0]))
    for row, (i, tokens) in zip(out, by_id, strict=True):
        tokens = np.array([*tokens, 0], "<u4")
        assert row == (i, at, len(tokens), zlib.crc32(tokens.tobytes()))
        at += len(tokens)


def test_token_files_of_repeated_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    out = digests(spark, docs, tmp_path, "b").orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [1, 1, 1, 2]
    assert [r["start"] for r in out] == [0, 2, 4, 6] and out[3]["n_tokens"] == 1
    assert digests(spark, docs.limit(0), tmp_path, "c").count() == 0
