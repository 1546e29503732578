"""Token ids against the public libraries that read the same vocabulary."""

import base64
import os

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arcweave.llm import bpe, tokens

# Fixed value: the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LINES = open(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"), "rb").read().splitlines()
PUBLIC = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES)}, special_tokens={})
OTHER = Tokenizer.from_file(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json"))
OTHER.encode_special_tokens = True

CASES = [
    "", " ", "  ", "\n", "\r\n\r\n", "a", " a", "  a", "a  b", "a \n b", "a\n", "'s", " 's", "x's", "''s", "'sx", "'s's", "'re'll", "don't I'LL we've 'tis", "x '", "'", "'r", "12 3a4", "½²٣", "é日本 ́x", "  x", "\x85a", "\x1c\x1d", "<|endoftext|>", "�\x00", "😀😀 's😀",
]


def ours(texts, window=2 << 20):
    ids, counts = bpe.encoder().encode_bytes([t.encode() for t in texts], window)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_cases_alone_and_together():
    expected = [PUBLIC.encode_ordinary(t) for t in CASES]
    assert [x.ids for x in OTHER.encode_batch(CASES, add_special_tokens=False)] == expected
    assert ours(CASES) == expected
    assert [ours([t])[0] for t in CASES] == expected
    assert ours([]) == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" '\n\ts treévlmd1! ", max_size=30)), max_size=6))
def test_any_texts(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert ours(texts) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_long_text_in_windows():
    text = "It's a  page, with 12 lines\n  and more — größer; " * 4000 + "x" * 5000
    assert ours([text, "a", text], window=1000) == [PUBLIC.encode_ordinary(t) for t in (text, "a", text)]
    parts = list(bpe.split_safely(text.encode(), 1000))
    assert b"".join(parts) == text.encode() and len(parts) > 50


def test_every_state_composition():
    """The scan's states are those of a walk through the automaton."""
    import numpy as np

    automaton = bpe.Automaton()
    symbols = np.random.default_rng(1).integers(0, 2 * bpe.FIRST, 5000).astype(np.uint8)
    state, expected = bpe.DONE, []
    for x in symbols:
        expected.append(state)
        state = bpe._step(state, int(x))[0]
    assert automaton.states_before(symbols).tolist() == expected
    assert automaton.states_before(symbols[:1]).tolist() == [bpe.DONE]


def test_cache_is_bounded():
    encoder = bpe.Encoder(cache=50)
    for k in range(5):
        texts = [f"word{k}{i} ".encode() for i in range(100)]
        ids, _ = encoder.encode_bytes(texts)
        assert ids.tolist() == [i for t in texts for i in PUBLIC.encode_ordinary(t.decode())]
    encoder.cache.trim()
    assert len(encoder.cache) <= 50


def test_invalid_bytes():
    column = pa.array([b"a\xffb", None, b""], pa.binary()).cast(pa.binary())
    assert bpe.utf8(column) == ["a�b".encode(), b"", b""]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, "It's here\n", "x"), (1, "It's here\n", "x"), (2, None, "x"), (3, "", "x"), (None, " ", "x"), (4, "größer 😀", None), (5, "ab " * 20_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_column(spark, documents):
    got = sorted(((r.doc_id or 0, r.ids) for r in tokens.encode(documents, "doc_id", "text").collect()), key=repr)
    assert got == sorted(((r.doc_id or 0, PUBLIC.encode_ordinary(r.text or "")) for r in documents.collect()), key=repr)
    assert tokens.encode(documents.limit(0), "doc_id", "text").collect() == []
    counts = {(r.doc_id, r.ids): r.n_tokens for r in tokens.count_tokens(documents, ["doc_id", "ids"], "text").collect()}
    assert counts[(2, "x")] == counts[(3, "x")] == 0 and counts[(None, "x")] == 1 and counts[(5, "x")] == len(PUBLIC.encode_ordinary("ab " * 20_000))


def test_offsets_and_decoding(spark, documents):
    rows = tokens.encode(documents, "doc_id", "text", offsets=True).collect()
    raw = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    for r in rows:
        pieces = [raw[r.doc_id][a:b] for a, b in zip([0, *r.ends], r.ends)]
        assert pieces == [PUBLIC.decode_single_token_bytes(i) for i in r.ids] and b"".join(pieces) == raw[r.doc_id]
    back = tokens.decode(tokens.encode(documents, "doc_id", "text"), "ids").collect()
    assert sorted(r.text for r in back) == sorted(t.decode() for t in [*raw.values(), raw[1]])


def test_other_vocabulary(spark, documents):
    multi = tokens.encode(documents, "doc_id", "text", vocabulary="byte_bpe_multi_50k").where("doc_id = 4").first().ids
    assert bpe.encoder(vocabulary="byte_bpe_multi_50k").decode(multi).decode() == "größer 😀"
