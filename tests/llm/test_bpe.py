"""op8's fragments against the library on odd texts, and how few words the recursive query is asked for."""

import base64
import random

import pyarrow as pa
import pytest

from statrill.llm import bpe, pretokens

from .test_fragments import SIGNS

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, memos, tokenizer):
    for text, (ids, held) in zip(texts.to_pylist(), bpe.encoded(texts, *memos), strict=True):
        assert ids == " ".join(map(str, tokenizer.encode_ordinary(text))) and held == text.encode(), text


def test_fragments_give_the_ids_and_bytes_of_whole_texts():
    rng, memos, tokenizer = random.Random(5), bpe.coder(PATH, P.PATTERN)[1:], library()
    texts = ["", " ", "\n", "x" * 3000, "дом и сад " * 50, *("".join(rng.choices(SIGNS[:k], k=rng.randint(1, 30))) for k in (39, len(SIGNS)) for _ in range(2000)), *("".join(x) for x in zip(*[iter(rng.choices("a'7. \n", k=12_000))] * 6, strict=True)), ""]
    array = pa.array(["before", *texts])[1:]
    for part in (array, array[7:900], pa.array(["", ""]), array[:0]):
        check(part, memos, tokenizer)
    small = [pretokens.Memo(x.fill, 5) for x in memos]
    for part in pretokens.parts(array, 300):
        check(part, small, tokenizer)


def test_a_word_is_one_entry_whatever_sign_follows_it(monkeypatch):
    """Not one for each sign, as where texts are split at spaces only; the words of long fragments are known, too."""
    merges, *memos = bpe.coder.__wrapped__(PATH, P.PATTERN)
    asked, encode = [], merges.encode
    monkeypatch.setattr(merges, "encode", lambda words: asked.extend(words) or encode(words))
    texts = pa.array([*(f"See qwertz{sign} The qwertz{sign}\nAnd" for sign in ".,;:!?%$"), "ещё слово " * 40])
    check(texts, memos, library())
    assert [x for x in memos[0] if "qwertz" in x] == [" qwertz"] and len(memos[0]) < 30
    assert len(asked) == len(set(asked)) and asked.count(" qwertz") == asked.count(" слово") == 1
    n = len(asked)
    check(pa.array(["ещё слово слово " * 30]), memos, library())
    assert asked[n:] == []
