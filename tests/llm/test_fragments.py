"""Fragments against the library on odd texts, and how little of a text the tokenizer is asked for."""

import random

import numpy as np
import pyarrow as pa
import pytest

from statrill.llm import packing, pretokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
SIGNS = ["a", "Z", "é", "Ÿ", "ſ", "ñ", "×", "÷", "ß", "7", "½", "Ⅷ", "'", "'s", "'ll", "’", ".", ",", "_", "-", "\x00", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", "　", " ", " ", "  ", "\n", "\t", "\r\n", "日", "я", "😀", "́", "word", "<|endoftext|>", "<|endoftext|"]


def test_fragments_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(3)
    texts = ["", " ", "\n", "x" * 3000, *("".join(rng.choices(SIGNS[:k], k=rng.randint(1, 30))) for k in (39, 39, len(SIGNS)) for _ in range(3000)), *("".join(x) for x in zip(*[iter(rng.choices("a'7. \n", k=30_000))] * 6, strict=True)), ""]
    array = pa.array(["before", *texts])[1:]
    memo, special = packing.coder(PATH)
    for part in (array, array[7:4000], pa.array(["", ""])):
        ids, ends = packing.tokenised(part, memo, special, 0)
        for got, text in zip(np.split(ids, ends[:-1]), part.to_pylist(), strict=True):
            assert got.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text
    assert sum(len(x) for x in pretokens.parts(array, 500)) == len(array) and max(map(len, pretokens.parts(array, 500))) <= 500
    assert not list(pretokens.parts(array[:0]))


def test_small_memory_and_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = pa.array([" ".join(rng.choices(["ka", "lo,", "mi.\nRa", "x" * 70, "été"], k=rng.randint(0, 40))) + str(i) for i in range(300)])
    memo, special = packing.coder(PATH)
    want = [x.tolist() for x in packing.tokenised(texts, memo, special, 0)]
    monkeypatch.setattr(packing, "GATHERED", 7)
    monkeypatch.setattr(packing, "TOGETHER", 3)
    small = pretokens.Memo(memo.fill, 5)
    got = [packing.tokenised(x, small, special, 0) for x in pretokens.parts(texts, 200)]
    assert [i for ids, _ in got for i in ids.tolist()] == want[0]
    assert [e - b for _, ends in got for b, e in zip([0, *ends.tolist()], ends.tolist(), strict=False)] == np.diff(want[1], prepend=0).tolist()


def test_the_tokenizer_is_asked_for_a_word_once():
    """Not once for each sign that follows it, as where texts are split at spaces only."""
    memo, special = packing.coder(PATH)
    asked = []
    counting = pretokens.Memo(lambda new: asked.extend(new) or memo.fill(new))
    packing.tokenised(pa.array([f"See word{sign} The word{sign}\nAnd" for sign in ".,;:!?%$"]), counting, special, 0)
    assert len(asked) == len(set(asked)) and asked.count(" word") == 1 and sum("word" in x for x in asked) == 1
