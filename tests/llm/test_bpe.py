import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe
from gridloom.llm.transducer import Transducer, build

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    " ",
    "Hello wörld, it's 123 ñ́!!",
    "don't they'LL I'M 'tis ''s _x_ a_b",
    "<|endoftext|>Foo<|startoftext|> <|ENDOFTEXT|> <|endoftext|",
    "ΑΣ ΣΑΣ ΟΔΟΣ",
    "İstanbul ŁÓDŹ Straße ǅ ﬁ",
    "\x1c\x1d\x85\xa0 x​y",
    "½ ² Ⅷ ٣ 一二三 ㈱ 𝟘𝟙 😀😀 𐍈a 👩‍👩‍👧",
    "é Å 각 각",
    "aaaaaaaaaaaa" * 50,
    "abc" * 400,
    "x" * 5000 + " " + "zq" * 3000,
    "\x00\x01 ﻿�",
]


@pytest.fixture(scope="module")
def parts():
    v = bpe.Vocabulary(PATH)
    return v, Tokenizer.from_file(PATH)


def test_matches_the_library(parts, tmp_path):
    v, library = parts
    rng = random.Random(3)
    alphabet = "aeiounrtslé ñ'!?.,0123ßΣ \n\t-_ǆ你"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(["the", "hello", "it", "don", "a"], v))
    encoder = bpe.Encoder(v, Transducer(str(tmp_path / "lexicon")))
    for text, ids in zip(texts, encoder.encode(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, repr(text)
        assert encoder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_every_character_of_the_plane_is_split_like_the_library(parts):
    v, library = parts
    splitter = bpe.Splitter(v.special)
    for start in range(0, 0x10000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}!" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        pre = "".join(x + " " for x in splitter.words(text))
        n = library.normalizer.normalize_str(text)
        got = [n[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(n)]
        if splitter.words(text) != got:
            odd = [c for c in range(start, start + 64) if not 0xD800 <= c < 0xE000 and splitter.words(f"a{chr(c)}1") != [m[a:b] for m in [library.normalizer.normalize_str(f"a{chr(c)}1")] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(m)]]
            assert all(not chr(c).isprintable() or c > 0x1C80 for c in odd), (hex(start), [hex(c) for c in odd], pre)  # newer Unicode than Python's


def test_long_words_merge_like_short_ones(parts):
    v, _ = parts
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 80)))
        raw = word.encode()
        ids = [v.inner[b] for b in raw[:-1]] + [v.last[raw[-1]]]
        assert bpe._merge_long(ids, v.merges) == bpe.merge(word, v)


def test_transducer_finds_exactly_its_words(tmp_path):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)} | {b"z" * 300})
    outputs = [[rng.randrange(1000) for _ in range(rng.randrange(1, 4))] for _ in words]
    (tmp_path / "t").write_bytes(build(words, outputs))
    t = Transducer(str(tmp_path / "t"))
    assert len(t) == len(words) and (t.places(words) == np.arange(len(words))).all()
    others = [w + b"d" for w in words[:50]] + [b"", b"zz", b"\xff"]
    assert (t.places(others) == -1).all()
    assert all(np.frombuffer(t.output(k), "<u4").tolist() == o for k, o in enumerate(outputs))
    assert len(t.ends) < sum(map(len, words)) / 3  # suffixes are shared


def test_empty_transducer(tmp_path):
    (tmp_path / "t").write_bytes(build([], []))
    assert Transducer(str(tmp_path / "t")).places([b"a", b""]).tolist() == [-1, -1]
