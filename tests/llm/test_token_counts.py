import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from footfall.llm.token_counts import PLACE_BITS, MergeCounter, count_tokens

from .cases import awkward, texts
from .test_packing import ODD

SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|><|endoftext|> x", "<|EndOfText|>", "<|endoftext|", "e<|endoftext|>\u0301"]


def made(seed):
    rng = random.Random(seed)
    cut = ["".join(rng.choices([*ODD, "<|endoftext|>", "'re", "é", "é"], k=rng.randrange(60))) for _ in range(2000)]
    return cut + SPECIAL + ["x" + chr(c) + "y" + chr(c) + "." for c in range(0x80, 0x400)] + [t or "" for t in texts()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_the_library(name):
    path = public_tokenizers.path(name)
    counter, library = MergeCounter(path, cache_words=40), Tokenizer.from_file(path)
    assert counter.by_word == name.startswith("word")
    given = made(2)
    for text, e in zip(given, library.encode_batch(given, add_special_tokens=False)):
        assert counter.count(text) == len(e.ids), text


def plain_merges(symbols, counter):
    """Merge by looking at every pair each time."""
    done = 0
    while True:
        found = [(counter.ranks[pair], k) for k, pair in enumerate(a * counter.wide + b for a, b in zip(symbols, symbols[1:])) if pair in counter.ranks]
        if not found:
            return done
        rank, k = min(found)
        symbols = [*symbols[:k], counter.made[rank >> PLACE_BITS], *symbols[k + 2 :]]
        done += 1


def test_heap_merges_equal_plain_merges():
    counter = MergeCounter(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    for _ in range(400):
        symbols = counter.symbols("".join(rng.choices("aabbctheinr", k=rng.randrange(1, 50))))
        assert counter.merged(symbols) == plain_merges(symbols, counter)


def test_a_very_long_word():
    path = public_tokenizers.path("word_bpe_49k.json")
    word = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    assert MergeCounter(path).count(word) == len(Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids)


def test_models_with_unknown_signs_and_those_refused(tmp_path):
    vocab = {"[U]": 0, "a": 1, "b": 2, "ab": 3}
    for k, fuse in enumerate((False, True)):
        library = Tokenizer(models.BPE(vocab, [("a", "b")], unk_token="[U]", fuse_unk=fuse))
        library.pre_tokenizer = pre_tokenizers.Whitespace()
        library.save(f"{tmp_path}/{k}.json")
        for text in ("abxxab", "xx ab x", "", "xaxbx"):
            assert MergeCounter(f"{tmp_path}/{k}.json").count(text) == len(library.encode(text).ids), (fuse, text)
    bare = Tokenizer(models.BPE(vocab, [("a", "b")]))
    bare.normalizer = normalizers.Lowercase()
    bare.save(f"{tmp_path}/bare.json")
    assert MergeCounter(f"{tmp_path}/bare.json").count("AxB ab") == len(bare.encode("AxB ab").ids)
    Tokenizer(models.WordLevel({"a": 0}, unk_token="a")).save(f"{tmp_path}/other.json")
    with pytest.raises(ValueError):
        MergeCounter(f"{tmp_path}/other.json")


def test_documents(spark):
    docs, rows = awkward(spark)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for key, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 2048))
    got = [tuple(r) for r in count_tokens(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[3] for r in got)
    assert count_tokens(docs.limit(0)).collect() == []
