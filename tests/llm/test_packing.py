import random
import zlib

import numpy as np

from footfall.llm.packing import WordTokens, default_tokenizer, pack, pack_documents

from .cases import awkward, texts

ODD = "abZÉéßİŁ 'stre.,!?;:\"0٣½̧́각\x1c\x1f\x85\xa0 　漢字ΣςσаЙ​<|endoftext|>\n\t\r\x0b\x0c"


def test_ids_equal_the_tokenizer():
    words = WordTokens(default_tokenizer(), cache_words=50)
    rng = random.Random(0)
    made = ["".join(rng.choices(ODD, k=rng.randrange(60))) for _ in range(3000)]
    made += ["x" + chr(c) + "y" + chr(c) + "." for c in range(0xA0, 0x250)] + [t or "" for t in texts()]
    for text, e in zip(made, words.tokenizer.encode_batch(made, add_special_tokens=False)):
        assert words.encode(text).tolist() == e.ids, text


def whole(pieces, lengths, sequence):
    rooms, covered = {}, {}
    for doc, start, n, s, at in pieces:
        assert n > 0
        rooms.setdefault(s, []).append((at, n))
        covered.setdefault(doc, []).append((start, n))
    for spans in [*rooms.values(), *covered.values()]:
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
    assert all(sum(n for _, n in x) <= sequence for x in rooms.values())
    assert {d: sum(n for _, n in x) for d, x in covered.items()} == {d: n for d, n in enumerate(lengths) if n}
    return rooms


def test_pack_is_whole_tight_and_balanced():
    rng = random.Random(3)
    for lengths in ([1], [64], [65], [64, 64, 1], [63] * 10, [200, 3, 64], [rng.randrange(1, 150) for _ in range(400)], [0, 5]):
        rooms = whole(pack(lengths, 64), lengths, 64)
        rests = sum(n % 64 for n in lengths)
        assert len(rooms) == sum(n // 64 for n in lengths) + -(-rests // 64)


def test_documents(spark):
    docs, rows = awkward(spark)
    out = pack_documents(docs.coalesce(2), window_tokens=20000).collect()
    words = WordTokens(default_tokenizer())
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    repeated = rows[-1][0]
    for key, text, *_ in rows:
        ids = np.append(words.encode(text), 1).astype("<u4")
        pieces = sorted(by_doc[key], key=lambda r: r.start)
        assert sum(p.length for p in pieces) == len(ids) * (2 if key == repeated else 1)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    rooms = {}
    for r in out:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in rooms.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 2048
    assert pack_documents(docs.limit(0)).collect() == []


def plain_pack(lengths, sequence):
    """The rule in plain words: rests by cost descending, each to the cheapest sequence with room, else cut over the cheapest open ones."""
    cost = lambda n: n + n * n / 2048
    made, used = [], 0
    for doc, n in enumerate(lengths):
        for at in range(0, n - n % sequence, sequence):
            made.append((doc, at, sequence, used, 0))
            used += 1
    rests = sorted(((n % sequence, doc) for doc, n in enumerate(lengths) if n % sequence), key=lambda r: (-cost(r[0]), r[1]))
    held = [[] for _ in range(-(-sum(n for n, _ in rests) // sequence))]
    for n, doc in rests:
        at = lengths[doc] - n
        while n:
            room = [sequence - sum(h) for h in held]
            able = [k for k, r in enumerate(room) if r >= n] or [k for k, r in enumerate(room) if r]
            to = min(able, key=lambda k: (sum(map(cost, held[k])), k))
            took = min(n, room[to])
            made.append((doc, at, took, used + to, sum(held[to])))
            held[to].append(took)
            at, n = at + took, n - took
    return made


def test_pack_follows_the_cost_rule():
    rng = random.Random(8)
    for _ in range(60):
        sequence = rng.choice((16, 64, 2048))
        lengths = [rng.choice((rng.randrange(1, 12), rng.randrange(1, 3 * sequence))) for _ in range(rng.randrange(1, 80))]
        assert pack(lengths, sequence) == plain_pack(lengths, sequence)


def test_other_tokenizers_are_not_taken_for_the_known_one(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    known = WordTokens(default_tokenizer())
    assert known.by_word
    vocab = {c: i for i, c in enumerate(map(chr, range(32, 127)))} | {"[UNK]": 200, "a b": 201}
    loose = Tokenizer(models.BPE(vocab, [], unk_token="[UNK]"))
    upper = Tokenizer(models.WordLevel({"Plain": 5, "plain": 6, "[UNK]": 0}, unk_token="[UNK]"))
    upper.pre_tokenizer = pre_tokenizers.Whitespace()
    cased = Tokenizer.from_file(default_tokenizer())
    cased.normalizer = normalizers.NFC()
    for k, tokenizer in enumerate((loose, upper, cased)):
        tokenizer.save(f"{tmp_path}/{k}.json")
        words = WordTokens(f"{tmp_path}/{k}.json")
        for text in ("Plain words a b", "ÀB plain Plain", " a  b ", "", ODD):
            assert words.encode(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, (k, text)
