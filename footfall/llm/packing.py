"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, to_arrow

SEQUENCE = 2048
END_ID = 1
#: Documents are packed together until they hold this many tokens: bounds memory, not what is packed.
WINDOW_TOKENS = SEQUENCE * 512
#: Words whose ids a task remembers; older ones are forgotten, which costs time only.
CACHE_WORDS = 500_000
#: Letters that the tokenizer's normaliser maps to single letters.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Byte-level spelling of the lower-case Latin-1 letters: UTF-8 byte 0xC3 and a byte of 0x9F..0xBF, shown as
#: itself if printable (0xA1 and up but 0xAD), else as U+0100 plus its rank among the bytes that are not.
BYTE_LEVEL = {c: "Ã" + chr(b if b > 0xA0 and b != 0xAD else 0x143 if b == 0xAD else 0x100 + 33 + b - 0x7F) for c in range(0xDF, 0x100) for b in [c - 0x40]}
PIECES = "start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids by white-space-free word; unseen words are encoded when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.whole, self.model = tokenizer.encode, tokenizer.model.tokenize

    def encode(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            # one pre-token: what the normaliser and the byte-level step make of it goes straight to the BPE model
            return array("I", [t.id for t in self.model(word.lower().translate(BYTE_LEVEL))]).tobytes()
        if len(word) > 1 and word[-1] in ".," and PLAIN.fullmatch(word[-2]):
            # a letter ends one pre-token and the sign is the next one
            return self[word[:-1]] + self[word[-1]]
        return np.array(self.whole(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            made = self.encode(word)
        self[word] = made
        return made


#: Texts that show whether a tokenizer works word by word, and spells words as ``_Words`` does.
PROBES = (
    "Plain words, and MORE of them.", " a  b\tc\nd\r\n\x0be\x0cf ", "Straße ÀÉÎÕÜ ñandú façade Œuvre İstanbul", "x1y 12,5% a_b don't (f)[g] q.e.d. ... -- ,.",
    "漢字 かな 한글 मन 😀👍🏽 e\u0301 \xa0 \u3000", "a\x1cb\x1fc d", "Über, naïve. ÿ, ß.", "<|endoftext|> </s> [UNK] ##a ▁b",
)


class WordTokens:
    """Ids of whole texts, word by word with a cache where the tokenizer allows it.

    It does if it never joins across white space and spells words as ``_Words`` does, which ``PROBES`` and their words show when it
    is loaded; any other tokenizer is given whole texts.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache_words
        self.known = _Words(self.tokenizer)
        self.by_word = True
        try:
            self.by_word = all(self.encode(t).tolist() == self._whole(t).tolist() for p in PROBES for t in (p, *p.split()))
        except Exception:  # noqa: BLE001 - a model that cannot tokenize a bare word is one that is given whole texts
            self.by_word = False
        self.known = _Words(self.tokenizer)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    @staticmethod
    def words(text: str) -> list[str]:
        # str.split also breaks at the four separators below, which the tokenizer reads as signs
        return text.split() if not SEPARATORS.search(text) else [w for w in re.split("[ \t-\r]+", text) if w]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text (null: none), without an end mark."""
        if not self.by_word:
            return self._whole(text or "")
        if len(self.known) > self.limit:
            fresh = _Words(self.tokenizer)
            fresh.older = dict(self.known)
            self.known = fresh
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words(text or ""))), dtype="<u4")


def attention_cost(length: int | np.ndarray, linear: float = 1.0, quadratic: float = 1 / 2048):
    """Estimated cost of one piece: linear layers plus attention within the piece."""
    return linear * length + quadratic * length * length


def pack(lengths: list[int], sequence: int = SEQUENCE, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths.

    A document longer than a sequence first fills whole sequences by itself. The rests go, costliest
    first, to the lowest-cost sequence with room for them, over as few sequences as their tokens need;
    a rest that fits nowhere is cut to fill the lowest-cost open sequence. Ties go to the lower index.
    """
    out, rests, used = [], [], 0
    for doc, n in enumerate(lengths):
        full = n // sequence
        for k in range(full):
            out.append((doc, k * sequence, sequence, used, 0))
            used += 1
        if n % sequence:
            rests.append((doc, full * sequence, n % sequence))
    rests.sort(key=lambda r: (-r[2], r[0]))
    bins = -(-sum(r[2] for r in rests) // sequence)
    room, cost = np.full(bins, sequence), np.zeros(bins)
    for doc, start, n in rests:
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            to = int(np.where(fits, cost, np.inf).argmin())
            took = min(n, int(room[to]))
            out.append((doc, start, took, used + to, sequence - int(room[to])))
            room[to] -= took
            cost[to] += attention_cost(took, linear, quadratic)
            start, n = start + took, n - took
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Tokenises and packs in one pass without a shuffle: each task packs the documents of its own split in
    windows of ``window_tokens``, so memory is bounded and padding is under one sequence a window.
    sequence_id is unique (task number in the high bits), not gapless. Null and empty texts hold only the
    end id; equal texts and repeated rows are packed each for itself; very long texts are cut into pieces;
    a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    named = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    schema = to_arrow("doc_id long," + PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(path)
        task = TaskContext.get()
        base, used = (task.partitionId() if task else 0) << 32, 0
        ids: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, tokens, used
            pieces = pack([len(h) for h in held], sequence)
            rows = [(ids[d], start, n, zlib.crc32(held[d][start : start + n]), len(held[d]), base + used + s, at) for d, start, n, s, at in pieces]
            used += 1 + max(p[3] for p in pieces)
            ids, held, tokens = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                made = words.encode(text.as_py())
                ids.append(doc)
                held.append(np.concatenate([made, end]))
                tokens += len(made) + 1
                if tokens >= window_tokens:
                    yield flush()
        if held:
            yield flush()

    return named.mapInArrow(run, "doc_id long," + PIECES)
