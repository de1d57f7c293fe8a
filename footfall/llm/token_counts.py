"""Token counts by byte-pair merging over a heap and a linked list, without making any token identifiers."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns
from .packing import PROBES, WordTokens, default_tokenizer

LIMIT = 2048
#: Words whose counts a task remembers; they are forgotten when there are more, which costs time only.
CACHE_WORDS = 500_000
#: Heap entries are rank and position in one integer.
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1


class MergeCounter:
    """Counts the tokens that a byte-pair model of the ``tokenizers`` library gives for whole texts.

    The library's own normaliser and pre-tokenizer cut a text into pieces; the merging of a piece is done here. Strings of
    special tokens are one token each and bound the pieces. A model that is not byte-pair merging, drops merges at random,
    marks continued pieces, or has special tokens that are matched after normalising or swallow neighbours is refused.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path} is not a plain byte-pair model")
        added = told["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has special tokens that are not matched as they stand")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown = self.vocab.get(model["unk_token"]) if model.get("unk_token") else None
        self.fuse, self.whole_first = bool(model.get("fuse_unk")), bool(model.get("ignore_merges"))
        self.wide = max(self.vocab.values(), default=0) + 2  # one more than the ids, so that the end mark -1 matches no pair
        #: Rank, above the bits of a place, by both symbols in one integer; and the symbol that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[left] * self.wide + self.vocab[right]] = rank << PLACE_BITS
            self.made.append(self.vocab[left + right])
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.limit = cache_words
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.by_word = all(not re.search(r"\s", s) for s in specials) and all(self.of_text(p) == sum(map(self.of_text, WordTokens.words(p))) for q in PROBES for p in (q, f" {q} {q}"))
        self.words.clear()
        self.pieces.clear()

    def symbols(self, piece: str) -> list[int]:
        """The symbols that merging starts from: one a character, the last one with the mark of a word's end."""
        if not piece:
            return []
        made: list[int] = []
        fused = False
        for text in (*piece[:-1], piece[-1] + self.suffix):
            known = self.vocab.get(text)
            if known is not None:
                made.append(known)
            elif self.unknown is not None and not (self.fuse and fused):
                made.append(self.unknown)
            fused = known is None and self.unknown is not None
        return made

    def merged(self, symbols: list[int]) -> int:
        """How many merges the symbols allow: always the adjacent pair of lowest rank, the leftmost of equals."""
        n, ranks, wide = len(symbols), self.ranks.get, self.wide
        now, before, after = [*symbols, -1], [*range(-1, n)], [*range(1, n + 1)]
        heap = []
        for at in range(n - 1):
            rank = ranks(now[at] * wide + now[at + 1])
            if rank is not None:
                heap.append(rank | at)
        heapq.heapify(heap)
        done = 0
        while heap:
            top = heapq.heappop(heap)
            at = top & PLACE
            if now[at] < 0:
                continue  # merged into its left neighbour since
            right = after[at]
            if ranks(now[at] * wide + now[right]) != top - at:
                continue  # its right neighbour has changed since
            new = now[at] = self.made[top >> PLACE_BITS]
            now[right] = -1
            right = after[at] = after[right]
            done += 1
            if right < n:
                before[right] = at
                rank = ranks(new * wide + now[right])
                if rank is not None:
                    heapq.heappush(heap, rank | at)
            left = before[at]
            if left >= 0:
                rank = ranks(now[left] * wide + new)
                if rank is not None:
                    heapq.heappush(heap, rank | left)
        return done

    def of_piece(self, piece: str) -> int:
        """Initial symbols less merges."""
        made = self.pieces.get(piece)
        if made is None:
            if self.whole_first and piece + self.suffix in self.vocab:
                made = 1
            else:
                symbols = self.symbols(piece)
                made = len(symbols) - self.merged(symbols)
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            self.pieces[piece] = made
        return made

    def of_text(self, text: str) -> int:
        specials = len(self.specials.findall(text)) if self.specials else 0
        count = specials
        for part in self.specials.split(text) if specials else (text,):
            if self.normalizer is not None:
                part = self.normalizer.normalize_str(part)
            pieces = [p for p, _ in self.pre_tokenizer.pre_tokenize_str(part)] if self.pre_tokenizer is not None else [part]
            count += sum(map(self.of_piece, pieces))
        return count

    def count(self, text: str | None) -> int:
        """Tokens of a whole text (null: none), word by word with a cache where the tokenizer allows it."""
        if not self.by_word:
            return self.of_text(text or "")
        known = self.words
        if len(known) > self.limit:
            known.clear()
        total = 0
        for word in WordTokens.words(text or ""):
            made = known.get(word)
            if made is None:
                made = known[word] = self.of_text(word)
            total += made
        return total


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_tokens, over_limit).

    A narrow pass without a shuffle; memory is one Arrow batch and the cache of words. Null and empty texts hold no tokens;
    equal texts and repeated rows count each for itself; very long words cost n log n; a null doc_id stays null; an empty
    table gives no rows; other columns are ignored. No token identifiers, begin or end marks are made.
    """
    path = tokenizer or default_tokenizer()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = columns(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(path)
        for batch in batches:
            counts = pa.array((counter.count(value.as_py()) for value in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], names=["doc_id", "n_bytes", "n_tokens"])

    return named.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
