"""BPE encoding with forced boundaries, and decoding.

Two neighbouring symbols that stand together inside no vocabulary token can never end up in one token, so there a cut is
certain. Texts fall into words at white space, into pieces by the tokenizer's own pattern, and into fragments at forced
boundaries; fragments are merged independently and their ids concatenated. The ids of words are remembered in bounded tables.

Decoding starts from the packed ids alone: one lookup of all ids of a text in the table of token names.

The vocabulary file is read once per Python worker. Its path is a parameter; the file must lie at the same place on every
executor.

Defined cases: a null text is empty and gives no ids; special tokens written out in a text get their own id, as the
tokenizer does; repeated rows are encoded alike; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import give_back, prepared

#: Entries of the tables of remembered words and pieces; they only save time.
REMEMBERED = 100_000
#: Characters of text whose words are encoded together.
TOGETHER = 1 << 20
#: Longer fragments are merged with a heap, whose cost grows with n log n.
SHORT = 128
_NONE = 1 << 62

#: A dot or comma between a letter and white space: always a piece of its own.
_STOP = re.compile(rb"[.,](?=[\x09-\x0d\x20]|\Z)(?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))")


@contextmanager
def no_cycle_search():
    """Encoding makes hundreds of thousands of long-lived values and no cycles; the collector would walk them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
        give_back()


def words_of(text: str) -> list[bytes]:
    """Words of a text whose encodings in a row are the encoding of the text.

    ASCII letters are lowered, white space is dropped and a final dot or comma split off, as the tokenizer would do
    anyway: that leaves far fewer distinct words. A text with special tokens keeps its case, because they have one.
    """
    raw = text.encode("utf-8", "replace")
    return _STOP.sub(rb" \g<0>", raw if b"<|" in raw else raw.lower()).split()


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """A printable character for every byte: itself where it is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for a vocabulary with an end-of-word suffix, lower-casing and dropping white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        ids = vocab | self.special
        self.names = np.full(max(ids.values()) + 1, None, object)
        for token, i in ids.items():
            self.names[i] = token.encode("utf-8")
        self.symbols = byte_symbols()
        self.vocab = vocab
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # pair of ids -> rank and merged id in one number, which compares by rank
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        # pairs of base symbols that stand together inside some token; between any others a boundary is forced
        self.inside = {vocab[a] << 32 | vocab[b] for token in vocab for s in [self._split(token)] for a, b in zip(s, s[1:])}
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tail = {s: s + self.suffix for s in self.symbols}

    def _split(self, token: str) -> list[str]:
        """Base symbols of a token; the end of a word belongs to its last symbol."""
        body = token.removesuffix(self.suffix)
        if body == token or not body:
            return list(token)
        return [*body[:-1], body[-1] + self.suffix]

    def _merge(self, ids: list[int], pairs: list[int]) -> list[int]:
        """Ids of a fragment: the pair of lowest rank is merged first, the leftmost of equal ones."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(p, _NONE) for p in pairs]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | ids[at], _NONE)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 32 | ids[at + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(get(ids[k] << 32 | ids[k + 1], _NONE), k) for k in range(n - 1)]
        heap = [x for x in heap if x[0] != _NONE]
        heapq.heapify(heap)
        while heap:
            best, k = heapq.heappop(heap)
            right = after[k] if ids[k] >= 0 else n
            if right >= n or get(ids[k] << 32 | ids[right], _NONE) != best:
                continue  # one of the two was merged meanwhile
            ids[k], ids[right] = best & 0xFFFFFFFF, -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    rank = get(ids[left] << 32 | ids[after[left]], _NONE)
                    if rank != _NONE:
                        heapq.heappush(heap, (rank, left))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> list[int]:
        symbols = list(piece) if piece.isascii() else [self.symbols[b] for b in piece.encode("utf-8")]
        symbols[-1] = self.tail[symbols[-1]]
        ids = list(map(self.vocab.__getitem__, symbols))
        pairs = [a << 32 | b for a, b in zip(ids, ids[1:])]
        if self.inside.issuperset(pairs):
            return self._merge(ids, pairs)
        out: list[int] = []
        start = 0
        for k, pair in enumerate(pairs, 1):
            if pair not in self.inside:  # a forced boundary
                out += self._merge(ids[start:k], pairs[start : k - 1])
                start = k
        return out + self._merge(ids[start:], pairs[start:])

    def _word(self, word: bytes) -> bytes:
        """Packed ids of a word."""
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            ids = self._piece(text.lower())
        else:
            ids = []
            for part in self.special_cut.split(text) if "<|" in text else (text,):
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    # letters are lowered one by one: no final sigma
                    for piece in self.pieces(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()):
                        ids += self._piece(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Of every text the ids as little-endian 32-bit numbers."""
        waiting: list[list[bytes]] = []
        held = 0
        for text in texts:
            waiting.append(words_of(text) if isinstance(text, str) else [])
            held += len(text) if isinstance(text, str) else 0
            if held >= TOGETHER:
                yield from self._encode_words(waiting)
                waiting, held = [], 0
        yield from self._encode_words(waiting)

    def _encode_words(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        """Distinct words first. A full table becomes the older one, from which words in use come back."""
        if len(self.words) > REMEMBERED:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older.get
        for word in set().union(*texts).difference(words):
            made = older(word)
            words[word] = self._word(word) if made is None else made
        known = words.__getitem__
        for text in texts:
            yield b"".join(map(known, text))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes) -> bytes:
        """Names of the tokens with a space between them, in UTF-8: the vocabulary file names no decoder."""
        return b" ".join(self.names[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def digests(text: Column, path: str) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of a text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: pd.Series) -> pd.DataFrame:
        coder = encoder(path)
        rows = []
        with no_cycle_search():
            for ids in coder.encode_many(texts):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text.cast("string"))


def token_ids(text: Column, path: str) -> Column:
    """Ids of a text as packed little-endian unsigned 32-bit numbers."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_many
        with no_cycle_search():
            return pd.Series(list(encode(texts)), dtype="object")

    return of(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """Text of packed ids; null where they are null."""

    @F.pandas_udf("string")
    def of(packed: pd.Series) -> pd.Series:
        decode = encoder(path).decode
        return pd.Series([None if x is None else decode(x).decode("utf-8") for x in packed], dtype="object")

    return of(ids)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with the number of tokens and the digests of ids and decoded text."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), digests(F.col(f"`{text}`"), path or default_path()).alias("d"))
    return rows.select("doc_id", "d.*")
