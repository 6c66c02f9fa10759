"""Token ids in files of fixed-width bit packing.

Every id takes the bits that the largest vocabulary id needs. A file is a row of blocks; a block is a header, the ids and
lengths of its documents, and the packed tokens of these documents without gaps, so token t stands at bit t * width and
any document can be unpacked alone. The last line of a file is its index: the offset, documents and tokens of every block, then
their number. Readers start there, go to a block by its offset and to a document by its first token.

Files are written by Spark's text sink, one block per line with a fixed line separator that readers skip by length, so any
store that Spark writes to will do. Documents are range-partitioned by id; tasks sort their range, so blocks in order of
(part, number) hold ascending ids. Global positions come from the block totals: sums within a part and over parts.

Defined cases: a null text is empty and has only the end id; a null id comes first; rows with equal ids stand together
in order of their text's hash; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talloom.llm.bpe import default_path, no_cycle_search, words_of
from talloom.llm.common import prepared, stored
from talloom.session import scratch_path

MAGIC = b"TLBP"
#: magic, bits, part, number, documents, tokens, bytes of packed tokens
HEADER = "<4sIQQQQQ"
HEADER_BYTES = struct.calcsize(HEADER)
#: end of an index: number of blocks, magic
INDEX_MAGIC = b"TLBX"
INDEX_END = "<Q4s"
END_ID = 2
BLOCK_TOKENS = 1 << 18
#: Lines of a file: blocks, and the index as the last one.
LINES_PER_FILE = 64
#: Words in the encoder's table before those not in use are dropped; it only saves time.
REMEMBERED = 800_000
NO_ID = np.iinfo(np.int64).min


def width(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits`-wide numbers, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """`count` ids from token `start` on: random access, nothing before is touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8, last - first, first), bitorder="little")
    skip = start * bits - 8 * first
    planes = flat[skip : skip + count * bits].reshape(count, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class WordEncoder:
    """The tokenizers library, asked once per distinct word.

    For tokenizers that lower letters, cut at white space and drop it, a text's ids are those of its words in a row. Unknown words are
    encoded in one call, with a special token between them to find the borders.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(self.special.items()))
        self.known: dict[bytes, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.size, bool)  # tokens that end a piece
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: set[bytes]) -> None:
        letters, marked = [], []
        for word in words:
            if word.isalpha() or word.decode("utf-8", "replace").isalpha():
                letters.append(word)
            elif b"<" in word or b"|" in word or b">" in word:  # could be, or make, a special token
                self.known[word] = self._ids(word.decode("utf-8", "replace")).astype("<u4").tobytes()
            else:
                marked.append(word)
        for k in range(0, len(letters), 5000):  # words of letters are one piece each, and a piece ends with a suffixed token
            part = letters[k : k + 5000]
            ids = self._ids(b" ".join(part).decode("utf-8", "replace"))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self._note(part, ids, [0, *cuts[:-1].tolist()], cuts.tolist())
            else:
                marked += part
        for k in range(0, len(marked), 5000):
            part = marked[k : k + 5000]
            ids = self._ids(self.mark.join([w.decode("utf-8", "replace") for w in part]))
            cuts = np.flatnonzero(ids == self.mark_id)
            self._note(part, ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])

    def _note(self, words: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw = ids.astype("<u4").tobytes()
        self.known.update(zip(words, [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of every text as little-endian 32-bit numbers. The words of all these texts are learnt together."""
        split = [words_of(text) if isinstance(text, str) else [] for text in texts]
        new: set[bytes] = set()
        new.update(*split)
        if len(self.known) + len(new) > REMEMBERED:  # full: what is in use stays
            self.known = {w: self.known[w] for w in new if w in self.known}
        new.difference_update(self.known)
        self._learn(new)
        known = self.known.__getitem__
        for words in split:
            yield b"".join(map(known, words))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", bits: int | None = None) -> None:
    """Documents as packed files below `folder`, in ascending order of their ids.

    bits: of an id; as many as the vocabulary needs where it is not given.
    """
    path = path or default_path()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_encoder(path)
        wide, part, number = bits or width(coder.size), TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        ids: list[int] = []
        tokens: list[bytes] = []
        held = 0
        index: list[tuple[int, int, int]] = []  # of the file being written
        at = 0

        def flush(last: bool = False) -> pd.DataFrame:
            """The block as a line; behind it the index, where the file is full or ends."""
            nonlocal at
            lines = []
            if ids:
                body = pack(np.frombuffer(b"".join(tokens), "<u4"), wide)
                sizes = np.array([len(x) // 4 for x in tokens], "<u8")
                head = struct.pack(HEADER, MAGIC, wide, part, number, len(ids), int(sizes.sum()), len(body))
                lines.append(head + np.array(ids, "<i8").tobytes() + sizes.tobytes() + body)
                index.append((at, len(ids), int(sizes.sum())))
                at += len(lines[0]) + 1
            if index and (last or len(index) == LINES_PER_FILE - 1):
                lines.append(np.array(index, "<u8").tobytes() + struct.pack(INDEX_END, len(index), INDEX_MAGIC))
                index.clear()
                at = 0
            return pd.DataFrame({"block": lines})

        for batch in batches:
            with no_cycle_search():
                encoded = list(coder.encode(batch["text"]))
            for doc, made in zip(batch["doc_id"], encoded):
                ids.append(NO_ID if doc is None else int(doc))
                tokens.append(made + end)
                held += len(made) // 4 + 1
                if held >= BLOCK_TOKENS:
                    yield flush()
                    ids, tokens, held, number = [], [], 0, number + 1
        yield flush(last=True)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    named = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    packed = named.mapInPandas(blocks, "block binary").select(F.col("block").cast("string").alias("value"))
    packed.write.option("lineSep", "\n").option("maxRecordsPerFile", LINES_PER_FILE).text(folder)


def block_index(data: bytes) -> np.ndarray:
    """Offset, documents and tokens of the blocks of a file, a row each, from the index at its end; none for the empty file of an empty part."""
    if not data:
        return np.empty((0, 3), np.int64)
    end = len(data) - 1 - struct.calcsize(INDEX_END)
    blocks, magic = struct.unpack_from(INDEX_END, data, end) if end >= 0 else (0, b"")
    if magic != INDEX_MAGIC or 24 * blocks > end:
        raise ValueError("a file without its index")
    return np.frombuffer(data, "<u8", 3 * blocks, end - 24 * blocks).reshape(-1, 3).astype(np.int64)


def read_block(data: bytes, at: int) -> tuple[int, int, int, np.ndarray, np.ndarray, bytes]:
    """Bits, part, number, document ids, document lengths and packed tokens of one block."""
    magic, bits, part, number, docs, _, size = struct.unpack_from(HEADER, data, at)
    if magic != MAGIC:
        raise ValueError(f"not a block at byte {at}")
    at += HEADER_BYTES
    ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    return bits, part, number, ids, lengths, data[at + 16 * docs : at + 16 * docs + size]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below `folder`."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                for at in block_index(data)[:, 0].tolist():
                    bits, part, number, ids, lengths, packed = read_block(data, at)
                    starts = np.cumsum(lengths) - lengths
                    yield pd.DataFrame({
                        "part": part, "number": number, "place": np.arange(len(ids)), "doc_id": ids, "before": starts, "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(unpack(packed, bits, k, n).astype("<u4")) for k, n in zip(starts.tolist(), lengths.tolist())],
                    })

    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = stored(files.mapInPandas(documents, "part long, number long, place long, doc_id long, before long, n_tokens long, ids_crc32 long"), "tokens")
    blocks = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("base"))  # one row per part
    within = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("part").orderBy("number"))), F.lit(0))
    starts = blocks.withColumn("within", within).join(base, "part").select("part", "number", (F.col("base") + F.col("within")).alias("at"))
    doc = F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id"))
    return rows.join(starts, ["part", "number"]).select(
        doc.alias("doc_id"), (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str | None = None, bits: int | None = None) -> DataFrame:
    """Write the documents as packed files in the shared folder and read them back."""
    spark = prepared(docs.sparkSession)
    folder = scratch_path(spark, "packed")
    write_files(docs, folder, path, bits=bits)
    return read_files(spark, folder)
