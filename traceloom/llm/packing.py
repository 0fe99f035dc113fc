"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences and the pieces of n's binary
form, longest first, so that each piece has a power-of-two length and fills a
sequence of that length: no sequence crosses documents and none is padded
(Pouransari et al., "Dataset decomposition", NeurIPS 2024). Sequences are
bucketed by length: their numbers run through each bucket in turn, so batches of
one length are runs of numbers.

Defined results: a null or empty text has the end token alone; rows that repeat
are packed each; a null id is packed as any other; an empty table gives no piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.shared import map_arrow

END = 2
MAX_LENGTH = 4096
#: Ways that a bucket is dealt.
SALTS = 1024
#: Distinct words whose ids a task keeps at once.
CACHE_WORDS = 300_000
#: Code points of texts that are split into words at once.
CHUNK_CHARS = 1_000_000
#: Code points, all of which the normaliser of word_bpe_49k.json only lower-cases
#: or takes for white space, as Python does too: printable ASCII, tab, line feeds
#: and Latin-1 letters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb4\xb6-\xff]*")
#: What the pre-tokenizer's pattern in word_bpe_49k.json finds in lower-cased text
#: of those code points: letters, the endings 's 't 're 've 'm 'll 'd, one digit, the rest.
WORDS = re.compile(
    r"[a-z\xaa\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\s0-9a-z\xaa\xb2\xb3\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+"
)


class WordTokenizer:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers.

    The BPE works within words, so a word's ids are kept and found again by the
    word; words not seen yet are encoded together, and the ids that end a word
    part them again. A text with code points beyond PLAIN, or with the first
    characters of a special token, goes to the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        ids = self._ids(" ".join(new))
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) != len(new):
            raise ValueError("the tokenizer does not end each word by one end-of-word token")
        raw = ids.tobytes()
        self.words.update(zip(new, map(raw.__getitem__, map(slice, [0, *cuts[:-1].tolist()], cuts.tolist()))))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_CHARS):
                size += len(texts[hi])
                hi += 1
            split = [WORDS.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts[lo:hi]]
            if len(self.words) > CACHE_WORDS:  # common words come first
                self.words = dict(islice(self.words.items(), CACHE_WORDS // 3))
            if new := set().union(*filter(None, split)).difference(self.words):
                self._learn(sorted(new))
            known = self.words
            for text, words in zip(texts[lo:hi], split):
                if words is None:
                    yield self._ids(text).tobytes()
                else:
                    yield b"".join(map(known.__getitem__, words))
            lo = hi

    def rest(self) -> None:
        """Keep the common words only, for as long as the worker has no task."""
        self.words = dict(islice(self.words.items(), CACHE_WORDS // 3))


def default_tokenizer() -> WordTokenizer:
    """The tokenizer of word_bpe_49k.json; a worker process keeps it, with its words, for later tasks."""
    import public_tokenizers

    kept = vars(public_tokenizers)
    if "traceloom_tokenizer" not in kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept["traceloom_tokenizer"] = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return kept["traceloom_tokenizer"]


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of a document's pieces: full sequences, then its binary digits from the highest."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    out = [longest] * (n // longest)
    rest, bit = n % longest, longest >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


def cut_pieces(
    docs: DataFrame,
    tokenizer: Callable[[], Callable[[list[str]], Iterator[bytes]]] = default_tokenizer,
    longest: int = MAX_LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, and its ids if with_ids.

    row: the document's place in its task's input, which tells repeated rows apart.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    empty = source.select(
        "id",
        *(F.lit(0).cast("bigint").alias(c) for c in ("row", "start", "length", "ids_crc32", "doc_tokens")),
        *([F.lit(None).cast("array<int>").alias("ids")] if with_ids else []),
    )
    last, names = end.to_bytes(4, "little"), empty.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = None, TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            if encode is None:
                encode = tokenizer()
            at: list[int] = []
            cols: list[list] = [[] for _ in range(5)]
            bodies: list[bytes] = []
            for k, body in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                row += 1
                ids = memoryview(body + last)
                if with_ids:
                    bodies.append(ids)
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    at.append(k)
                    for c, v in zip(cols, (row, start, length, zlib.crc32(piece), n)):
                        c.append(v)
                    start += length
            out = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            if with_ids:
                # A document's pieces follow each other, so all ids of the batch are one run.
                offsets = np.concatenate([[0], np.cumsum(cols[2], dtype=np.int64)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(bodies), "<i4"))))
            yield pa.RecordBatch.from_arrays(out, names=names)
        if isinstance(encode, WordTokenizer):
            encode.rest()

    return map_arrow(source, run, empty.schema)


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: Callable[[], Callable[[list[str]], Iterator[bytes]]] = default_tokenizer,
    longest: int = MAX_LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces with sequence_id, offset and bucket (the binary logarithm of the length).

    The pieces are dealt by bucket and a salt, so that a bucket, however large, is
    spread over tasks, and a sequence is one piece: sequence_id is its place in its
    task's run of buckets, with gaps between tasks.
    """
    pieces = cut_pieces(docs, tokenizer, longest, id_col, text_col, end, with_ids)
    pieces = pieces.withColumn("bucket", F.log2(F.col("length").cast("double")).cast("int"))
    dealt = pieces.repartition("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS))).sortWithinPartitions("bucket", "row", "start")
    return dealt.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}).drop("row")
