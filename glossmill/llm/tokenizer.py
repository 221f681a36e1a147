"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Method: a global distinct-word shuffle. Pre-tokens are cut inside the JVM and stay with their
documents as sequences of small word numbers (their positions), one row per chunk of documents.
Only the words of a chunk, once each, are exploded and shuffled; each distinct word of the corpus
is encoded once; its ids are joined back, gathered by chunk, and put in place by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.skew import attach
from glossmill.session import written

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public pre-token pattern of the 50k byte-level vocabulary, and White_Space of Unicode.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_CHUNK = "gm_chunk bigint, gm_docs array<bigint>, gm_counts binary, gm_codes binary, gm_wide boolean, gm_words array<string>"
CHUNK_DOCS, CHUNK_WORDS = 4096, 1 << 20  # a chunk ends at so many documents or words; a longer document is a chunk of its own


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pre_tokens(text: Column) -> Column:
    """Array of pre-tokens of a text; NULL stays NULL."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def chunk_bounds(n: np.ndarray) -> list[tuple[int, int]]:
    """Where the chunks of documents with ``n`` words begin and end."""
    group = np.stack([np.arange(len(n)) // CHUNK_DOCS, (np.cumsum(n) - n) // CHUNK_WORDS])
    at = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
    long_ = np.flatnonzero(n > CHUNK_WORDS)
    edges = np.unique(np.concatenate([[0, len(n)], at, long_, long_ + 1]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for whole in batches:
        n = np.asarray(whole.column(1).value_lengths().fill_null(0)).astype(np.int64)
        for start, end in chunk_bounds(n):
            batch = whole.slice(start, end - start)
            tokens = batch.column(1)
            counts = np.asarray(tokens.value_lengths().fill_null(0)).astype("<u4")
            coded = tokens.flatten().dictionary_encode()
            wide = len(coded.dictionary) > 65535
            codes = np.asarray(coded.indices).astype("<u4" if wide else "<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number], pa.int64()),
                    pa.array([batch.column(0).to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
                    pa.array([counts.tobytes()], pa.binary()),
                    pa.array([codes.tobytes()], pa.binary()),
                    pa.array([wide]),
                    pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
                ],
                names=["gm_chunk", "gm_docs", "gm_counts", "gm_codes", "gm_wide", "gm_words"],
            )
            number += 1


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [encoding.encode_ordinary(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["gm_word", "gm_n", "gm_ids"])

    return run


def _assembler(only_counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, counts, codes, wide, pieces = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                ids = docs.slice(i, 1).flatten()
                n = np.frombuffer(counts[i].as_py(), "<u4").astype(np.int64)
                order = np.frombuffer(codes[i].as_py(), "<u4" if wide[i].as_py() else "<u2")
                flat, start, length = np.empty(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(order):
                    piece = pieces.slice(i, 1).flatten()
                    number, lists = np.asarray(piece.field(0)), piece.field(1)
                    first = np.asarray(lists.offsets).astype(np.int64)
                    first, last = first[:-1] - first[0], first[1:] - first[0]
                    flat = np.asarray(lists.flatten())
                    start, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                    start[number], length[number] = first, last - first
                size = length[order] if len(order) else np.zeros(0, np.int64)
                after = np.concatenate([[0], np.cumsum(size)])
                bounds = after[np.concatenate([[0], np.cumsum(n)])]
                if only_counts:
                    value = pa.array(np.diff(bounds))
                    name = "n_tokens"
                else:
                    at = np.repeat(start[order] - after[:-1], size) + np.arange(after[-1]) if len(order) else np.zeros(0, np.int64)
                    value = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[at], pa.int32()))
                    name = "ids"
                yield pa.RecordBatch.from_arrays([ids, value], names=["doc_id", name])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_PATH, only_counts: bool = False) -> DataFrame:
    """Token ids (``ids``) or their number (``n_tokens``) of every document.

    NULL and empty texts have the empty list, 0 tokens. Rows with a NULL id keep it. Other columns
    of ``docs`` are ignored. Repeated ids give repeated rows. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("gm_id"), pre_tokens(F.col(text_col)).alias("gm_tokens"))
    chunks = written(rows.mapInArrow(_chunks, _CHUNK))
    placed = chunks.select("gm_chunk", F.posexplode("gm_words").alias("gm_no", "gm_word"))
    counted = placed.groupBy("gm_word").agg(F.count("*").alias("gm_n"))
    coded = counted.mapInArrow(_encoder(path), "gm_word string, gm_n bigint, gm_ids array<int>")
    # Words of very many chunks come back by broadcast, so that none of them meets in one task.
    pieces = attach(placed, coded, ["gm_word"], "gm_n").groupBy("gm_chunk").agg(F.collect_list(F.struct("gm_no", "gm_ids")).alias("gm_pieces"))
    whole = chunks.drop("gm_words").join(pieces, "gm_chunk", "left")
    schema = "doc_id bigint, n_tokens bigint" if only_counts else "doc_id bigint, ids array<int>"
    return whole.select("gm_docs", "gm_counts", "gm_codes", "gm_wide", "gm_pieces").mapInArrow(_assembler(only_counts), schema)


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token-byte table: all bytes, and where each id's bytes start and how many they are; its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        pieces = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    size = np.array([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)], np.int64)
    blob = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(size))), np.uint8)
    return blob, np.cumsum(size) - size, size


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, start, size = _token_bytes(path)
        for batch in batches:
            lists = batch.column(1)
            ids = np.asarray(lists.flatten())
            n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            length = size[ids]
            after = np.concatenate([[0], np.cumsum(length)])
            data = blob[np.repeat(start[ids] - after[:-1], length) + np.arange(after[-1])]
            ends = after[np.concatenate([[0], np.cumsum(n)])]
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary())], names=["doc_id", "raw"])

    return run


def decode(encoded: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, text) of encoded documents, by looking every id up in the token-byte table; empty id lists give the empty text."""
    raw = encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id bigint, raw binary")
    return raw.select("doc_id", F.decode("raw", "UTF-8").alias("text"))
