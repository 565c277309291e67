"""Packing by power-of-two decomposition.

A document's tokens and one end token are cut into pieces whose lengths are the powers of two of its length, the
longest first: as many full sequences as fit, then one piece for each bit of the rest. Every piece is a sequence of
its own, so no sequence crosses documents and none is padded. Sequences of one length form a bucket: their ids stand
in one range of numbers, so that batches of equal lengths are read off in order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Sequence ids: bucket, then task, then the piece's number in its task.
TASK_BITS, PIECE_BITS = 26, 31
# The printable form of bytes in byte-level vocabularies maps these to themselves, the rest from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Texts of these characters are cut alike by both libraries, whatever their tables of other scripts say.
_COMMON = regex.compile(r"[\t\n\r\x20-\x7EÀ-ſ]*")


@lru_cache(maxsize=2)
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary for a quicker library, and the special strings that only the first one knows."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    shown = {chr(b): b for b in _PLAIN} | {
        chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}
    special = {x["content"] for x in held.get("added_tokens", [])}
    ranks = {bytes(shown[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids by the tokenizer at ``path`` without added special tokens.

    Common texts go through a quicker library with the same vocabulary, the
    others, or those that hold a special token's string, through ``tokenizers``.
    """
    encoding, special = _fast(path)
    if _COMMON.fullmatch(text) and not any(x in text for x in special):
        return np.array(encoding.encode_ordinary(text), dtype="<u4")
    return np.array(_whole(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces_of(length: int, longest: int) -> list[int]:
    """Lengths of a document's pieces; ``longest`` is a power of two."""
    rest = length % longest
    return [longest] * (length // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(documents: DataFrame, tokenizer: str, longest: int = 1024, end_token: int = 0, with_ids: bool = True) -> DataFrame:
    """A row for each piece of each document (doc_id, text).

    doc_id, start (tokens before it), length, ids (if ``with_ids``), ids_crc32
    of the little-endian unsigned 32-bit ids, doc_tokens with the end token,
    sequence_id, offset (0, as a piece fills its sequence), bucket (the
    sequence's length). A null or empty text is the end token alone. Repeated
    rows are packed each. Ids of sequences are unique and the same when a lost
    task runs again, given the same input splits. Other columns are ignored;
    an empty table gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    columns = ["doc_id", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        kinds = {"doc_id": None, "ids": pa.list_(pa.int32())}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: dict[str, list] = {c: [] for c in columns}
                kinds["doc_id"] = part.column("doc_id").type
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(token_ids(text, tokenizer) if text else np.empty(0, "<u4"), end_token).astype("<u4")
                    start = 0
                    for length in pieces_of(len(ids), longest):
                        piece = ids[start : start + length]
                        values = {
                            "doc_id": doc, "start": start, "length": length, "ids": piece.astype(np.int32),
                            "ids_crc32": zlib.crc32(piece.tobytes()), "doc_tokens": len(ids), "offset": 0, "bucket": length,
                            "sequence_id": ((length.bit_length() - 1) << TASK_BITS + PIECE_BITS) + (task << PIECE_BITS) + made}
                        for c in columns:
                            rows[c].append(values[c])
                        start, made = start + length, made + 1
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.int64())) for c in columns], columns)

    kind = dict(documents.dtypes)["doc_id"]
    shape = ", ".join(f"{c} {kind if c == 'doc_id' else 'array<int>' if c == 'ids' else 'long'}" for c in columns)
    return documents.select("doc_id", "text").mapInArrow(run, shape)
