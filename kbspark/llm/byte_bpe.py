"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Every byte string of the rank file becomes a piece whose characters stand for its bytes one by one, with score
-rank; the normaliser is the identity, with no dummy prefix and no space handling. Best-score-first merging then is
lowest-rank-first merging. Pre-tokens are encoded separately, ids map back to the ranks, and decoding maps pieces back
to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BatchMemo, read_bytes, slices

#: One character for each byte; the block has no spaces, marks or combining forms that any normaliser would touch.
BYTE_CHARS = "".join(chr(0x4E00 + b) for b in range(256))
_TO_CHARS = {b: BYTE_CHARS[b] for b in range(256)}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank in each line."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def to_chars(data: bytes) -> str:
    """Bytes as characters of ``BYTE_CHARS``."""
    return data.decode("latin-1").translate(_TO_CHARS)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto for ``ranks``: id 0 is the unknown piece, id i the i-th smallest rank.

    Field numbers are those of the public sentencepiece_model.proto.
    """
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    unknown, normal, bpe = 2, 1, 2
    out = [piece("<unk>", 0.0, unknown)]
    out += [piece(to_chars(token), -float(rank), normal) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _number(3, bpe) + _number(4, len(ranks) + 1) + _number(40, 0) + b"".join(_number(i, -1) for i in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _block(2, trainer) + _block(3, normaliser)


class ByteBpe:
    """Encoder and decoder for one vocabulary; the memo of merged pre-tokens is bounded."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.ranks = sorted(ranks.values())
        self.whole = {token.decode(): (rank,) for token, rank in ranks.items() if _is_text(token)}
        self.memo = BatchMemo(self._merge, self.whole, lambda ids: 64 + 8 * len(ids))
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def _merge(self, new: list[str]) -> Iterator[tuple[int, ...]]:
        ids = self.sp.encode([to_chars(p.encode()) for p in new], num_threads=1)
        return (tuple(self.ranks[i - 1] for i in x) for x in ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the matches of the pattern are encoded one by one."""
        split = [self.split(t) for t in texts]
        self.memo.learn(set().union(*split))
        get = self.memo.__getitem__
        out = [list(chain.from_iterable(map(get, s))) for s in split]
        self.memo.settle()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(2)
def _codec(model: bytes, data: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(model, read_ranks(data), pattern)


def byte_bpe_roundtrip(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    keep_ids: bool = False,
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both (``ids`` too with ``keep_ids``).

    A null text counts as empty: no ids, the digests of empty strings. Each input row gives one output row, repeated
    and null ids included; other columns are not read. An empty table gives an empty result. Texts of any length are encoded
    whole; a task holds a slice of rows and their ids.
    """
    data = read_bytes(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    shipped = docs.sparkSession.sparkContext.broadcast((serialise_model(read_ranks(data)), data))
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shipped.value, pattern)
        decimal = {rank: str(rank) for rank in codec.ranks}.__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array(map(len, ids), pa.int64()),
                pa.array([sha(" ".join(map(decimal, x)).encode()) for x in ids]),
                pa.array([sha(codec.decode(x)) for x in ids]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    )
    return out.withColumnRenamed("id", id_col)
