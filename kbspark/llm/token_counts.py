"""Token counts with a whole-token shortcut.

A sentencepiece BPE model with an identity normaliser turns spaces into ``▁`` and never merges across the start of a
run of ``▁`` as long as no piece holds ``▁`` after another character. So a text splits into pre-tokens (a run of
``▁`` and what follows it), each encoded on its own. The vocabulary pieces shaped like a pre-token that encode alone
as one token are found once, before the job; pre-tokens among them count 1 without any merge, and only the rest is
merged by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BatchMemo, read_bytes, slices

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")


@lru_cache(2)
def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def whole_tokens(model: bytes) -> frozenset[str]:
    """The pre-tokens that encode alone as exactly one token; proves the split into pre-tokens on the way.

    Raises ValueError for a model whose pieces or normaliser would make the split inexact.
    """
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("a piece crosses the start of a pre-token")
    # A leading space comes from the model itself; runs, tabs, wide forms and composed letters must stay as they are.
    for probe in ("a  b", " a", "a ", "a\tb\n", "Ａ́é ½", ""):
        if sp.decode(sp.encode(probe)) != probe and sp.encode(probe) != sp.encode(probe.replace(" ", SPACE)):
            raise ValueError("the normaliser is not the identity")
    shaped = [p for p in pieces if PRE_TOKEN.fullmatch(p) and len(p) > 1]
    alone = sp.encode([p[1:] for p in shaped], num_threads=1)
    return frozenset([p for p, ids in zip(shaped, alone, strict=True) if len(ids) == 1] + [SPACE] * (SPACE in pieces))


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; none of an empty text."""
    return PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


class _Counter:
    """Counts tokens; remembers the counts of merged pre-tokens within a bound."""

    def __init__(self, model: bytes, whole: frozenset[str]):
        merge = _processor(model).encode
        self.known = BatchMemo(lambda new: map(len, merge([s[1:] for s in new], num_threads=1)), dict.fromkeys(whole, 1))

    def count(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        self.known.learn(set().union(*split))
        out = [sum(map(self.known.__getitem__, s)) for s in split]
        self.known.settle()
        return out


def token_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str | None = None,
    max_tokens: int = 4096,
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has over ``max_tokens`` tokens.

    A null text counts as empty (0 bytes, 0 tokens). Rows with a null or repeated id stay, one output row for each
    input row; other columns of ``docs`` are not read. An empty table gives an empty result. Texts of any length are counted
    whole; a task holds a slice of rows and a few times the size of their texts.
    """
    model = read_bytes(model_path or public_tokenizers.path("piece_bpe_32k.model"))
    shipped = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(model)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(*shipped.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = pa.array(counter.count(texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"id {kind}, n_bytes long, n_tokens long"
    )
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
