"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces of the product of their probabilities, which a forward pass over the word's
positions computes, rescaled on its way so that words of any length are scored whole; a text scores the sum of its words' log probabilities. The piece probabilities come from a few
rounds of expectation-maximisation over word counts; the rounds run as Spark jobs over the distinct words and bring
back no more than one number for each piece and language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMO_BYTES, MEMO_KEY, materialise, read_bytes, slices

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Positions between two rescalings, which keep products within a double's range.
RESCALE = 8
#: Cells (words x positions) and characters that a lattice holds at most, but for a word longer than that alone.
CELLS = 1 << 19
#: The probability of a character that the vocabulary lacks, in every language.
UNKNOWN = 1e-7
START = "▁"


def vocabulary(model: bytes) -> dict[str, int]:
    """Numbers of the pieces that words can hold: letters, with or without the sign for a word's start."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    kept = sorted({p.lower() for p in pieces if regex.fullmatch(rf"{START}?[\p{{L}}\p{{M}}]*", p)} | {START})
    return {p: i for i, p in enumerate(kept)}


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, each with the sign for its start."""
    return [START + word for word in WORD.findall(text.lower())]


def lattices(words: list[str], trie: Trie) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices of bounded size over all words, words of like lengths together: their positions in ``words``, and the lattice."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + max(1, int(np.searchsorted((np.arange(at, len(order)) - at + 1) * (size[order[at:]] + 1), CELLS, "right")))
        yield order[at:end], Lattice([words[i] for i in order[at:end]], trie)
        at = end


class Trie:
    """The pieces as a trie: the sorted keys (node, character) of its edges, where they lead, and each node's piece (-1: none)."""

    def __init__(self, vocab: dict[str, int]):
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for p, i in vocab.items():
            node = 0
            for c in p:
                node = edges.setdefault(node << 21 | ord(c), len(edges) + 1)
            ends[node] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.leads = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to, -1 where there is no such edge."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.leads[at], -1)


class Lattice:
    """The segmentations of many words at once: the edges from position s to e, by their end."""

    def __init__(self, words: list[str], trie: Trie):
        self.size = np.array([len(w) for w in words], np.int64)
        top, n = int(self.size.max(initial=0)), len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(n), self.size)
        start = np.arange(len(chars)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for length in range(1, top + 1):
            node = trie.step(node, chars[at + length - 1])
            piece = np.where(node >= 0, trie.piece[node], -1)
            # an unknown character is a piece of its own
            edge = slice(None) if length == 1 else piece >= 0
            found.append((row[at][edge], start[at][edge], piece[edge], np.full(len(at), length)[edge]))
            more = (node >= 0) & (start[at] + length < self.size[row[at]])
            at, node = at[more], node[more]
            if not len(at):
                break
        rows, starts, pieces, lengths = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        ends = starts + lengths
        self.reach = int(lengths.max(initial=1))
        order = np.argsort((ends * n + rows) * (top + 1) + starts)
        edges = np.searchsorted(ends[order], np.arange(top + 2))
        self.edges = [tuple(x[order[edges[e] : edges[e + 1]]] for x in (rows, starts, pieces)) for e in range(top + 1)]

    def forward(self, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of each prefix, words x positions x languages, and the logarithms of their scales.

        The last row of ``probability`` is the unknown piece's.
        """
        alpha = np.zeros((len(self.size), len(self.edges) or 1, probability.shape[1]))
        scale = np.zeros_like(alpha)
        alpha[:, 0] = 1
        for e, (row, start, piece) in enumerate(self.edges):
            if e:
                scale[:, e] = scale[:, e - 1]
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                alpha[row[first], e] = np.add.reduceat(alpha[row, start] * probability[piece], first)
            if e and e % RESCALE == 0:  # what later edges start at has one scale
                low = max(0, e - self.reach)
                top = alpha[:, low : e + 1].max(1, keepdims=True)
                top[top == 0] = 1
                alpha[:, low : e + 1] /= top
                scale[:, low : e + 1] += np.log(top)
        return alpha, scale

    def log_likelihood(self, probability: np.ndarray) -> np.ndarray:
        """Words x languages."""
        end = np.arange(len(self.size)), self.size
        alpha, scale = self.forward(probability)
        return np.log(alpha[end]) + scale[end]

    def expected(self, probability: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words seen ``count`` times, under one language's probabilities."""
        alpha, scale = (x[:, :, 0] for x in self.forward(probability))
        end = np.arange(len(self.size)), self.size
        whole = np.log(alpha[end]) + scale[end]
        beta, now = np.zeros_like(alpha), np.zeros(len(self.size))
        beta[end] = count
        out = np.zeros(len(probability))
        for e in range(len(self.edges) - 1, 0, -1):
            row, start, piece = self.edges[e]
            through = beta[row, e] * probability[piece, 0]
            np.add.at(out, piece, through * alpha[row, start] * np.exp(scale[row, start] + now[row] - whole[row]))
            np.add.at(beta, (row, start), through)
            if e % RESCALE == 0:
                low = max(0, e - self.reach)
                top = beta[:, low:e].max(1)
                top[(top == 0) | (self.size < e)] = 1  # a word that has not begun keeps its own scale
                beta[:, low:e] /= top[:, None]
                now += np.log(top)
        return out


def _prefixes(vocab: dict[str, int]) -> Trie:
    """Every prefix of a piece, as a trie."""
    return Trie(vocab)


def train_language_model(
    labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", model_path: str | None = None, max_docs: int = 1000, rounds: int = 2
) -> tuple[list[str], np.ndarray, bytes]:
    """Languages in order, piece probabilities (pieces + 1 x languages), and the vocabulary's model.

    Of each language about ``max_docs`` documents, chosen by a hash of their text, are learnt from; this bound is what
    keeps training the same at any size. Rows with a null language or text teach nothing.
    """
    spark = labelled.sparkSession
    model = read_bytes(model_path or public_tokenizers.path("piece_bpe_32k.model"))
    vocab = vocabulary(model)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(vocab) + 1, 0)), model
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, max_docs / sizes[k])))])
    chosen = rows.filter(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            found = [words_of(t) for t in b.column(1).to_pylist()]
            lang = [x for x, ws in zip(b.column(0).to_pylist(), found, strict=True) for _ in ws]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([w for ws in found for w in ws], pa.string())], ["lang", "word"])

    words = materialise(chosen.mapInArrow(split, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n")))
    probability = np.full((len(vocab) + 1, len(langs)), 1 / len(vocab))
    probability[-1] = UNKNOWN
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast((vocab, langs, probability))

        def step(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            vocab, langs, p = shipped.value
            trie, sums = _prefixes(vocab), np.zeros((len(langs), len(vocab) + 1))
            for b in slices(batches, 4096):
                lang, word, n = (np.array(b.column(i).to_pylist(), kind) for i, kind in enumerate((object, object, float)))
                for k, name in enumerate(langs):
                    mine = lang == name
                    for at, lattice in lattices(list(word[mine]), trie):
                        sums[k] += lattice.expected(p[:, k : k + 1], n[mine][at])
            k, piece = np.nonzero(sums[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(piece), pa.array(sums[k, piece])], ["lang", "piece", "n"])

        got = words.mapInArrow(step, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full((len(vocab), len(langs)), 0.01)
        sums[got["piece"].to_numpy(int), got["lang"].to_numpy(int)] += got["n"].to_numpy(float)
        probability[:-1] = sums / sums.sum(0)
    return langs, probability, model


def predict_language(docs: DataFrame, trained: tuple[list[str], np.ndarray, bytes], *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The language of every whole text: ``lang_pred`` and ``score``, the posterior under equal priors.

    ``und`` with score 0 for a text that is null or has no letter, or where no language was learnt. Of equally likely
    languages the first by name counts. Each input row gives one output row, repeated and null ids
    and repeated texts included; ``keep`` names columns to carry along, ``names`` the two new columns, which must not be
    among those. Other columns are not read. An empty table gives an empty result. Texts of any length are scored whole.
    """
    langs, probability, model = trained
    shipped = docs.sparkSession.sparkContext.broadcast((langs, probability, vocabulary(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, probability, vocab = shipped.value
        trie, width = _prefixes(vocab), len(langs) + 1
        memo: dict[str, int] = {}
        held = 0
        table = np.zeros((0, width))  # of each chunk: log likelihood by language, and its number of words
        for b in slices(batches):
            chunks = [(t or "").lower().split() for t in b.column(b.num_columns - 1).to_pylist()]
            if held + table.nbytes > MEMO_BYTES:
                memo, held, table = {}, 0, np.zeros((0, width))
            new = list(set().union(*chunks) - memo.keys())
            if new:
                parts = [words_of(c) for c in new]
                distinct = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
                words, likely = list(distinct), np.zeros((len(distinct), len(langs)))
                for at, lattice in lattices(words, trie):
                    likely[at] = lattice.log_likelihood(probability)
                more = np.zeros((len(new), width))
                owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
                which = np.array([distinct[w] for p in parts for w in p], np.int64)
                np.add.at(more, owner, np.c_[likely[which], np.ones(len(which))])
                memo.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate([table, more])
            total = np.array([table[np.fromiter(map(memo.__getitem__, c), np.int64, len(c))].sum(0) for c in chunks]).reshape(-1, width)
            for c in new:  # long chunks are not kept
                if len(c) > MEMO_KEY:
                    del memo[c]
                else:
                    held += sys.getsizeof(c) + 100
            known = (total[:, -1] > 0) & bool(langs)
            pred, score = np.full(len(total), "und", object), np.zeros(len(total))
            if langs:
                logs = total[:, :-1]
                best = logs.argmax(1)
                pred[known] = np.array(langs, object)[best[known]]
                score[known] = (1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1))[known]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], [*b.schema.names[:-1], *names])

    carried = [id_col, *[c for c in keep or [] if c != id_col]]
    source = docs.select(*carried, F.col(text_col).alias("_kb_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def id_bucket(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(buckets))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, max_docs: int = 1000) -> DataFrame:
    """Train on the documents outside the held-out fold, then predict every document; see the two steps above.

    The fold is crc32(id as text) mod ``folds``; the language column and the id never enter a prediction. Nulls, repeated
    rows, empty tables and other columns: see ``predict_language``.
    """
    train = docs.filter(id_bucket(id_col, folds) != held_out)
    trained = train_language_model(train, text_col=text_col, lang_col=lang_col, max_docs=max_docs)
    out = predict_language(docs, trained, id_col=id_col, text_col=text_col)
    return out.select(id_col, (id_bucket(id_col, folds) == held_out).alias("held_out"), "lang_pred", "score")
