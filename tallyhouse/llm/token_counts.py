"""Token counts of texts under a unigram model, with scores shared along a trie of words.

A piece of the table is cut into pre-tokens (runs without white space, led by U+2581). Its
distinct pre-tokens are sorted, which lays out their trie: at each depth, neighbours with
equal prefixes are one node. The best score of a node follows from its ancestors' and from the
vocabulary pieces that end there, and is computed once for all pre-tokens below it. What a
pre-token's last node holds is its token count, and texts add up those. A pre-token of over
`LONGEST` bytes shares nearly nothing with others and goes through the same recurrence alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.wordstream import pieces, substring_sums, words_of
from tallyhouse.session import ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEAD = "▁".encode()
LONGEST = 1024
PIECE_BYTES = 1 << 22


class Vocabulary(NamedTuple):
    """Pieces as bytes, their log probabilities, and that of a byte no piece covers."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_score: float


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces of a sentencepiece file, without control and byte pieces.

    A file of ranks rather than probabilities, as of a merge vocabulary, is read as a Zipf
    distribution: a piece's log probability is minus the logarithm of its place.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    texts = [model.id_to_piece(i).encode() for i in ids]
    scores = np.array([model.get_score(i) for i in ids])
    order = np.argsort(-scores, kind="stable")
    if np.array_equal(scores[order], np.round(scores[order])):
        scores[order] = -np.log(np.arange(2, len(ids) + 2))
    return Vocabulary(texts, scores, float(scores.min()) - 10)


class _Lookup:
    """Scores of pieces by length and hash."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        best: dict[bytes, float] = {}
        for piece, score in zip(vocabulary.pieces, vocabulary.scores):
            best[piece] = max(score, best.get(piece, -np.inf))
        self.byte_score, self.best = vocabulary.byte_score, best
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in best if p}):
            own = [p for p in best if len(p) == size]
            data = np.frombuffer(b"".join(own), np.uint8)
            sums, down = substring_sums(data)
            at = np.arange(len(own)) * size
            named = (sums[at + size] - sums[at]) * down[at]
            order = np.argsort(named)
            self.tables[size] = named[order], np.array([best[p] for p in own])[order]

    def scores(self, size: int, named: np.ndarray) -> np.ndarray:
        keys, scores = self.tables[size]
        at = np.minimum(np.searchsorted(keys, named), len(keys) - 1)
        return np.where(keys[at] == named, scores[at], -np.inf)


def long_count(token: bytes, lookup: _Lookup) -> int:
    """Pieces on the best path of one long pre-token, by the recurrence of `trie_counts` over a
    window as wide as the longest piece."""
    data = LEAD + token
    sizes, window = list(lookup.tables), max(lookup.tables, default=1) + 1
    score, count = [0.0] * window, [0] * window  # of the places before, by place modulo window
    for end in range(1, len(data) + 1):
        before = (end - 1) % window
        best, steps = score[before] + lookup.byte_score, count[before] + 1
        for size in sizes:
            if size > end:
                break
            own = lookup.best.get(data[end - size: end])
            if own is not None:
                at = (end - size) % window
                found, more = score[at] + own, count[at] + 1
                if found > best or (found == best and more < steps):
                    best, steps = found, more
        score[end % window], count[end % window] = best, steps
    return count[len(data) % window]


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct pre-tokens in byte order, and the place of each among them."""
    sums, down = substring_sums(data)
    named = (sums[end] - sums[start]) * down[start]
    _, first, place = np.unique(named, return_index=True, return_inverse=True)
    a, size = start[first], (end - start)[first]
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    own = pa.Array.from_buffers(pa.large_binary(), len(first), [
        None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)),
        pa.py_buffer(data[np.repeat(a, size) + inner])])
    order = np.asarray(pc.sort_indices(own))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return own.take(pa.array(order)), rank[place]


def trie_counts(tokens: pa.Array, lookup: _Lookup) -> np.ndarray:
    """Pieces on the best path of each of the sorted distinct pre-tokens.

    Among equal scores the path of fewer pieces wins, then the one with the shorter last piece.
    """
    n = len(tokens)
    own = np.asarray(pc.binary_length(tokens)).astype(np.int64)
    size = own + len(LEAD)
    data = np.frombuffer(b"".join(LEAD + t for t in tokens.to_pylist()), np.uint8)
    begin = np.cumsum(size) - size
    sums, down = substring_sums(data)
    widest = max(lookup.tables, default=1)
    score, count = {0: np.zeros(n)}, {0: np.zeros(n, np.int64)}
    result = np.zeros(n, np.int64)
    alive = np.arange(n)
    for depth in range(1, int(size.max(initial=0)) + 1):
        alive = alive[size[alive] >= depth]
        prefix = (sums[begin[alive] + depth] - sums[begin[alive]]) * down[begin[alive]]
        head = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        node = alive[head]  # the first pre-token below each node of this depth
        best = score[depth - 1][node] + lookup.byte_score
        steps = count[depth - 1][node] + 1
        for length in lookup.tables:
            if length > depth:
                continue
            a = begin[node] + depth - length
            found = score[depth - length][node] + lookup.scores(
                length, (sums[a + length] - sums[a]) * down[a])
            more = count[depth - length][node] + 1
            better = (found > best) | ((found == best) & (more < steps))
            best, steps = np.where(better, found, best), np.where(better, more, steps)
        below = np.cumsum(head) - 1
        score[depth], count[depth] = np.empty(n), np.empty(n, np.int64)
        score[depth][alive], count[depth][alive] = best[below], steps[below]
        ended = alive[size[alive] == depth]
        result[ended] = count[depth][ended]
        score.pop(depth - widest, None)
        count.pop(depth - widest, None)
    return result


def _tally(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(vocabulary)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                words = words_of(piece.column("text"))
                total = np.zeros(piece.num_rows, np.int64)
                short = words.end - words.start <= LONGEST
                if short.any():
                    tokens, place = _distinct(words.data, words.start[short], words.end[short])
                    np.add.at(total, words.text[short], trie_counts(tokens, lookup)[place])
                for w in np.flatnonzero(~short):
                    token = words.data[words.start[w]: words.end[w]].tobytes()
                    total[words.text[w]] += long_count(token, lookup)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(np.diff(words.bounds), pa.int64()),
                     pa.array(total)], names=["doc", "n_pretokens", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row: id, n_pretokens, n_tokens.

    A pre-token is U+2581 and a run without white space, whatever its length. Its tokens are the pieces of the segmentation with the largest summed log probability; a byte
    that no piece covers is a token of low probability. Null and empty texts count 0; null
    ids and repeated rows are counted like others. Columns not named are not read.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return read.mapInArrow(_tally(vocabulary), T.StructType(
        [read.schema["doc"], T.StructField("n_pretokens", T.LongType()),
         T.StructField("n_tokens", T.LongType())])).withColumnRenamed("doc", id_col)
