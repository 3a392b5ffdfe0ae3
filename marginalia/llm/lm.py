"""Language-model scores: the marginal probability of a text over all its subword segmentations.

The pieces and their order of merit come from an existing vocabulary; their probabilities start from its
scores and are re-estimated on the training documents by expectation over all segmentations. Pieces do not
span blanks, so a document's marginal is the product of its words' marginals and the end's: each distinct
word's lattice is run once for the whole corpus, by forward recursion in log space.

Words are looked up by their share of the corpus. One that makes up at least ``1 / head`` of all words is
in the broadcast head, which can therefore hold ``head`` words at most. The rest meet their counts in a join,
in which no key is frequent; a document's repeated words are counted before they are shuffled.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from math import exp, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_id, persisted

#: Stands for a blank in front of a word, as in the vocabulary.
_BLANK = "▁"
_LN10 = log(10)
#: Distinct words that a task counts before it hands them on.
_FLUSH = 150_000
#: Words for one task that runs lattices, and characters of a word whose edges are kept.
_WORDS_PER_TASK, _LONG = 30_000, 4096
#: Characters of a word that may be fitted by plain probabilities, and the least that a word's may be.
_PLAIN, _SMALLEST = 128, 1e-200


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and their prior probabilities, from a sentencepiece model.

    Scores of a unigram model are log probabilities. Those of a merge table are negative ranks, taken by
    Zipf's law. Bytes, unused and special pieces have the smallest probability of all.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    plain = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and scores[i] > -1e8 for i in range(n)])
    ranked = bool((scores[plain] <= -1).all() and scores[plain].min() < -1000)
    weights = 1 / (2.7 - scores) if ranked else np.exp(scores)
    weights[~plain] = weights[plain].min()
    return pieces, weights / weights.sum()


@lru_cache(maxsize=1)
def _tree(pieces: tuple[str, ...]) -> tuple[dict, list[int]]:
    """Of each first character its piece, or -1, and the same for what may follow; the pieces of bytes. Workers keep it from task to task."""
    of_bytes, kept, grown = [0] * 256, {}, ({}, [-1])
    for i, piece in enumerate(pieces):
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            of_bytes[int(piece[3:5], 16)] = i
        elif piece and _BLANK not in piece[1:] and not (piece.startswith("<") and piece.endswith(">") and len(piece) > 2):
            kept[piece] = i
    for piece, i in kept.items():
        at = grown
        for char in piece:
            at = at[0].setdefault(char, ({}, [-1]))
        at[1][0] = i

    def frozen(level: dict) -> dict:
        return {char: (piece[0], frozen(more)) for char, (more, piece) in level.items()}

    return frozen(grown[0]), of_bytes


class Lattice:
    """All segmentations of a word into pieces, with the pieces' natural log probabilities."""

    def __init__(self, pieces: list[str], logs: np.ndarray) -> None:
        self.logs = logs.tolist()
        self.shares = np.exp(logs).tolist()
        self.first, self.bytes = _tree(tuple(pieces))

    def edges(self, text: str, i: int) -> list[tuple[int, int, float]]:
        """From a place: end, piece and log probability of the pieces there; bytes (piece -1) for an unknown character."""
        logs, out, following, j = self.logs, [], self.first, i
        while j < len(text):
            got = following.get(text[j])
            if got is None:
                break
            piece, following = got
            j += 1
            if piece >= 0:
                out.append((j, piece, logs[piece]))
        if not out or out[0][0] != i + 1:
            out.append((i + 1, -1, self._bytes(text[i])))
        return out

    def _bytes(self, char: str) -> float:
        return sum(self.logs[self.bytes[b]] for b in char.encode())

    def marginal(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations. Places that are passed are let go, so memory is small for words of any length."""
        text, first, logs, none = _BLANK + word, self.first, self.logs, float("-inf")
        n = len(text)
        alpha: list[float | None] = [0.0] + [none] * n
        for i in range(n):
            a, following, known = alpha[i], first, False
            alpha[i] = None
            for j in range(i, n):
                got = following.get(text[j])
                if got is None:
                    break
                piece, following = got
                if piece >= 0:
                    known = known or j == i
                    x, y = alpha[j + 1], a + logs[piece]
                    if x < y:
                        x, y = y, x
                    alpha[j + 1] = x + log1p(exp(y - x)) if y > none else x
            if not known:
                x, y = alpha[i + 1], a + self._bytes(text[i])
                if x < y:
                    x, y = y, x
                alpha[i + 1] = x + log1p(exp(y - x)) if y > none else x
        return alpha[n]

    def expected(self, word: str, weight: float, into: np.ndarray | list[float]) -> None:
        """Add ``weight`` times the expected number of uses of each piece.

        Plain probabilities do where they are large enough for that, logarithms otherwise. The edges of a long word are looked up again where they are used, not kept.
        """
        if len(word) < _PLAIN and self._expected_plain(word, weight, into):
            return
        text, none = _BLANK + word, float("-inf")
        n = len(text)
        numbers = list if n <= _LONG else partial(array, "d")
        at = [self.edges(text, i) for i in range(n)].__getitem__ if n <= _LONG else partial(self.edges, text)
        alpha, beta = numbers([0.0] + [none] * n), numbers([0.0] * (n + 1))
        for i in range(n):
            a = alpha[i]
            for j, _, lp in at(i):
                x, y = alpha[j], a + lp
                if x < y:
                    x, y = y, x
                alpha[j] = x + log1p(exp(y - x)) if y > none else x
        for i in range(n - 1, -1, -1):
            parts = [lp + beta[j] for j, _, lp in at(i)]
            top = max(parts)
            beta[i] = top + log(sum([exp(x - top) for x in parts]))
        total = alpha[n]
        for i in range(n):
            a = alpha[i] - total
            for j, piece, lp in at(i):
                share = weight * exp(a + lp + beta[j])
                if piece >= 0:
                    into[piece] += share
                else:
                    for b in text[i].encode():
                        into[self.bytes[b]] += share


    def _expected_plain(self, word: str, weight: float, into: np.ndarray | list[float]) -> bool:
        """As :meth:`expected` by plain probabilities; false, and nothing is added, where the word's is too small for them."""
        text, first, shares = _BLANK + word, self.first, self.shares
        n = len(text)
        alpha, beta, at = [1.0] + [0.0] * n, [0.0] * (n + 1), []
        for i in range(n):
            a, following, here, known = alpha[i], first, [], False
            for j in range(i, n):
                got = following.get(text[j])
                if got is None:
                    break
                piece, following = got
                if piece >= 0:
                    known = known or j == i
                    p = shares[piece]
                    here.append((j + 1, piece, p))
                    alpha[j + 1] += a * p
            if not known:
                p = exp(self._bytes(text[i]))
                here.append((i + 1, -1, p))
                alpha[i + 1] += a * p
            at.append(here)
        if alpha[n] < _SMALLEST:
            return False
        beta[n] = weight / alpha[n]
        for i in range(n - 1, -1, -1):
            a, total = alpha[i], 0.0
            for j, piece, p in at[i]:
                x = p * beta[j]
                total += x
                if piece >= 0:
                    into[piece] += a * x
                else:
                    for b in text[i].encode():
                        into[self.bytes[b]] += a * x
            beta[i] = total
        return True


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    return read_vocabulary(path)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c, a``: how often each word is in the training texts (``not held_out``) and in all, of ``docs(text, held_out)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def flushed() -> pa.RecordBatch:
            words = list(train.keys() | other.keys())
            c = [train[w] for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([x + other[w] for x, w in zip(c, words, strict=True)], pa.int64())], ["word", "c", "a"])

        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1), strict=True):
                (other if held.as_py() else train).update((text.as_py() or "").encode().lower().split())
                if len(train) + len(other) > _FLUSH:
                    yield flushed()
                    train, other = Counter(), Counter()
        if train or other:
            yield flushed()

    parts = docs.select("text", "held_out").mapInArrow(count, "word binary, c long, a long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def fit_pieces(words: DataFrame, ends: int, vocabulary: str, rounds: int = 1, prior: float = 1000.0) -> tuple[np.ndarray, float]:
    """Natural log probabilities of the pieces and of the end, after ``rounds`` of expectation over the training words.

    The vocabulary's own probabilities count as ``prior`` pieces seen; with ``rounds=0`` they are taken as they are. What reaches the driver is one number
    for each piece of the vocabulary.
    """
    pieces, base = _vocabulary(vocabulary)
    n, current = len(pieces), base
    for _ in range(rounds):
        logs = np.log(current)

        def expect(frames: Iterator[pd.DataFrame], logs=logs) -> Iterator[pd.DataFrame]:
            lattice, sums = Lattice(_vocabulary(vocabulary)[0], logs), [0.0] * n
            for frame in frames:
                for word, c in zip(frame["word"], frame["c"], strict=True):
                    lattice.expected(bytes(word).decode(), float(c), sums)
            used = np.flatnonzero(sums)
            yield pd.DataFrame({"piece": used, "n": np.array(sums)[used]})

        seen = words.where("c > 0").select("word", "c").mapInPandas(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = base * prior
        for r in seen:
            counts[r.piece] += r.n
        current = counts / counts.sum()
    total = sum(r.n for r in seen) + prior if rounds else prior
    end = (ends + 1) / (total + ends + 1)
    return np.log(current * (1 - end)), log(end)


def score(docs: DataFrame, vocabulary: str, rounds: int = 1, head: int = 50_000, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``score`` is log10 of the text's probability: of its words' lattices and of the end. ``base_score`` is
    the smoothed unigram of whole words. Words are runs without ASCII white space, A-Z lowered. Learning is
    from documents whose id's CRC-32 leaves another remainder than ``held_fold``; a null id counts as empty
    text there. A null or empty text is its end alone. Rows with null or equal ids are rows of their own;
    other columns are ignored. Without training documents all words are unknown.
    """
    marked = docs.select("doc_id", "text", (fold_id(F.col("doc_id")) % folds == held_fold).alias("held_out"))
    words = persisted(word_counts(marked), "words")
    ends = marked.where("NOT held_out").count()
    sums = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("a"), F.count("*")).first()
    tokens, kinds, every, distinct = (x or 0 for x in sums)
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    spread = words.repartition(max(1, -(-distinct // _WORDS_PER_TASK)))
    logs, end_log = fit_pieces(spread, ends, vocabulary, rounds)

    def run_lattices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(_vocabulary(vocabulary)[0], logs)
        for frame in frames:
            yield frame.assign(lm=[lattice.marginal(bytes(w).decode()) / _LN10 for w in frame["word"]])

    scored = persisted(spread.mapInPandas(run_lattices, "word binary, c long, a long, lm double"), "scored")
    frequent = scored.where(F.col("a") * head >= every).select("word", "c", "lm").collect()
    known = marked.sparkSession.sparkContext.broadcast({bytes(r.word): (r.c, log(r.c + 1) / _LN10, r.lm) for r in frequent})
    each = log(tokens + kinds + 1) / _LN10
    end_base, end_lm = log(ends + 1) / _LN10 - each, end_log / _LN10

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "row", "word", "n"]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int32()]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, get = TaskContext.get().partitionId() << 33, known.value.get

        def made(*columns) -> pa.RecordBatch:
            n = max(map(len, columns))
            return pa.RecordBatch.from_arrays([pa.array(c, t) if len(c) else pa.nulls(n, t) for c, t in zip(columns, types, strict=True)], names)

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, held, heads = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
                rare, rows, ns = [], [], []
                for text in batch.column(1):
                    n_tokens, n_known, base, lm = 1, int(ends > 0), end_base, end_lm
                    for word, n in Counter((text.as_py() or "").encode().lower().split()).items():
                        n_tokens += n
                        if found := get(word):
                            if found[0]:
                                n_known += n
                            base += n * found[1]
                            lm += n * found[2]
                        else:
                            rare.append(word)
                            rows.append(row)
                            ns.append(n)
                    heads.append((n_tokens, n_known, base - (n_tokens - 1) * each, lm, row))
                    row += 1
                if heads:
                    yield made(ids, held, *zip(*heads, strict=True), [], [])
                if rare:
                    yield made([], [], [], [], [], [], rows, rare, ns)

    looked = persisted(marked.select(F.col("doc_id").cast("string"), "text", "held_out").mapInArrow(look_up, "doc_id string, held_out boolean, n_tokens long, n_known long, base double, lm double, row long, word binary, n int"), "looked-up")
    met = looked.where("word IS NOT NULL").select("word", "row", "n").join(scored.select("word", "c", F.col("lm").alias("word_lm")), "word")
    rest = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("base"), F.sum(F.col("n") * F.col("word_lm")).alias("lm"))
    own = looked.where("word IS NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm")
    both = own.unionByName(rest, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "base", "lm")])
    return both.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lm").alias("score"))
