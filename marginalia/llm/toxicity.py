"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers letters, takes accents off, replaces look-alike letters of other scripts and shapes and digits or
signs that stand for letters, drops invisible characters, and turns what is no letter into blanks. The lexicon is learnt: beginnings of words,
or whole words, that are many times as frequent in toxic texts as in clean ones, each weighing what it is worth for
sure. Exception phrases are word pairs around a term that clean texts use and toxic ones do not; a hit inside
one does not count. A text's weight is divided by its words; a logistic curve fitted to labelled texts turns
that rate, and the weight of the heaviest hit, into a score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, islice
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_id

#: Small letters of Cyrillic, Greek and Armenian that look like Latin ones, and the digits and signs that stand for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ҽ": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "ѡ": "w", "х": "x", "у": "y", "ү": "y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "χ": "x", "γ": "y", "ω": "w",
    "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_SIGN = re.compile(r"[@$!|]+(?=[^\W_])")
#: Names of letters that are a Latin one in another shape.
_SHAPED = re.compile(r"LATIN (?:SMALL |CAPITAL )?LETTER (?:SMALL CAPITAL |DOTLESS |SCRIPT )?([A-Z])(?: WITH .*)?$|(?:NEGATIVE (?:CIRCLED|SQUARED) LATIN CAPITAL|REGIONAL INDICATOR SYMBOL) LETTER ([A-Z])$")

#: Labelled rows of each class that the lexicon and the curve are learnt from; they bound what is collected of them.
SAMPLE = 10_000
#: Least toxic texts that have a term; least weight of one: the natural log of how many times as frequent it is
#: in toxic texts, less ``DOUBT`` standard errors.
LEAST_TEXTS, LEAST_WEIGHT, DOUBT = 4, 1.0, 1.64
#: Shortest and longest beginning of a word.
_SHORT, _LONG = 3, 24
_RATE_FLOOR = 1e-4


class _Table(dict):
    """What each character of decomposed text becomes, found once: a small Latin letter, itself, nothing (marks and invisible characters) or a blank."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = char.lower()
        shaped = _SHAPED.match(unicodedata.name(char, ""))
        if unicodedata.category(char) in ("Mn", "Me", "Cf"):
            out = ""
        elif shaped:
            out = (shaped[1] or shaped[2]).lower()
        else:
            out = _LOOKALIKES.get(low) or _DIGITS.get(low, low) if low.isalnum() else " "
        self[code] = out
        return out


_TABLE = _Table()
#: A run of anything but white space.
_RUN = re.compile(r"\S+")


def fold(text: str) -> str:
    """The text as it is matched: small unaccented letters, one blank for each other sign; marks and invisible characters go."""
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: "".join(_SIGNS[c] for c in m[0]), text)
    return (text if text.isascii() else unicodedata.normalize("NFKD", text)).translate(_TABLE)


@dataclass
class Lexicon:
    """``terms``: a blank and the beginning of a word (with a blank after it: the whole word) to its weight.
    ``exceptions``: folded phrases within which hits do not count. ``slopes`` and ``offset``: the curve."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = -6.0

    def __post_init__(self) -> None:
        self._found = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def _automaton(self):
        import ahocorasick

        if self._found is None:
            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            found.make_automaton()
            self._found = found
        return self._found

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the terms found; of those that start a word together the heaviest, outside of exceptions."""
        if not self.terms:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (n, weight) in self._automaton().iter(f" {folded} "):
            start = last - n + 1
            if weight is None:
                spared.append((start, last))
            elif start not in best or best[start][1] < weight:
                best[start] = (last, weight)
        spared.sort()
        starts, reach = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        # of the spans that begin up to a hit, one holds it if the longest of them does
        return [(a, b, w) for a, (b, w) in best.items() if not (i := bisect_right(starts, a)) or reach[i - 1] <= a]

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the hits' weight by the number of words, and the weight of the heaviest hit."""
        if not text:
            return log(_RATE_FLOOR), 0.0
        folded = fold(text)
        weights = [w for _, _, w in self.hits(folded)]
        return log(sum(weights) / max(1, len(folded.split())) + _RATE_FLOOR) if weights else log(_RATE_FLOOR), max(weights, default=0.0)

    def score(self, text: str | None) -> float:
        """0 to 1; of a text without hits, empty ones included, the curve's foot."""
        rate, most = self.features(text)
        return 1 / (1 + exp(-max(-60.0, min(60.0, self.offset + self.slopes[0] * rate + self.slopes[1] * most))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of up to ``sample`` training rows of each class, chosen by a hash of the id.

    Only rows with a CRC-32 of the id that leaves another remainder than 1 by 3, and with a label of 0 or 1;
    an id that has both labels counts as toxic. The sample's ids are at most twice ``sample``, which bounds
    the broadcast.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold_id(F.col("doc_id")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # as literals of the plan, not a table read again
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("text", "toxic")


def _candidates(folded: str) -> Counter:
    """How often each beginning of a word, and each whole word, is in a folded text."""
    out = Counter()
    for word, n in Counter(folded.split()).items():
        if len(word) >= _SHORT:
            for k in range(_SHORT, min(len(word), _LONG) + 1):
                out[f" {word[:k]}"] += n
            out[f" {word} "] += n
    return out


def _counted(rows: DataFrame, of) -> DataFrame:
    """``term, clean, toxic, clean_uses, toxic_uses``: texts of each class that have a term that ``of(folded text)``
    counts, and its uses in them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Counter() for _ in range(4)]

        def flushed() -> pa.RecordBatch:
            terms = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([s[t] for t in terms], pa.int64()) for s in sums]], ["term", *names])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = of(fold(text.as_py() or ""))
                sums[toxic].update(found.keys())
                sums[2 + toxic].update(found)
                if len(sums[0]) + len(sums[1]) > 120_000:
                    yield flushed()
                    sums = [Counter() for _ in range(4)]
        yield flushed()

    names = ["clean", "toxic", "clean_uses", "toxic_uses"]
    return rows.mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def _pruned(terms: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of beginnings that one longer one keeps nine tenths of, only the longer; then none that a kept one begins at no less weight."""
    longer: dict[str, int] = {}
    for term, (_, toxic) in terms.items():
        for k in range(2, len(term)):
            if (head := term[:k]) in terms:
                longer[head] = max(longer.get(head, 0), toxic)
    kept: dict[str, float] = {}
    for term in sorted(terms, key=lambda t: (len(t), t)):
        weight, toxic = terms[term]
        if longer.get(term, 0) < 0.9 * toxic and not any(kept.get(term[:k], -1.0) >= weight - 1.0 for k in range(2, len(term))):
            kept[term] = weight
    return kept


def _around(terms: dict[str, float]):
    """Counts the word pairs that a term is in, for a folded text."""
    lexicon = Lexicon(terms)

    def pairs(folded: str) -> Counter:
        padded, out = f" {folded} ", Counter()
        for start, _, _ in lexicon.hits(folded):
            end = start
            while end and padded[end - 1] == " ":
                end -= 1
            before, here = padded[padded.rfind(" ", 0, end) + 1 : end], [m[0] for m in islice(_RUN.finditer(padded, start), 2)]
            if before:
                out[f"{before} {here[0]}"] += 1
            if len(here) == 2:
                out[f"{here[0]} {here[1]}"] += 1
        return out

    return pairs


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Lexicon, exceptions and curve from the labelled sample: every term and phrase that passes the tests. Without toxic examples the lexicon is empty."""
    rows = labelled(docs, labels, sample)
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    sizes = {r.toxic: (r.n, r.words) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(words).alias("words")).collect()}
    if 1 not in sizes:
        return Lexicon({})
    clean, toxic = F.col("clean_uses") + 0.5, F.col("toxic_uses") + 0.5
    # by uses and by texts, of which the lower counts: a term that one text repeats says little
    rows_of = sizes.get(0, (0, 0))
    by_uses = F.log(toxic / (sizes[1][1] + 1)) - F.log(clean / (rows_of[1] + 1))
    by_texts = F.log((F.col("toxic") + 0.5) / (sizes[1][0] + 1)) - F.log((F.col("clean") + 0.5) / (rows_of[0] + 1))
    odds = F.least(by_uses, by_texts)
    # texts, not uses, are independent of each other
    sure = odds - DOUBT * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = _counted(rows, _candidates).where(F.col("toxic") >= LEAST_TEXTS).withColumn("sure", sure).where(F.col("sure") >= LEAST_WEIGHT)
    found = {r.term: (float(r.sure), int(r.toxic)) for r in best.select("term", "sure", "toxic").collect()}
    terms = _pruned(found)
    if not terms:
        return Lexicon({})
    pairs = _counted(rows, _around(terms)).where("clean >= 3 AND clean > 9 * toxic").select("term").collect()
    lexicon = Lexicon(terms, sorted(r.term for r in pairs))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)), batch.column(1).cast(pa.int32())], ["rate", "most", "toxic"])

    seen = rows.mapInArrow(measured, "rate double, most double, toxic int").toPandas().sort_values(["rate", "most", "toxic"])
    slopes, offset = _fitted(seen[["rate", "most"]].to_numpy(), seen["toxic"].to_numpy())
    return Lexicon(terms, lexicon.exceptions, slopes, offset)


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[tuple[float, float], float]:
    """Slopes and offset of a logistic curve by Newton's method."""
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    # a toxic row weighs as much as the root of their ratio in clean ones: between equal classes and equal rows
    weight = np.where(y == 1, np.sqrt(max(1, (y == 0).sum()) / max(1, (y == 1).sum())), 1.0)
    weight /= weight.sum()
    beta, held = np.zeros(3), np.array([ridge, ridge, 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(held), z.T @ (weight * (y - p)) - held * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:2] / spread
    return (float(slopes[0]), float(slopes[1])), float(beta[2] - slopes @ centre)


def scorer(lexicon: Lexicon):
    """Column function: the score of a text column."""

    @F.arrow_udf(T.DoubleType())
    def toxicity(texts: pa.Array) -> pa.Array:
        # one text at a time becomes an object, not a batch of long texts
        return pa.array((lexicon.score(t.as_py()) for t in texts), pa.float64())

    return toxicity


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Learns from ``labels(doc_id, toxic)`` outside the held-out third. Null texts score as empty ones do;
    null ids are in the training fold but have no label; repeated rows each have their row. Without labels
    all texts score low. Other columns are ignored.
    """
    score = scorer(learn(docs, labels, **options))
    held = (fold_id(F.col("doc_id")) % 3 == 1).alias("held_out")
    scored = docs.select("doc_id", held, score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents that score below the threshold; columns as they are."""
    return docs.where(scorer(learn(docs, labels, **options))(F.col("text")) < threshold)
