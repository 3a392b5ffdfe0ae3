"""Language of words in code-switched text by a linear-chain conditional random field.

A word's features are its character n-grams with its two ends marked (those at an end are its affixes) and
the word itself (the lexicon), hashed into one table of weights for each language. Transitions between the
languages of neighbouring words are learnt with them. Forward-backward gives each word's probabilities; a
document's language is the one with the largest mean over its words. All of it runs on arrays: the features of
a lot's distinct words at once, and the chains of many texts side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_id

#: Letters, with the marks that follow them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_START, _END = "\x02", "\x03"
#: Sizes of the hashed n-grams; weights in the table of one language.
_GRAMS, BITS = (2, 3, 4), 18
#: Rows of a language that the model is fitted on (by a hash of id and text, so about that many), words in a
#: row, from a random place, that are taken of each, and words of a fitted chain.
SAMPLE, SAMPLE_WORDS, CHAIN = 600, 60, 64
#: Words of a block of a longer chain, blocks and characters of texts that are worked on together.
_BLOCK, _TOGETHER, _LOT = 256, 2048, 3 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in small letters."""
    return _WORD.findall(text.lower()) if text else []


def _slots(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes + np.uint64(salt)) * _MULTIPLY
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MULTIPLY) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' features and the number of the word that each belongs to, by word."""
    text = _START + (_END + _START).join(words) + _END
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(codes == ord(_START)) - 1
    first = np.flatnonzero(codes == ord(_START))
    slots, owner = [], []
    with np.errstate(over="ignore"):
        for n in _GRAMS:
            size = len(codes) - n + 1
            if size <= 0:
                continue
            rolled = codes[:size].copy()
            for k in range(1, n):
                rolled = rolled * np.uint64(1_000_003) + codes[k : size + k]
            inside = word[:size] == word[n - 1 :]
            slots.append(_slots(rolled[inside], n))
            owner.append(word[:size][inside])
        place = np.minimum(np.arange(len(codes)) - first[word], 63)
        powers = np.cumprod(np.full(64, 1_000_003, np.uint64))
        slots.append(_slots(np.add.reduceat(codes * powers[place], first), 99))
        owner.append(np.arange(len(words)))
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], owner[order]


@dataclass
class Chain:
    """Languages, feature weights (slots x languages), transition weights and those of a chain's first word."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each language for each word (words x languages)."""
        if not words:
            return np.zeros((0, len(self.langs)))
        slots, owner = features(words)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return np.add.reduceat(self.weights[slots], starts, axis=0).astype(np.float64)

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, moved: bool = False, first: np.ndarray | None = None, last: np.ndarray | None = None):
        """Forward-backward on padded chains (chains x words x languages): each word's probabilities.

        With ``moved`` also the log of the normaliser and the expected numbers of moves, for fitting. ``first`` and
        ``last`` (chains x languages) are what comes to each chain's first and last word from without.
        """
        n, longest, k = scores.shape
        shift = scores.max(2, keepdims=True)
        local, moves = np.exp(scores - shift), np.exp(self.moves)
        forward = np.empty((longest, n, k))
        scale = np.ones((longest, n))
        now = (np.exp(self.start - self.start.max()) if first is None else first) * local[:, 0]
        for t in range(longest):
            if t:
                now = (now @ moves) * local[:, t]
            scale[t] = now.sum(1)
            now = forward[t] = now / scale[t][:, None]
        ending = np.ones((n, k)) if last is None else last
        backward = ending
        out = np.empty((n, longest, k))
        counts = np.zeros((k, k))
        for t in range(longest - 1, -1, -1):
            # where a chain has ended, what comes back is what comes from without
            inner = t < lengths - 1
            if t < longest - 1:
                ahead = local[:, t + 1] * backward / scale[t + 1][:, None]
                if moved:
                    pair = forward[t][:, :, None] * moves * ahead[:, None, :]
                    counts += pair[inner].sum(0)
                backward = np.where(inner[:, None], ahead @ moves.T, ending)
            joint = forward[t] * backward
            out[:, t] = joint / joint.sum(1, keepdims=True)
        if not moved:
            return out
        used = np.arange(longest)[None] < lengths[:, None]
        total = ((np.log(scale.T) + shift[:, :, 0]) * used).sum() + n * self.start.max()
        return out, total, counts

    def steps(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All steps of each block (blocks x words x languages) as one matrix: what comes to its first word to what leaves its last."""
        blocks, longest, k = scores.shape
        local, moves = np.exp(scores - scores.max(2, keepdims=True)), np.exp(self.moves)
        whole = np.tile(np.eye(k), (blocks, 1, 1))
        for t in range(longest):
            now = ((whole.reshape(-1, k) @ moves).reshape(blocks, k, k) if t else whole) * local[:, t, None, :]
            now /= now.sum((1, 2), keepdims=True)
            inside = lengths > t
            whole = now if inside.all() else np.where(inside[:, None, None], now, whole)
        return whole

    def borders(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What comes to the first and to the last word of each block of one chain, of its blocks' matrices."""
        moves = np.exp(self.moves)
        first, last = np.ones(whole.shape[:2]), np.ones(whole.shape[:2])
        first[0] = np.exp(self.start - self.start.max())
        for b in range(1, len(whole)):
            first[b] = first[b - 1] @ whole[b - 1] @ moves
            first[b] /= first[b].sum()
        for b in range(len(whole) - 2, -1, -1):
            last[b] = moves @ whole[b + 1] @ last[b + 1]
            last[b] /= last[b].sum()
        return first, last


def fit(chains: list[tuple[list[str], list[int]]], langs: list[str], rounds: int = 6, rate: float = 0.3, decay: float = 1e-6) -> Chain:
    """Weights by AdaGrad on the log likelihood of labelled chains, in a fixed order."""
    k = len(langs)
    model = Chain(langs, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    past = [np.full(x.shape, 1e-8, x.dtype) for x in (model.weights, model.moves, model.start)]
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        order = rng.permutation(len(chains))
        for at in range(0, len(chains), 64):
            lot = [chains[i] for i in order[at : at + 64]]
            lengths = np.array([len(w) for w, _ in lot])
            flat = [w for ws, _ in lot for w in ws]
            kinds = list(dict.fromkeys(flat))
            number = {w: i for i, w in enumerate(kinds)}
            slots, owner = features(kinds)
            used = np.arange(lengths.max())[None] < lengths[:, None]
            scores = np.zeros((*used.shape, k))
            which = np.array([number[w] for w in flat])
            scores[used] = model.emissions(kinds)[which]
            found, _, counts = model.marginals(scores, lengths, moved=True)
            truth = np.zeros_like(scores)
            truth[used] = np.eye(k)[[y for _, ys in lot for y in ys]]
            for _, ys in lot:
                np.add.at(counts, (ys[:-1], ys[1:]), -1.0)
            surplus = np.zeros((len(kinds), k))
            np.add.at(surplus, which, (found - truth)[used])
            touched, back = np.unique(slots, return_inverse=True)
            slope = np.stack([np.bincount(back, surplus[owner, j], len(touched)) for j in range(k)], 1) / len(lot) + decay * model.weights[touched]
            steps = ((model.weights, touched, slope), (model.moves, slice(None), counts / len(lot)), (model.start, slice(None), (found - truth)[:, 0].mean(0)))
            for (weights, where, g), seen in zip(steps, past, strict=True):
                seen[where] += g**2
                weights[where] -= rate * g / np.sqrt(seen[where])
    return model


def learn(docs: DataFrame, sample: int = SAMPLE, folds: int = 5) -> Chain | None:
    """The model, fitted on about ``sample`` training rows of each language, and on ``SAMPLE_WORDS`` words of each.

    Training rows have a language, a text, and an id whose CRC-32 leaves a remainder by 5 other than 0. They are
    drawn by a hash of id and text, whatever their length, the words from a random place in the whole text; twice
    as many rows as asked for at most, in the order of another hash. The words are joined into chains of one
    language and of several, so that the transitions see changes of language. Without training rows there is no model.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_id(F.col("doc_id")) % folds != 0))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, sample / sizes[lang])]), F.col("lang"))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 30)) / (1 << 30)
    place = F.xxhash64("doc_id", "text", F.lit(11))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, at in zip(batch.column(2), batch.column(0).to_pylist(), strict=True):
                words = words_of(text.as_py())
                first = at % max(1, len(words) - SAMPLE_WORDS + 1)
                found.append(words[first : first + SAMPLE_WORDS])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["place", "lang", "words"])

    drawn = known.where(unit < share).select(place.alias("place"), "lang", "text").mapInArrow(cut, "place long, lang string, words array<string>")
    rows = drawn.orderBy("place", "lang", "words").limit(2 * sample * len(langs)).collect()
    rng, pieces = np.random.default_rng(1), [(r.words, langs.index(r.lang)) for r in rows if r.words]
    chains = [(w, [y] * len(w)) for w, y in pieces]
    for _ in range(len(pieces) // 2):
        words, ys = [], []
        while len(words) < CHAIN:
            own, y = pieces[int(rng.integers(len(pieces)))]
            n = int(rng.integers(4, 25))
            at = int(rng.integers(0, max(1, len(own) - n + 1)))
            words += own[at : at + n]
            ys += [y] * len(own[at : at + n])
        chains.append((words, ys))
    return fit(chains, langs)


def label_words(model: Chain, texts: list[list[str]]) -> list[np.ndarray]:
    """For each list of words their probabilities by language (words x languages), each list being one chain."""
    kinds = list(set().union(*texts))
    number = {w: i for i, w in enumerate(kinds)}
    scores = model.emissions(kinds)
    out = [np.zeros((len(t), len(model.langs))) for t in texts]
    numbers = [np.fromiter((number[w] for w in t), np.int64, len(t)) for t in texts]
    # what comes to a block from without; a text of one block has only its start
    start, ones = np.exp(model.start - model.start.max()), np.ones(len(model.langs))
    within: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    long = [i for i, own in enumerate(numbers) if len(own) > _BLOCK]
    blocks = [numbers[i][at : at + _BLOCK] for i in long for at in range(0, len(numbers[i]), _BLOCK)]
    steps = []
    for at in range(0, len(blocks), _TOGETHER):
        part = blocks[at : at + _TOGETHER]
        lengths = np.array([len(b) for b in part])
        steps.append(model.steps(scores[np.stack([np.pad(b, (0, _BLOCK - len(b))) for b in part])], lengths))
    steps, done = np.concatenate(steps) if steps else None, 0
    for i in long:
        own = -(-len(numbers[i]) // _BLOCK)
        for b, pair in enumerate(zip(*model.borders(steps[done : done + own]), strict=True)):
            within[i, b * _BLOCK] = pair
        done += own
    cut = sorted(((min(_BLOCK, len(t) - at), i, at) for i, t in enumerate(texts) for at in range(0, len(t), _BLOCK)), reverse=True)
    first = 0
    while first < len(cut):
        # blocks of about the same length side by side
        longest = cut[first][0]
        last = first
        while last < len(cut) and last - first < 4096 and cut[last][0] * 4 >= longest * 3:
            last += 1
        part = cut[first:last]
        lengths = np.array([n for n, _, _ in part])
        which = np.zeros((len(part), longest), np.int64)
        for row, (n, i, at) in zip(which, part, strict=True):
            row[:n] = numbers[i][at : at + n]
        before, after = (np.stack(x) for x in zip(*(within.get((i, at), (start, ones)) for _, i, at in part), strict=True))
        found = model.marginals(scores[which], lengths, first=before, last=after)
        for got, (n, i, at) in zip(found, part, strict=True):
            out[i][at : at + n] = got[:n]
        first = last
    return out


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    ``score`` is the mean probability of the predicted language over the words; a text that is null or has no
    letter is ``und`` with score 0, as all are when there was nothing to learn from. Ties go to the language
    that sorts first. All words of a text count, in one chain, however long it is. Null ids
    are held out as empty text is; repeated rows each have their row; other columns are ignored.
    """
    model = learn(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            langs, scores = [], []
            for lot in _lots(frame["text"].tolist()):
                words = [words_of(t) for t in lot]
                for found in label_words(shared.value, words) if shared.value else [np.zeros((0, 1))] * len(words):
                    mean = found.mean(0) if len(found) else None
                    best = int(mean.argmax()) if mean is not None else -1
                    langs.append("und" if best < 0 else shared.value.langs[best])
                    scores.append(0.0 if best < 0 else min(1.0, float(mean[best])))
            yield frame[["doc_id", "held_out"]].assign(lang_pred=langs, score=scores)

    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string"), (fold_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def _lots(texts: list[str | None]) -> Iterator[list[str | None]]:
    lot, held = [], 0
    for text in texts:
        if lot and held + len(text or "") > _LOT:
            yield lot
            lot, held = [], 0
        lot.append(text)
        held += len(text or "")
    if lot:
        yield lot
