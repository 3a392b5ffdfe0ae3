"""From notes to chunks to vectors, in batches that can be repeated and resumed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as tx
from marginalia.sources import files as fi

from . import knowledge as kn
from .articles import article_chunks, articles
from .jobs import Job
from .storage import KeyedTable, persisted

#: Dimensions, characters that are embedded, and most texts of a request, of the two model families.
DIMS, LARGE_DIMS = 768, 1024
#: Bounds of memory in MB and cores that part machines into tiers.
_LOW_RAM, _HIGH_RAM, _SOME_GPU, _STRONG_GPU, _STRONG_SHARED, _CORES = 8192, 16384, 6144, 10240, 20480, 6
#: Texts in a request, entries in a scan window, most texts when requests grow, by tier.
PLANS = {"low": (16, 256, 32), "mid": (64, 1024, 128), "high": (96, 1536, 192)}
#: Texts that an embedder gets at once.
PIECE = 512
Embedder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


@dataclass(frozen=True)
class Model:
    """What a model takes and gives: dimensions, characters of a text, and texts of a request at most."""

    dims: int
    chars: int
    cap: int


#: The family that a part of the name tells, and all other models.
MODELS = {"mxbai": Model(LARGE_DIMS, 350, 48)}
OTHER_MODEL = Model(DIMS, 1500, 128)


def model_of(name: str, plan: str | None = None) -> Model:
    """The limits of a model; on a machine of a tier (``plan``) requests are no larger than the tier's."""
    found = next((m for part, m in MODELS.items() if part in name), OTHER_MODEL)
    return found if plan is None else replace(found, cap=min(found.cap, PLANS[plan][2]))


def embedded_by(rows: DataFrame, column: str, request: Callable[[list[str]], list[list[float]]], name: str, plan: str = "mid") -> DataFrame:
    """:func:`embedded_or_faulty` within a model's limits: texts are cut to its characters, and requests begin with the tier's size."""
    model = model_of(name, plan)
    cut = rows.withColumn(column, F.substring(column, 1, model.chars))
    return embedded_or_faulty(cut, column, request, min(PLANS[plan][0], model.cap), model.cap, model.dims)


def tier(ram_mb: int, cores: int, gpus: list[tuple[int, bool]] = (), capability: str = "full") -> str:
    """``low``, ``mid`` or ``high`` of a machine; ``gpus`` are memory in MB and whether it is shared with the processor."""
    best = max((mb for mb, _ in gpus), default=0)
    strong = any(mb >= (_STRONG_SHARED if shared else _STRONG_GPU) for mb, shared in gpus)
    if capability == "insufficient" or ram_mb < _LOW_RAM or (ram_mb < _HIGH_RAM and (capability == "embedding" or best < _SOME_GPU)):
        return "low"
    return "high" if ram_mb >= _HIGH_RAM and cores >= _CORES and strong else "mid"


#: Texts by which a request grows, and the fewest after it shrank.
GROWTH, FEWEST = 8, 8


def next_batch(size: int, split: bool, base: int, most: int) -> int:
    """Texts of the next request: half as many after one had to be split, else some more, up to ``base`` and then up to ``most``."""
    if split:
        return max(FEWEST, size // 2)
    return min(size + GROWTH, base if size < base else most)


def embedded_or_faulty(rows: DataFrame, column: str, request: Callable[[list[str]], list[list[float]]], base: int = PLANS["low"][0], most: int = PLANS["low"][2], dims: int | None = None) -> DataFrame:
    """``rows`` with ``vector`` and ``fault``: one of the two is null.

    A task sends its texts in requests whose size follows :func:`next_batch` over all its batches. A request that fails, or
    brings another number of vectors than texts, is halved until what fails is single texts; these have their fault, and all
    others their vector. Of ``n`` texts of which ``f`` fail there are at most ``2 f log2(n)`` requests more than without faults. With
    ``dims`` a vector of another dimension is a fault as well.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("fault", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = base
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            vectors, faults, at = [None] * len(texts), [None] * len(texts), 0
            while at < len(texts):
                open_, split = [(at, min(at + size, len(texts)))], False
                at = open_[0][1]
                while open_:
                    start, end = open_.pop()
                    try:
                        made = request(texts[start:end])
                        if len(made) != end - start:
                            raise ValueError(f"{len(made)} vectors for {end - start} texts")
                    except Exception as e:
                        if end - start == 1:
                            faults[start] = f"{type(e).__name__}: {e}"[:200]
                        else:
                            split, middle = True, (start + end) // 2
                            open_ += [(middle, end), (start, middle)]
                        continue
                    for place, v in enumerate(made, start):
                        if v is None or (dims is not None and len(v) != dims):
                            faults[place] = "no vector" if v is None else f"{len(v)} dimensions"
                        else:
                            vectors[place] = [float(x) for x in v]
                size = next_batch(size, split, base, most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(faults, pa.string())], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def salvaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that have a vector, and the others with their fault, both from one written pass."""
    kept = persisted(rows, "salvaged")
    return kept.where("fault IS NULL").drop("fault"), kept.where("fault IS NOT NULL").drop("vector")


#: Words whose place a task of the hashing embedder keeps at once.
_WORDS = 200_000


class _Places(dict):
    """Of each word its place in a vector, behind all places if it counts negative; no more words than :data:`_WORDS`."""

    def __init__(self, dims: int) -> None:
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        self[word] = place = h % self.dims + (0 if h >> 63 else self.dims)
        return place


def hashing_embedder(dims: int = DIMS) -> Embedder:
    """A model-free embedder for tests: hashed words, at unit length."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = _Places(dims)
        for texts in batches:
            out = []
            for t in texts:
                v, found = [0.0] * dims, [*map(places.__getitem__, (t or "").lower().split())]
                for k in found:
                    v[k % dims] += -1 if k >= dims else 1
                length = sqrt(sum(v[k] * v[k] for k in {k % dims for k in found})) or 1
                out.append([x / length for x in v])
            yield pd.Series(out)

    return embed


def embedded(rows: DataFrame, column: str, embedder: Embedder | None = None) -> DataFrame:
    """``rows`` with ``vector``; the embedder gets batches of texts, so it loads its model once for a task."""
    run = embedder or hashing_embedder()

    @F.pandas_udf("array<float>")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # vectors are much larger than their texts, so a few of them are made at once
        yield from run(part.iloc[i : i + PIECE] for part in texts for i in range(0, len(part), PIECE))

    return rows.withColumn("vector", vector(F.col(column)))


def note_chunks(notes: DataFrame, suffix: DataFrame | None = None, per: int = 1, overlap: int = 0) -> DataFrame:
    """``note_id, chunk_index, title, content, text``: a row per sentence that is not blank; ``text`` is what is embedded."""
    full = F.col("content")
    if suffix is not None:
        notes = notes.join(suffix, "note_id", "left")
        full = F.concat(F.col("content"), F.coalesce("suffix", F.lit("")))
    # a column of its own, so that the sentences are cut once and not for each chunk
    cut = notes.select("note_id", "title", tx.sentences(full).alias("_sentences"))
    whole = F.when(F.size("_sentences") > 0, F.col("_sentences")).otherwise(F.array(F.lit("")))
    parts = whole if max(1, per) == 1 and overlap == 0 else tx.chunks(F.col("_sentences"), per, overlap)
    rows = cut.select("note_id", "title", F.posexplode(parts).alias("chunk_index", "content")).where(F.trim("content") != "")
    return rows.withColumn("text", F.concat(F.lit("search_document: "), F.col("title"), F.lit("\n"), F.col("content")))


def reindexed(index: DataFrame, changed: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The vector index after notes changed: all rows of a note are replaced, so doing it twice changes nothing."""
    new = embedded(note_chunks(changed), "text", embedder).select(index.columns)
    return kn.without_keys(index, changed.select("note_id"), ["note_id"]).unionByName(new)


def store_vectors(table: KeyedTable, rows: DataFrame, number: int, dims: int, keys: DataFrame | None = None, stream: str = "", merge: bool = True) -> None:
    """Vectors in place of those of their keys; none is stored if one has another dimension. They are written where they are made, once, and not shuffled."""
    table.upsert(rows, number, keys, stream, merge, ranged=False, tests={f"a vector has other than {dims} dimensions": F.size("vector") == dims})


#: What is stored of a note's chunk.
CHUNK = ["note_id", "chunk_index", "title", "content", "vector"]


def index_notes(table: KeyedTable, changed: DataFrame, number: int, embedder: Embedder | None = None, dims: int = DIMS, suffix: DataFrame | None = None, stream: str = "notes", merge: bool = True) -> None:
    """Chunks and vectors of the changed notes in place of what the table has of them; blank notes have none."""
    store_vectors(table, embedded(note_chunks(changed, suffix), "text", embedder).select(CHUNK), number, dims, changed.select("note_id"), stream, merge)


def _batches(table: KeyedTable, rows: DataFrame, key: str, stream: str, batches: int):
    """Number and rows of the batches of a job that are not part of the table yet. The job is known by its ids and the number of its batches."""
    n, mix = rows.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(key)), F.lit(0))).first()
    name = f"{stream}-{n}-{mix & (1 << 63) - 1:x}-{batches}"
    part = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(batches))
    for number in range(table.done(name) + 1, batches):
        yield name, number, rows.where(part == number)


def reindex_all(table: KeyedTable, notes: DataFrame, model: str, embedder: Embedder | None = None, dims: int = DIMS, batches: int = 16, job: Job | None = None) -> int:
    """All notes anew, in batches; the number of batches done now.

    A job that was stopped goes on after its last batch, as long as the model, the notes' ids and the batches are the same;
    else it begins anew. In the end the chunks of notes that are gone are removed: as the batches hold all notes, and each once, older segments
    go as a whole; only where other changes came between are they looked for. ``job`` is told of each batch and may end
    the run before the next one.
    """
    done, name = 0, None
    for name, number, part in _batches(table, notes, "note_id", f"reindex-{model}", batches):
        if job:
            job.report(number, batches)
        index_notes(table, part, number, embedder, dims, stream=name, merge=False)
        done += 1
    stored = table.read()
    if name and stored is not None and not table.settle(name, batches, batches):
        gone = kn.stale(stored.select("note_id").distinct(), notes, "note_id")
        table.upsert(stored.limit(0).select(CHUNK), batches, gone, name)
    return done


def index_articles(table: KeyedTable, pages: DataFrame, bundle: str, embedder: Embedder | None = None, dims: int = LARGE_DIMS, batches: int = 16) -> int:
    """The articles of a bundle's ``pages(page_id, url, html)`` with a vector for each piece, keyed by path, in batches that can be resumed."""
    done = 0
    for name, number, part in _batches(table, pages, "page_id", f"articles-{bundle}", batches):
        rows = embedded(article_chunks(articles(part)), "text", embedder or hashing_embedder(dims))
        stored = rows.select(F.lit(bundle).alias("bundle_id"), "path", "chunk_index", "title", "content", "vector")
        store_vectors(table, stored, number, dims, stream=name)
        done += 1
    return done


def index_folder(spark: SparkSession, folder: str, state: KeyedTable, chunks: KeyedTable, run: int, excludes: list[str] | None = None, embedder: Embedder | None = None, dims: int = DIMS) -> dict[str, int]:
    """Files below a folder: those that are new or changed are read, extracted, chunked and stored; rows of files that are gone are removed.

    ``state(path, mtime, length, error)`` and ``chunks(path, chunk_index, content, vector)`` are keyed by path; runs
    are numbered within the folder. Tasks list folders, compare them with what is known of this folder, and read the contents
    of new and changed files; no path passes through the driver. A run that is part of the state already does nothing; one that
    failed half way is done again with the files as they are then. Returns how many were indexed, failed, unchanged and removed.
    """
    if run <= state.done(folder):
        return dict.fromkeys(("indexed", "failed", "unchanged", "removed"), 0)
    now = persisted(fi.walk(spark, folder, excludes), "files")
    inside = F.col("path").startswith(f"{folder.rstrip('/')}/")
    before = state.read()
    before = now.select("path", "mtime", "length", F.lit(None).cast("string").alias("error")).limit(0) if before is None else before.where(inside)
    todo = persisted(fi.changed(now, before, "path"), "changed")
    gone = persisted(kn.stale(before, now, "path").select("path"), "gone")
    keys = todo.select("path").unionByName(gone)
    texts = persisted(fi.extracted(fi.contents(todo)), "texts")
    parts = texts.where("error IS NULL").select("path", F.posexplode(tx.chunks(tx.sentences(F.col("content")))).alias("chunk_index", "content")).where(F.trim("content") != "")
    store_vectors(chunks, embedded(parts, "content", embedder).select("path", "chunk_index", "content", "vector"), chunks.done(folder) + 1, dims, keys, folder)
    # the state last: a run that failed before it finds the same files changed
    state.upsert(todo.join(texts.select("path", "error"), "path", "left").select("path", "mtime", "length", "error"), run, keys, folder)
    counts = texts.agg(F.count_if(F.col("error").isNull()), F.count("error")).first()
    return {"indexed": counts[0], "failed": counts[1], "unchanged": now.count() - counts[0] - counts[1], "removed": gone.count()}


def can_resume(stored_model: str, model: str, total: int, next_pos: int, queue: DataFrame, expected: DataFrame) -> bool:
    """Whether a stored cursor still holds: same model, unfinished, and the same ids in the same order."""
    if stored_model != model or not 0 < total or not 0 <= next_pos < total:
        return False
    same = kn.same_list(*(df.select("pos", F.col("note_id").alias("id")) for df in (queue, expected)))
    return same and queue.count() == total
