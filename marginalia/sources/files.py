"""File sources: formats by extension, glob excludes, extraction, incremental state, sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.documents import UDFS
from marginalia.operators.storage import persisted

#: Types by extension.
MIME = {
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "csv": "text/csv", "html": "text/html", "htm": "text/html",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "odt": "application/vnd.oasis.opendocument.text",
}
#: Extractors by extension, open to additions; each makes text of a binary column.
EXTRACTORS = {
    **{e: UDFS["decode_text"] for e in ("txt", "log", "md")},
    "csv": lambda c: UDFS["csv_text"](UDFS["decode_text"](c)),
    **{e: (lambda c: UDFS["html_structured"](UDFS["decode_text"](c))) for e in ("html", "htm")},
    "docx": UDFS["docx_text"],
    "odt": UDFS["odt_text"],
    "pdf": UDFS["pdf_text"],
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def mime_type(path: Column) -> Column:
    ext, out = extension(path), F.when(F.lit(False), "")
    for e, kind in MIME.items():
        out = out.when(ext == e, kind)
    return out.otherwise("application/octet-stream")


def expanded_globs(patterns: list[str]) -> list[str]:
    """Patterns of an ignore file: ``#`` lines go; one without a slash holds at any depth, and below if it has no wildcard."""
    out = []
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        out.append(p)
        if "/" not in p.rstrip("/"):
            bare = p.rstrip("/")
            out.append(f"**/{bare}")
            if not re.search(r"[*?\[]", bare):
                out += [f"{bare}/**", f"**/{bare}/**"]
    return list(dict.fromkeys(out))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression of the whole path; ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*"
            while pattern[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path, with or without a slash at its end, matches a pattern."""
    rules = [glob_regex(p) for p in expanded_globs(patterns)]
    if not rules:
        return F.lit(False)
    every = "|".join(f"(?:{r})" for r in rules)
    return path.rlike(every) | F.concat(path, F.lit("/")).rlike(every)


def overlaps(a: Column, b: Column) -> Column:
    """Whether paths are equal or one is above the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def under_enabled(rows: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """Rows whose path is one of the enabled ones or below one."""
    tests = [(F.col(column) == p.rstrip("/")) | F.col(column).startswith(p.rstrip("/") + "/") for p in paths]
    keep = F.lit(False)
    for t in tests:
        keep = keep | t
    return rows.where(keep)


def changed(now: DataFrame, state: DataFrame, key: str, stamp: str = "mtime") -> DataFrame:
    """Rows that are new or whose stamp is another than the stored one."""
    old = state.select(key, F.col(stamp).alias("_old"))
    return now.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col(stamp))).drop("_old")


def listing(spark: SparkSession, folder: str, excludes: list[str] | None = None) -> DataFrame:
    """``path, relative, mime, mtime, length`` of the files below a folder that have a known type and match no exclude; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    root = re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/")) if ":" in folder else folder.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(root)}/", "")
    rows = files.select("path", relative.alias("relative"), mime_type(F.col("path")).alias("mime"), F.unix_seconds("modificationTime").alias("mtime"), "length")
    rows = rows.where(extension(F.col("path")).isin(list(MIME)))
    return rows.where(~excluded(F.col("relative"), excludes)) if excludes else rows


#: Bytes of files that a task holds at once, fewest folders or files that it gets where all cores have some, most bytes of those, and tasks for each core that as many files of any size have.
HELD, DEALT, SHARE, TURNS = 16 << 20, 64, 128 << 20, 4


def tasks_for(n: int, size: int, cores: int, fewest: int | None = None) -> int:
    """Tasks for ``n`` folders or files: at least ``fewest`` to each, some for each core, and more of them only where these would read more than ``SHARE`` bytes each.

    What each of them writes is a file that is read again, so their number must not grow with that of small files.
    """
    return max(1, min(-(-n // (fewest or DEALT)), max(TURNS * cores, -(-size // SHARE))))


def _dealt(rows: DataFrame, fewest: int | None = None) -> DataFrame:
    """Rows dealt to tasks, for work that waits on a store; ``length``, if there, tells their bytes."""
    size = F.coalesce(F.sum("length"), F.lit(0)) if "length" in rows.columns else F.lit(0)
    n, held = rows.agg(F.count("*"), size).first()
    return rows.repartition(tasks_for(n, held, rows.sparkSession.sparkContext.defaultParallelism, fewest))


def walk(spark: SparkSession, folder: str, excludes: list[str] | None = None) -> DataFrame:
    """``path, relative, mime, mtime, length`` of the files below a folder that have a known type and match no exclude.

    Tasks list the folders of a level, and what they find is written; folders that match an exclude are not
    entered. So there are as many rounds as levels, and no path passes through the driver. The folder is a URI that pyarrow can
    read, or a local path.
    """
    base = folder.rstrip("/")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for relative in batch.column("relative").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{root}/{relative}".rstrip("/")))
                names = [f"{relative}/{x.base_name}".lstrip("/") for x in found]
                times = [int(x.mtime_ns // 1_000_000_000) if x.mtime_ns is not None else None for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_()), pa.array(times, pa.int64()), pa.array([x.size for x in found], pa.int64())], ["relative", "folder", "mtime", "length"])

    schema = "relative string, folder boolean, mtime long, length long"
    level, files = spark.createDataFrame([("",)], "relative string"), []
    while True:
        # a folder may hold any number of files
        entries = _dealt(level, 1).mapInArrow(listed, schema)
        here = persisted(entries.where(~excluded(F.col("relative"), excludes)) if excludes else entries, "listed")
        files.append(here.where("NOT folder"))
        level = here.where("folder").select("relative")
        if level.isEmpty():
            break
    every = files[0]
    for more in files[1:]:
        every = every.unionByName(more)
    path = F.concat(F.lit(f"{base}/"), "relative")
    return every.where(extension(F.col("relative")).isin(list(MIME))).select(path.alias("path"), "relative", mime_type(F.col("relative")).alias("mime"), "mtime", "length")


def contents(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with ``content``, read by tasks; null for one that is gone by now or cannot be read. A batch holds ``HELD`` bytes or one file."""
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def bytes_of(path: str) -> bytes | None:
            try:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    return stream.read()
            except OSError:
                return None

        for batch in batches:
            start, found, held = 0, [], 0
            for path in batch.column("path").to_pylist():
                found.append(bytes_of(path))
                held += len(found[-1] or b"")
                if held >= HELD or start + len(found) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(found)).columns, pa.array(found, pa.binary())], [*batch.schema.names, "content"])
                    start, found, held = start + len(found), [], 0

    return _dealt(files).mapInArrow(read, schema)


def scan(spark: SparkSession, folder: str, excludes: list[str] | None = None) -> DataFrame:
    """The files that a walk finds with their contents; those that are excluded or of other types are not opened."""
    return contents(walk(spark, folder, excludes))


def extracted(files: DataFrame) -> DataFrame:
    """``path, mime, mtime, content`` as text by format; content that could not be read, or has no text (a picture of text, a damaged file), has ``error``."""
    ext, text = extension(F.col("path")), F.when(F.lit(False), "")
    for e, make in EXTRACTORS.items():
        # a Python function runs for all rows wherever it stands, so others' contents are kept from it
        text = text.when(ext == e, make(F.when(ext == e, F.col("content"))))
    known = ext.isin(list(EXTRACTORS))
    rows = files.withColumn("text", text)
    error = F.when(~known, F.lit("unsupported format")).when(F.col("content").isNull(), F.lit("not readable")).when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("no text"))
    return rows.select("path", "mime", "mtime", F.col("text").alias("content"), error.alias("error"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, href`` of an Atom catalogue's entries without pictures."""
    rows = spark.read.format("xml").option("rowTag", "entry").option("attributePrefix", "_").schema("id string, title string, flavour string, link array<struct<_rel:string,_href:string>>").load(path)
    link = F.filter("link", lambda x: x["_rel"].startswith("http://opds-spec.org/acquisition"))
    return rows.where("flavour = 'nopic'").select(F.regexp_replace("id", "^urn:uuid:", "").alias("id"), "title", F.regexp_replace(F.get(link, F.lit(0))["_href"], r"\.meta4$", "").alias("href"))


def salvaged(rows: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all tests, and the others with ``fault``: the first test that failed. One bad row does not keep a batch back."""
    fault = F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()])
    marked = rows.withColumn("fault", fault)
    return marked.where("fault IS NULL").drop("fault"), marked.where("fault IS NOT NULL")


def cases(text: Column) -> Column:
    """The cases of a fixture ``{version, cases: [{id, title, body, ...}]}``; malformed: none."""
    found = F.from_json(text, "version int, cases array<struct<id:string,title:string,fts_query:string,semantic_query:string,body:string>>")
    return F.coalesce(found["cases"], F.array().cast("array<struct<id:string,title:string,fts_query:string,semantic_query:string,body:string>>"))


def write_csv(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").option("header", True).csv(path)


def write_json(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)


def write_tree(notes: DataFrame, folder: str) -> int:
    """Write ``notes(path, content)`` as files below a URI that pyarrow can write; their number."""

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        n = 0
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                store.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write((content or "").encode())
                n += 1
        import pandas as pd

        yield pd.DataFrame({"n": [n]})

    return notes.select("path", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def remove(files: DataFrame) -> int:
    """Delete the files of ``files(path)``, by tasks; those that are gone already are no error. Returns how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        n = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                try:
                    store.delete_file(at)
                    n += 1
                except FileNotFoundError:
                    pass
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select("path").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
