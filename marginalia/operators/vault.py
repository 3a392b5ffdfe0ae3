"""Encryption of notes with given keys, settings, and a synthetic collection."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import KeyedTable


def one_line_base64(data: Column) -> Column:
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def encrypted(text: Column, key: Column) -> Column:
    """base64 of nonce, AES-256-GCM ciphertext and tag."""
    return one_line_base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM")))


def decrypted(blob: Column, key: Column) -> Column:
    """The text; null for another key or changed bytes."""
    return F.try_aes_decrypt(F.unbase64(blob), key, F.lit("GCM")).cast("string")


def note_text(blob: Column, key: Column) -> Column:
    """A note's text: what does not decrypt is shown as it is stored."""
    return F.coalesce(decrypted(blob, key), blob)


def reencrypted(notes: DataFrame, subtree: DataFrame, old: Column | None, new: Column | None) -> DataFrame:
    """Notes whose folder is in ``subtree(folder_id)``, from one key (or none) to another (or none)."""
    plain = note_text(F.col("content"), old) if old is not None else F.col("content")
    made = encrypted(plain, new) if new is not None else plain
    own = notes.join(subtree.select("folder_id").distinct(), "folder_id", "left_semi").withColumn("content", made)
    return own.unionByName(notes.join(subtree.select("folder_id").distinct(), "folder_id", "left_anti"))


#: Cost, block size and lanes of the key derivation, which takes 64 MB; the text that tells a right key.
_COST, _BLOCK, _LANES, _SENTINEL = 1 << 16, 8, 1, "marginalia"


def derived_key(password: str, salt: bytes) -> bytes:
    """A 256-bit key of a password, by scrypt (memory-hard; no Argon2 is at hand)."""
    return hashlib.scrypt(password.encode(), salt=salt, n=_COST, r=_BLOCK, p=_LANES, maxmem=1 << 27, dklen=32)


def sentinel(key: Column) -> Column:
    """What is stored beside the salt, to tell a right key from a wrong one."""
    return encrypted(F.lit(_SENTINEL), key)


def opens(stored: Column, key: Column) -> Column:
    """Whether a key made a sentinel."""
    return F.coalesce(decrypted(stored, key) == _SENTINEL, F.lit(False))


@dataclass(frozen=True)
class Settings:
    """Engine settings with their bounds."""

    retries: int = 2
    audit_enabled: bool = True
    log_file_access: bool = True
    date_format: str = "DMY"
    reading_wpm: int = 200

    @staticmethod
    def of(rows: DataFrame) -> Settings:
        """From ``rows(key, value)``; what is missing or cannot be read has its default."""
        got = {r.key: r.value for r in rows.where(F.col("key").isin(list(Settings.__dataclass_fields__))).collect()}
        number = lambda k, low, high, default: min(high, max(low, int(got[k]))) if str(got.get(k, "")).lstrip("-").isdigit() else default
        flag = lambda k: got.get(k, "true") != "false"
        return Settings(number("retries", 0, 10, 2), flag("audit_enabled"), flag("log_file_access"), got.get("date_format", "DMY"), number("reading_wpm", 50, 600, 200))


def stored_settings(table: KeyedTable) -> Settings:
    """The settings that a table ``(key, value)`` keyed by ``key`` holds; all defaults before the first is set."""
    rows = table.read()
    return Settings() if rows is None else Settings.of(rows)


def set_settings(table: KeyedTable, rows: DataFrame, number: int) -> Settings:
    """The settings after ``rows(key, value)`` were set as batch ``number``; unknown keys are an error and nothing is set."""
    unknown = [r.key for r in rows.where(~F.col("key").isin(list(Settings.__dataclass_fields__))).select("key").limit(5).collect()]
    if unknown:
        raise KeyError(f"unknown settings {unknown}")
    table.upsert(rows.select("key", F.col("value").cast("string").alias("value")), number, stream="settings")
    return stored_settings(table)


def synthetic_notes(spark: SparkSession, notes: int, folders: int, seed: int = 42) -> DataFrame:
    """``note_id, folder_id, style, title, content, created_at``: 40 % structured, 30 % prose, 20 % lists, 10 % journal; tags and links."""
    return synthesised(spark.range(min(500, max(10, notes))), min(500, max(10, notes)), folders, seed)


def synthesised(ids: DataFrame, notes: int, folders: int, seed: int = 42) -> DataFrame:
    """Such a note for each row of ``ids(id)``, with links to notes of numbers below ``notes``."""
    folders = min(20, max(1, folders))
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    rows = ids.withColumn("u", draw(1, 100))
    style = F.when(F.col("u") < 40, "structured").when(F.col("u") < 70, "prose").when(F.col("u") < 90, "bullet").otherwise("journal")
    word = lambda k: F.element_at(F.array(*map(F.lit, ("amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "heron"))), (draw(k, 8) + 1).cast("int"))
    body = F.concat_ws(" ", *[word(k) for k in range(10, 30)])
    links = F.concat(F.lit("\n[[Note "), draw(5, notes), F.lit("]]"))
    tags = F.concat(F.lit("\n#"), word(6), F.lit(" #"), word(7))
    return rows.select(F.col("id").alias("note_id"), (F.col("id") % folders).alias("folder_id"), style.alias("style"), F.concat(F.lit("Note "), F.col("id")).alias("title"), F.concat(body, links, tags).alias("content"), (F.lit(1_704_067_200) + draw(8, 31_536_000)).alias("created_at"))
