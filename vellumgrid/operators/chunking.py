"""Hierarchical chunks: a parent for each section and overlapping children."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.config import Settings
from vellumgrid.functions import text as T


def sections(documents: DataFrame) -> DataFrame:
    """One section a document (doc_id, text): the title is its first line, cut at
    100 characters."""
    title = F.substring(F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0)), 1, 100)
    return documents.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(title, F.lit("Untitled")).alias("title"), F.lit("s1").alias("section_id"),
        F.lit("Document Content").alias("heading"), F.lit(1).alias("level"), F.col("text"),
    )


def _fit(parts: Column, limit: int) -> Column:
    """The leading parts whose token counts sum to at most ``limit``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, part: Column) -> Column:
        n = acc["n"] + T.token_count(part)
        ok = acc["open"] & (n <= limit)
        return F.struct(F.when(ok, n).otherwise(acc["n"]).alias("n"), ok.alias("open"), F.when(ok, F.array_append(acc["kept"], part)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(parts, start, step, lambda acc: acc["kept"])


def parents(secs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A parent chunk for each section that isn't blank: whole, or its first
    whole sentences up to the parent size. A section whose first sentence is
    already longer has an empty parent and is left out here; its children stay."""
    whole = F.regexp_replace("text", r"^\s+|\s+$", "")
    fit = F.array_join(_fit(T.sentences(whole), settings.parent_size), " ")
    body = F.when(T.token_count(whole) <= settings.parent_size, whole).otherwise(fit)
    out = secs.withColumn("body", body).filter(F.col("body") != "")
    return out.select(
        F.concat("doc_id", F.lit("_"), "section_id", F.lit("_parent")).alias("chunk_id"), "doc_id", F.col("body").alias("text"), F.lit("parent").alias("chunk_type"),
        F.lit(None).cast("string").alias("parent_chunk_id"), T.breadcrumbs(F.col("title"), F.col("heading")).alias("breadcrumbs"), F.col("heading").alias("section"),
        T.token_count(F.col("body")).alias("token_count"), F.lit(None).cast("long").alias("child_index"),
    )


def pack(sentences: list[str], child: int, overlap: int) -> list[str]:
    """Children of one section. Sentences are packed while they fit; the next
    child begins with the last whole sentences that fit the overlap. A sentence
    over the limit is cut at commas, semicolons and colons, and where a piece is
    still too long, at words."""
    count = lambda s: len(s) // 4
    out: list[str] = []
    now: list[str] = []
    for sentence in sentences:
        if count(sentence) > child:
            if now:
                out.append(" ".join(now))
                now = []
            out += _cut(sentence, child)
            continue
        if now and sum(map(count, now)) + count(sentence) > child:
            out.append(" ".join(now))
            tail, used = [], 0
            while now and used + count(now[-1]) <= overlap:
                used += count(now[-1])
                tail.insert(0, now.pop())
            now = tail
        now.append(sentence)
    return [*out, " ".join(now)] if now else out


def _cut(sentence: str, limit: int) -> list[str]:
    import re

    out, now = [], ""
    for piece in re.findall(r"[^,;:]*[,;:]?", sentence):
        if len(piece) // 4 > limit:
            if now.strip():
                out.append(now.strip())
            now = ""
            for word in piece.split():
                if now and (len(now) + 1 + len(word)) // 4 > limit:
                    out.append(now)
                    now = word
                else:
                    now = f"{now} {word}" if now else word
        elif (len(now) + len(piece)) // 4 > limit and now.strip():
            out.append(now.strip())
            now = piece
        else:
            now += piece
    return [*out, now.strip()] if now.strip() else out


def children(secs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Child chunks. Packing goes sentence by sentence within a section, so it
    runs as a vectorised function over rows; no shuffle."""
    child, overlap = settings.child_size, settings.overlap

    @F.pandas_udf("array<string>")
    def packed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: pack(list(p), child, overlap))

    rows = secs.withColumn("parts", packed(T.sentences(F.regexp_replace("text", r"^\s+|\s+$", ""))))
    rows = rows.select("doc_id", "title", "section_id", "heading", F.posexplode("parts").alias("n", "body"))
    stem = F.concat("doc_id", F.lit("_"), "section_id")
    return rows.select(
        F.concat(stem, F.lit("_child_"), F.col("n").cast("string")).alias("chunk_id"), "doc_id", F.col("body").alias("text"), F.lit("child").alias("chunk_type"),
        F.concat(stem, F.lit("_parent")).alias("parent_chunk_id"), T.breadcrumbs(F.col("title"), F.col("heading")).alias("breadcrumbs"),
        F.col("heading").alias("section"), T.token_count(F.col("body")).alias("token_count"), F.col("n").cast("long").alias("child_index"),
    )


def chunks(secs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return parents(secs, settings).unionByName(children(secs, settings))
