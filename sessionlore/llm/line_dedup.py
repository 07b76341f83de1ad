"""Removal of lines that many documents share, in DataFrame operations only.

A line goes through the shuffle as 128 bits of hash with its document and position, never as text. The hashes are
range-partitioned together with the document, so that a very common line is spread over several ranges, and
sorted by document and position within a range; first occurrences per document are streamed from that order. What
comes back for each document is a sparse bitmap: 64 lines to a word, only words in which a line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.linking import join_split
from sessionlore.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """Lines of a text; one empty line where it is null or empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_BLANKS)), UPPER, LOWER)


def drop_bitmaps(docs: DataFrame, *, least_length: int = 20, least_documents: int = 3) -> DataFrame:
    """Sparse bitmaps of the lines that go: ``doc_id``, ``text_hash``, ``words`` (map of line div 64 to 64 bits).

    Lines whose key has ``least_length`` code points or more and occurs in ``least_documents`` documents or
    more go from all of them but the one with the largest ``doc_id``. Rows without ``doc_id`` neither count
    nor lose lines; rows that share a ``doc_id`` count as one document. Documents that lose nothing are absent.
    """
    split = docs.where("doc_id IS NOT NULL").select(  # below the explode, so that the text is hashed once and left there
        "doc_id", F.xxhash64("text").alias("text_hash"), lines(F.col("text")).alias("lines"))
    each = (split.select("doc_id", "text_hash", F.posexplode("lines"))
            .select("doc_id", "text_hash", "pos", line_key(F.col("col")).alias("key"))
            .where(F.length("key") >= least_length))
    hashed = materialize(each.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id",
                                     "text_hash", "pos"))  # ranges are drawn from it, then it is read twice
    ordered = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    first = ordered.groupBy("h1", "h2", "doc_id").agg(F.min("pos").alias("pos"))  # in the order of the range
    shared = (first.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper"))
              .where(F.col("documents") >= least_documents).select("h1", "h2", "keeper"))
    gone = join_split(ordered, shared, "h1", "h2").where("doc_id < keeper")
    word = (gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")))
    return word.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def mark_lines(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with ``all_lines``, ``kept_lines`` (arrays) and ``drop_words`` (the bitmap; null where nothing goes).

    Lines without the line end; kept ones in their order. Texts are shuffled once, to meet their bitmaps. For
    null and repeated rows see ``drop_bitmaps``; an empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").alias("doc_id"), F.col(text).alias("text"))
    maps = drop_bitmaps(rows.select("doc_id", "text"), **options)
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(maps, ["doc_id", "text_hash"], "left").withColumn("all_lines", lines(F.col("text")))

    def kept(_, i):
        bits = F.coalesce(F.try_element_at("words", F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) == 0

    return rows.select("row", "all_lines", F.when(F.col("words").isNull(), F.col("all_lines")).otherwise(
        F.filter("all_lines", kept)).alias("kept_lines"), F.col("words").alias("drop_words"))


def dedup_lines(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text`` (null stays null) and ``n_chars``, if there, adjusted."""
    marked = mark_lines(docs, text=text, **options)
    body = F.when(F.col("drop_words").isNull(), F.col(f"row.{text}")).otherwise(F.array_join("kept_lines", "\n"))
    out = marked.withColumn("body", body)
    columns = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == text:
            own = F.col("body")
        elif c == "n_chars":
            own = F.when(F.col("drop_words").isNull(), own).otherwise(F.length("body")).cast(docs.schema[c].dataType)
        columns.append(own.alias(c))
    return out.select(*columns)
