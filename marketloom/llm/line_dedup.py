"""Line dedup [9]: all windows over line hashes, positions joined, matches extended, later repeated runs deleted.

A window starts at each line with words and ends at the first line by which it has MIN_WORDS words. The least line hash
of each window is its fingerprint, but none is selected by it, as winnowing would: every window is kept, so two texts that share
a run of lines with MIN_WORDS words or more share a whole window at the same place of the run, with windows measured in words.
Each fingerprint with its window is joined to its first occurrence in the table (by id, then place), never to
all others. Every later occurrence is deleted, and the match goes on over following lines while they equal those
after the first occurrence. To the left nothing more is found: a line before the window that matched too
would start a repeated window itself.

Only lines that occur twice can take part, so hashes of lines are counted first and the rest never reaches a window.
DataFrame functions throughout; texts move once, to have their lines deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import common

MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"


def lines(docs: DataFrame) -> DataFrame:
    """Of (id, text): id, at (the line's place among lines with words), place (among all lines), h and w (its words)."""
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("place"), F.xxhash64(x).alias("h"), F.size(F.filter(F.split(x, SPACE), lambda w: w != "")).alias("w")))
    each = docs.select("id", F.posexplode(F.filter(split, lambda x: x["w"] > 0)).alias("at", "x"))
    return each.select("id", "at", "x.place", "x.h", "x.w")


def windows(found: DataFrame) -> DataFrame:
    """Of lines that occur twice or more: the windows, with fingerprint, length and the lines that follow."""
    ahead = Window.partitionBy("id").orderBy("at").rowsBetween(0, 2 * MIN_WORDS - 2)
    rows = found.withColumn("near", F.collect_list(F.struct("at", "h", "w")).over(ahead))
    rows = rows.withColumn("near", F.filter("near", lambda x, i: x["at"] == F.col("at") + i))
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(2**63 - 1).cast("long").alias("least"))
    grow = lambda a, x: F.when(a["w"] >= MIN_WORDS, a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), (a["n"] + 1).alias("n"), F.xxhash64(a["key"], x["h"]).alias("key"), F.least(a["least"], x["h"]).alias("least")))
    rows = rows.withColumn("win", F.aggregate("near", start, grow)).where(F.col("win.w") >= MIN_WORDS)
    rest = F.transform(F.slice("near", F.col("win.n") + 1, MIN_WORDS - 1), lambda x: x["h"])
    return rows.select("id", "at", F.col("win.n").alias("n"), F.col("win.least").alias("fingerprint"), F.col("win.key").alias("window"), rest.alias("rest"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Of (id, text), where an id may repeat with its text: id and gone, the places of the lines to delete. Other documents aren't listed."""
    each, _ = common.written(lines(docs), "lines")
    twice = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    found = each.join(twice, "h").repartition("id").dropDuplicates(["id", "at"])
    found, _ = common.written(windows(found), "windows")
    first = found.groupBy("fingerprint", "window").agg(F.min(F.struct("id", "at", "rest")).alias("first"), F.count("*").alias("c")).where("c > 1").select("fingerprint", "window", "first")
    later = found.join(first, ["fingerprint", "window"]).where("id != first.id or at != first.at")
    same = F.zip_with("rest", "first.rest", lambda x, y: F.coalesce(x == y, F.lit(False)))
    more = F.coalesce(F.array_position(same, False) - 1, F.size(same))
    more = F.when(F.array_contains(same, False), more).otherwise(F.size(same))
    begin = F.when(F.col("id") == F.col("first.id"), F.greatest(F.col("at"), F.col("first.at") + F.col("n"))).otherwise(F.col("at"))
    span = later.select("id", begin.alias("a"), (F.col("at") + F.col("n") + more - 1).cast("int").alias("b")).where("a <= b")
    gone = span.select("id", F.explode(F.sequence("a", "b")).alias("at")).distinct()
    return gone.join(each.select("id", "at", "place"), ["id", "at"]).groupBy("id").agg(F.collect_set("place").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with their columns; text without its repeated runs, and n_removed_lines.

    Ids give the order of documents. Null and empty texts have no lines and stay as they are; a
    text all of whose lines go becomes empty. Rows without id are left alone. Rows that repeat an id are documents of their own, in the
    order of a hash of their texts; rows with one id and one text are one document, and lose the same lines. An empty table gives an empty result. A run within
    one text that overlaps its own first occurrence is deleted from that occurrence's end on. A column n_removed_lines of docs is replaced.
    """
    common.ship(docs.sparkSession)
    key = F.struct(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("text"))
    own = docs.select(key.alias("id"), docs[text_col].cast("string").alias("text")).where("id.id is not null and text is not null")
    gone = repeated_lines(own).withColumnsRenamed({"id": "__id__", "gone": "__gone__"})
    joined = docs.join(gone, key == gone["__id__"], "left")
    left = F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains("__gone__", i))
    text = F.when(F.col("__gone__").isNull(), docs[text_col]).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns if c != "n_removed_lines"], F.coalesce(F.size("__gone__"), F.lit(0)).alias("n_removed_lines"))
