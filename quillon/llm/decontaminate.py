"""Operator 6: benchmark decontamination by a prefix-filtered set join, DataFrame operations only.

A window is ``size`` consecutive words of a benchmark item, or all words of a shorter item. A document
word inside any occurrence of a window is hit. A window's words are ordered by rarity in the documents;
as all of them must be there in their places, the necessary prefix is the rarest word but the last, with the word
after it: its anchor. Documents' words are joined to anchors on both words (a window of one word on that
word); what would start before the first or end after the last document word is left out (position and length
bounds); the rest is compared word by word over the window's size, after a document's candidates have been
gathered beside its text.

Word positions meet anchors by the anchor's number alone; its words are looked up once for each document. Anchors and
candidates go to all tasks while they have at most ``broadcast_bytes``; beyond that, word positions and texts are
joined by shuffles that adaptive execution splits.

Defined results: null texts have no words, no hits and no items; an empty benchmark leaves all documents
clean; items with a null id are ignored; rows that repeat id and text get equal results; other columns are
ignored by ``hits`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10


def words(text: Column) -> Column:
    """Lower-cased words of a text: ASCII letters and digits and everything beyond ASCII."""
    return F.array_remove(F.split(fold_ascii(text), SEPARATORS), "")


def small(df: DataFrame, column: str, broadcast_bytes: int) -> bool:
    """Whether a written table, whose rows have this text and some numbers, may go to all tasks."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column) + 48), F.lit(0)).alias("b")).first().b <= broadcast_bytes


def anchors(docs_words: DataFrame, benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", size: int = SIZE,
            broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``anchor, word, after, item_id, n, aw, at, more``: the anchor is word ``at`` of ``aw``, and serves the windows of n words that start at 0..more there.

    ``after`` is the word after it, null for windows of one word.
    """
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("iw"))
    items = written(items.where(F.size("iw") > 0).distinct(), "items")
    vocabulary = written(items.select(F.explode("iw").alias("word")).distinct(), "item-words")
    seen = docs_words.select(F.explode("w").alias("word"))
    seen = seen.join(F.broadcast(vocabulary) if small(vocabulary, "word", broadcast_bytes) else vocabulary, "word")
    counts = written(seen.groupBy("word").count(), "item-word-counts", vocabulary)
    pos = items.select("item_id", "iw", F.least(F.lit(size), F.size("iw")).alias("n"), F.posexplode("iw").alias("at", "word"))
    pos = pos.join(counts, "word", "left").withColumn("rank", F.struct(F.coalesce("count", F.lit(0)).alias("c"), "word", "at"))
    ranked = pos.groupBy("item_id", "iw", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rank"))), lambda x: x["rank"]).alias("ranks"))
    wins = ranked.select("item_id", "iw", "n", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("iw") - F.col("n")),
        lambda s: F.struct(s.alias("s"), F.array_min(F.slice("ranks", s + 1, F.greatest(F.col("n") - 1, F.lit(1)))).alias("r")))).alias("x"))
    # A word that no document has can't be joined; its windows are dropped by the join itself.
    runs = (wins.groupBy("item_id", "iw", "n", F.col("x.r.word").alias("word"), F.col("x.r.at").alias("at"))
            .agg(F.min("x.s").alias("lo"), F.max("x.s").alias("hi")))
    # Written, so that the numbers stay.
    return written(runs.select(F.monotonically_increasing_id().alias("anchor"), "word", F.when(F.col("n") > 1, F.get("iw", F.col("at") + 1)).alias("after"), "item_id", "n", F.slice("iw", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("n")).alias("aw"),
                               (F.col("at") - F.col("lo")).alias("at"), (F.col("hi") - F.col("lo")).alias("more")), "anchors", items, counts)


def _starts(w: Column, c: Column) -> Column:
    """Document positions where a window of anchor c occurs, ascending: word ``c.at`` of ``c.aw`` stands at each of ``c.places``."""
    def at_place(pos: Column) -> Column:
        shift = pos - c["at"]
        first, last = F.greatest(F.lit(0), -shift), F.least(c["more"], F.size(w) - shift - c["n"])
        s = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        same = F.filter(s, lambda x: F.slice(w, x + shift + 1, c["n"]) == F.slice(c["aw"], x + 1, c["n"]))
        return F.transform(same, lambda x: x + shift)

    return F.flatten(F.transform(c["places"], at_place))


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
         item_text_col: str = "text", size: int = SIZE, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, h`` for every document.

    ``items`` are the ids as sorted strings, ``spans`` the hit windows as (first, end) in order, ``h`` the text's hash.
    A document's candidates come to its text in one row, so words are never copied to each position.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    doc = text.select("doc_id", "h", words(F.col("text")).alias("w"))
    table = anchors(doc, benchmark, id_col=item_id_col, text_col=item_text_col, size=size, broadcast_bytes=broadcast_bytes)
    keys = table.select("word", "after", "anchor", "at", "more")
    spread = F.broadcast if small(table, F.concat_ws(" ", "word", "after"), broadcast_bytes) else (lambda x: x)
    # Each word beside the next one; a text's last word has none.
    at = doc.select("doc_id", "h", F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.size("w")).alias("after"))).alias("pos", "x")).select("doc_id", "h", "pos", "x.word", "x.after")
    found = at.join(spread(keys.where("after is not null")), ["word", "after"]).where("pos >= at - more")
    alone = keys.where("after is null")
    if not alone.isEmpty():
        found = found.unionByName(at.join(spread(alone.drop("after")), "word").select(found.columns))
    places = found.groupBy("doc_id", "h", "anchor").agg(F.collect_set("pos").alias("places"))
    whole = table.select("anchor", "item_id", "n", "aw", "at", "more")
    whole = F.broadcast(whole) if small(table, F.array_join("aw", " "), broadcast_bytes) else whole
    cands = places.join(whole, "anchor").groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(
        F.collect_list(F.struct("places", "item_id", "n", "aw", "at", "more")).alias("cands"))
    cands = written(cands, "candidates")
    held = F.aggregate("cands", F.lit(64), lambda s, c: s + 64 + 8 * F.size(c["places"]) + 24 * F.size(c["aw"]))
    size_of = cands.agg(F.coalesce(F.sum(held), F.lit(0)).alias("b")).first().b
    cands = F.broadcast(cands) if size_of <= broadcast_bytes // 2 else cands.hint("shuffle_hash")
    joined = text.join(cands, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    out = joined.select("doc_id", "h", words(F.col("text")).alias("w"), F.coalesce("cands", F.array()).alias("cands"))
    # Where there are no candidates, only the words are counted.
    found = F.filter(F.transform("cands", lambda c: F.struct(c["item_id"].alias("item_id"), c["n"].alias("n"), _starts(F.col("w"), c).alias("starts"))),
                     lambda f: F.size(f["starts"]) > 0)
    out = out.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), found.alias("found"))
    # A window is one number, first * (size + 1) + length, so that sorting and telling apart stay linear.
    base = size + 1
    codes = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: F.transform(f["starts"], lambda s: s.cast("long") * base + f["n"])))))
    out = out.select("doc_id", "h", "n_words", F.array_sort(F.array_distinct(F.transform("found", lambda f: f["item_id"]))).alias("items"), codes.alias("codes"))
    # Each window adds the words that lie beyond all windows before it.
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, code: Column) -> Column:
        first = F.floor(code / base)
        end = first + code % base
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], first))).alias("n"))

    spans = F.transform("codes", lambda c: F.struct(F.floor(c / base).cast("int").alias("first"), (F.floor(c / base) + c % base).cast("int").alias("end")))
    return out.select("doc_id", "n_words", F.aggregate("codes", zero, step, lambda acc: acc["n"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), (F.size("codes") > 0).alias("contaminated"),
                      "items", spans.alias("spans"), "h")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The documents without a hit, with all their columns."""
    # Written before it is filtered: a filter pushed into the plan would compute the comparison again for each row.
    marked = written(hits(docs, benchmark, id_col=id_col, text_col=text_col, size=size).select("doc_id", "h", "contaminated"), "marked")
    dirty = marked.where("contaminated").select(F.col("doc_id").alias("_q_dirty_id"), F.col("h").alias("_q_dirty_h")).distinct()
    match = docs[id_col].eqNullSafe(F.col("_q_dirty_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_q_dirty_h"))
    return docs.join(dirty, match, "left_anti")
