"""Operator 9: Jaccard join on word shingles by a grouped prefix join.

A document's set holds its distinct shingles of ``size`` words, folded to lower-case ASCII; two documents
link when ``100 * intersection >= percent * union``.

1. Documents with identical sets form a class, whatever their number; only classes are joined. A class is known by
   a 128-bit BLAKE2 digest of its set.
2. Shingles are ordered by the document frequency of their rarest word, then by hash. The order needs
   the ``top_words`` most frequent words only: all others count as rarer. Two classes that link share a
   shingle within the first ``n - ceil(percent * n / 100) + 1`` of each, its prefix. Shingles on the prefixes of more than
   ``late_list`` groups, as those of a passage that many texts hold, are then put last in the order, and the prefixes
   that held them are taken again. Any common order finds every link; this one keeps such passages from tying other texts.
3. Classes with the same prefix and size form a group, and groups are what the prefix lists hold. Group pairs are
   filtered three times. By their sizes. By the shingle's places i and j in both: were it the first that they
   share, they could share ``min(n - i, m - j)`` at most, and the first shared shingle passes this for every link. By the
   number of shingles that both prefixes hold, which limits what the sets can share: the rest is at most what lies
   beyond the prefix that ends first. A list of more than ``hot_list`` groups deals out no pairs: it ties its groups to one hub for each
   band of sizes, and a hub to that of the next band, as linked sets differ in size by a bounded factor. Pairs and ties
   join groups to clusters, so that every link lies inside one; a group of several classes that meets no other is a cluster of its own.
4. Members are expanded and verified inside their cluster: intersections are counted exactly over an index of the
   cluster's shingles. A cluster over ``block_shingles`` is dealt in blocks, and each pair of blocks is one
   task, so that no task holds more than two blocks. Pairs and tasks are dealt in rounds, which bound what is on disk
   at a time. Where only components are asked for, the members that link with one central member are not compared with each other.
5. Components of the links, over classes, give each document the smallest id that it reaches.

Shingles are 64-bit hashes, of which a pair of documents compares few; a wrongly joined group only makes a cluster
larger. ``classes`` and ``links`` are the pairs with membership; copies are not expanded into pairs.

Defined results: null texts and texts without words have empty sets and link with nothing, not with each other
either; rows that repeat a doc_id are joined by their texts and share its id; rows with a null id take part
and count as no id: a component of such rows alone has a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written
from .components import components, local_trees
from .wordhash import rolling, text_slices, word_hashes, word_spans
from .workers import lean, trim

SIZE, PERCENT = 4, 85


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, sorted distinct shingles, first word position of each) and, as last item, the row's word hashes."""
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends, fold=True)
        rolled = rolling(h, size)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= size:
                own, at = np.unique(rolled[a: b - size + 1], return_index=True)
            elif b > a:
                own, at = rolling(h[a:b], b - a), np.zeros(1, dtype=np.int64)
            else:
                own, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            yield lo + i, own, at, h[a:b]


def digest(values: np.ndarray, extra: int = 0) -> tuple[int, int]:
    """128 bits of a sorted set or of a sequence, as two signed integers."""
    raw = hashlib.blake2b(values.tobytes(), digest_size=16, salt=extra.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of a written table with the largest counts, ``most`` at most; rows of one count are all in or all out."""
    # The least count that leaves at most that many, from the number of rows at each count.
    least, room = 1 << 62, most
    # Each count is that of a row at least, so no more than ``most`` of them are needed.
    for r in counts.groupBy(F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).limit(most + 1).collect():
        room -= r.k
        if room < 0:
            break
        least = r.c
    return counts.where(F.col(column) >= least)


def word_frequencies(docs: DataFrame, text_col: str, top_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and document frequencies of the most frequent words; at most ``top_words`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(0)):
                starts, ends, first = word_spans(data, offsets)
                h = word_hashes(data, starts, ends, fold=True)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                word, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    counts = written(docs.select(F.col(text_col).cast("string")).mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    top = most_frequent(counts.where("n > 1"), "n", top_words).toPandas()
    discard(counts)
    word = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], top["n"].to_numpy(np.int64)[order]


def shingled(docs: DataFrame, frequencies: tuple[np.ndarray, np.ndarray], *, id_col: str, text_col: str, size: int, percent: int,
             late: np.ndarray | None = None) -> DataFrame:
    """``doc_id, k1, k2, n, prefix, g1, g2`` for every document: digests of its set and of its prefix with the size, null for empty sets.

    ``prefix`` is in the common order; the shingles in ``late``, sorted, come last in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((*frequencies, late))  # bounded by top_words and late_shingles
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("k1", "k2", "n")],
                           T.StructField("prefix", T.ArrayType(T.LongType())), *[T.StructField(c, T.LongType()) for c in ("g1", "g2")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, last = shared.value
        for b in batches:
            keys, sizes, prefixes, groups = [], [], [], []
            for _, own, at, h in shingle_sets(b.column(1), size):
                n = len(own)
                sizes.append(n)
                if not n:
                    keys.append((None, None))
                    prefixes.append(own.view(np.int64))
                    groups.append((None, None))
                    continue
                df = np.zeros(len(h), dtype=np.int64)
                if len(words):
                    i = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    df = np.where(words[i] == h, counts[i], 0)
                rarest = df[at].copy()
                for k in range(1, min(size, len(h))):
                    np.minimum(rarest, df[at + k], out=rarest)
                take = n - -(-percent * n // 100) + 1
                order = (own, rarest)
                if last is not None and len(last):
                    order += (last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own,)
                prefix = own[np.lexsort(order)[:take]]
                keys.append(digest(own))
                prefixes.append(prefix.view(np.int64))
                groups.append(digest(prefix, n))
            at = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            longs = lambda pairs, x: pa.array([p[x] for p in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), longs(keys, 0), longs(keys, 1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, flat),
                                              longs(groups, 0), longs(groups, 1)], names=schema.names)

    return src.mapInArrow(lean(run), schema)


def few_rows(df: DataFrame, row_bytes: int, most: int) -> bool:
    """Whether a written table of rows of a fixed width is small enough to go to all tasks."""
    return df.count() * row_bytes <= most


def prefix_lists(groups: DataFrame) -> DataFrame:
    """A written table ``shingle, c``: the groups with a shingle in their prefix, where they are several."""
    return written(groups.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "prefix-lists")


def prefix_groups(docs: DataFrame, full: DataFrame, frequencies: tuple[np.ndarray, np.ndarray], *, id_col: str, text_col: str, size: int, percent: int,
                  late_list: int, late_shingles: int, late_rounds: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: classes as ``k1, k2, low, rows, n, gid, cid``; groups as ``gid, n, prefix``; their lists as ``shingle, c``.

    A shingle on more than ``late_list`` prefixes is put last in the common order, ``late_shingles`` at most, the most frequent
    first. A prefix changes only where it holds such a shingle; the texts of those classes are read again. Other shingles take
    the place, so this is done ``late_rounds`` times at most.
    """
    some = full.where("k1 is not null")
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"), F.min("g1").alias("gid"))
    # Written, so that the ids stay.
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    groups = written(some.dropDuplicates(["g1", "g2"]).select(F.col("g1").alias("gid"), "n", "prefix"), "groups")
    lists, late = prefix_lists(groups), np.zeros(0, np.uint64)
    for _ in range(late_rounds):
        known = docs.sparkSession.createDataFrame(pa.table({"shingle": late.view(np.int64)}))
        long = written(lists.where(F.col("c") > late_list).join(F.broadcast(known), "shingle", "left_anti"), "long-lists")
        more = most_frequent(long, "c", late_shingles - len(late)).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
        discard(long)
        if not len(more):
            break
        late = np.sort(np.concatenate([late, more.view(np.uint64)]))
        # Bounded by late_shingles.
        new = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"shingle": more})))
        hit = written(groups.select("gid", F.explode("prefix").alias("shingle")).join(new, "shingle", "left_semi").select("gid").distinct(), "late-groups")
        few = F.broadcast(hit) if few_rows(hit, 8, broadcast_bytes) else hit
        again = written(classes.join(few, "gid", "left_semi").select("low", "k1", "k2", "cid"), "late-classes")
        wanted = again.select(F.col("low").alias("_q_low")).distinct()
        wanted = F.broadcast(wanted) if few_rows(again, 40, broadcast_bytes) else wanted
        found = shingled(docs.join(wanted, F.col(id_col).eqNullSafe(F.col("_q_low")), "left_semi"), frequencies, id_col=id_col, text_col=text_col,
                         size=size, percent=percent, late=late)
        # Another row may have the class's id but not its set.
        near = F.broadcast(again) if few_rows(again, 40, broadcast_bytes) else again
        found = found.join(near, ["k1", "k2"]).dropDuplicates(["cid"]).select("cid", F.col("g1").alias("moved"), "n", "prefix")
        found = written(found, "late-prefixes", again)
        moved = found.select("cid", "moved")
        moved = F.broadcast(moved) if few_rows(moved, 16, broadcast_bytes) else moved
        classes = written(classes.join(moved, "cid", "left").withColumn("gid", F.coalesce("moved", "gid")).drop("moved"), "classes", classes)
        kept = groups.join(few, "gid", "left_anti")
        # A prefix may be that of another group now.
        fresh = found.select(F.col("moved").alias("gid"), "n", "prefix").dropDuplicates(["gid"])
        ids = fresh.select("gid")
        same = written(kept.select("gid").join(F.broadcast(ids) if few_rows(found, 8, broadcast_bytes) else ids, "gid", "left_semi"), "same-groups")
        fresh = fresh.join(F.broadcast(same) if few_rows(same, 8, broadcast_bytes) else same, "gid", "left_anti")
        groups = written(kept.unionByName(fresh), "groups", groups, hit, found, same)
        discard(lists)
        lists = prefix_lists(groups)
    return classes, groups, lists


def prefix_clusters(classes: DataFrame, groups: DataFrame, lists: DataFrame, percent: int, hot_list: int, broadcast_bytes: int, pair_rows: int) -> DataFrame:
    """``gid, cluster`` for groups that hold several classes or may link with another group by their prefixes.

    A list of c groups has c (c - 1) / 2 pairs, so pairs can be many more than entries. They are dealt in rounds by their smaller
    group, each of about as many rows as there are entries, or ``pair_rows`` if that is more.
    """
    # Classes with the same prefix and size are compared with each other, whether or not their group meets another one.
    alone = written(classes.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gid"), "groups-of-several")
    post = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "shingle"))
    cold, hot = (lists.where(F.col("c") <= hot_list).select("shingle"), lists.where(F.col("c") > hot_list).select("shingle"))
    # Hot lists are few, as each has many entries; they are taken out before anything is dealt out by shingle.
    hot = F.broadcast(hot) if few_rows(hot, 16, broadcast_bytes) else hot
    # Bands of sizes: linked sets are in the same band or in neighbours. They are a little wider than needed, so that rounding parts none.
    band = F.floor(F.log(F.col("n").cast("double")) / (max(float(np.log(100 / percent)), 1e-9) * (1 + 1e-9)))
    warm = written(post.join(hot, "shingle", "left_semi").select("shingle", "gid", band.alias("band")), "hot-entries")
    # Hot shingles of a prefix are not counted in pairs, so they may all be shared.
    held = written(warm.groupBy("gid").agg(F.count(F.lit(1)).alias("held")), "hot-counts")
    near = F.broadcast(held) if few_rows(held, 24, broadcast_bytes) else held
    entries = post.join(hot, "shingle", "left_anti").join(cold.hint("shuffle_hash"), "shingle").join(near, "gid", "left").select(
        "shingle", "gid", F.col("n").cast("int"), F.col("pos").cast("int"), F.coalesce("held", F.lit(0)).cast("int").alias("held"))
    entries = written(entries, "prefix-entries", held)
    sums = lists.where(F.col("c") <= hot_list).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("entries"),
                                                   F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)).alias("pairs")).first()
    rounds = max(1, -(-sums.pairs // max(1, pair_rows, sums.entries)))
    a = entries.select("shingle", F.col("gid").alias("a"), F.col("n").alias("n"), F.col("pos").alias("i"), F.col("held").alias("x"))
    b = entries.select("shingle", F.col("gid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("held").alias("y"))
    total = (F.col("n") + F.col("m")) * F.lit(percent).cast("long")
    first = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) * F.lit(100 + percent).cast("long") >= total
    # Beyond its prefix a set of n shingles has ceil(percent * n / 100) - 1.
    beyond = F.expr(f"(greatest(n, m) * {percent}L + 99) div 100 - 1")
    need = F.ceil(total / (100 + percent)).cast("int") - (beyond + F.least("x", "y")).cast("int")
    found = []
    for r in range(rounds):
        # All rows of a pair have the same smaller group.
        own = a.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == r) if rounds > 1 else a
        both = own.join(b, "shingle").where("a < b").where(F.least("n", "m") * F.lit(100).cast("long") >= F.greatest("n", "m") * F.lit(percent).cast("long"))
        pairs = both.select("a", "b", first.cast("int").alias("first"), need.alias("need")).groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("common"), F.max("first").alias("first"), F.min("need").alias("need")).where("first = 1 and common >= need").select("a", "b")
        found.append(written(pairs, "round-pairs") if rounds > 1 else pairs)
    pairs = reduce(DataFrame.unionByName, found)
    hubs = written(warm.groupBy("shingle", "band").agg(F.min("gid").alias("hub")), "hubs")
    near = F.broadcast(hubs) if few_rows(hubs, 40, broadcast_bytes) else hubs
    ties = warm.join(near, ["shingle", "band"]).select(F.col("gid").alias("a"), F.col("hub").alias("b"))
    following = hubs.select("shingle", (F.col("band") - 1).alias("band"), F.col("hub").alias("b"))
    ties = ties.unionByName(hubs.join(following, ["shingle", "band"]).select(F.col("hub").alias("a"), "b"))
    edges = written(pairs.unionByName(ties), "prefix-pairs", entries, warm, hubs, lists, groups, *found)
    found = written(components(edges).select(F.col("node").alias("gid"), F.col("root").alias("cluster")), "tied-groups", edges)
    near = F.broadcast(found) if few_rows(found, 24, broadcast_bytes) else found
    alone_too = alone.join(near, "gid", "left_anti").select("gid", F.col("gid").alias("cluster"))
    return written(found.unionByName(alone_too), "clusters", found, alone)


def in_blocks(members: DataFrame, key: str, size: str, most: int, broadcast_bytes: int) -> DataFrame:
    """Each member once for each task of its cluster: ``own`` block, and the task's blocks ``i <= j``, of about ``most`` of ``size`` each."""
    totals = members.groupBy("cluster").agg(F.sum(size).alias("_total")).where(F.col("_total") > most)
    # Only clusters beyond one block are looked up, and each of them holds more than ``most``.
    totals = written(totals.select("cluster", F.ceil(F.col("_total") / most).cast("int").alias("_many")), "large-clusters")
    members = members.join(F.broadcast(totals) if few_rows(totals, 24, broadcast_bytes) else totals, "cluster", "left")
    members = members.withColumn("_blocks", F.coalesce("_many", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    # Block i meets block j in task (i, j) with i <= j.
    members = members.withColumn("_task", F.explode(F.expr(
        "transform(sequence(0, _blocks - 1), x -> named_struct('i', least(own, x), 'j', greatest(own, x)))")))
    return members.select("*", "_task.i", "_task.j").drop("_many", "_blocks", "_task")


class Index:
    """Sets by their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.flat, self.who = flat[order], who[order]

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the sets that link with s, itself included if it is one of them."""
        lo = np.searchsorted(self.flat, s, side="left")
        k = np.searchsorted(self.flat, s, side="right") - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(int(k.sum()))
        common = np.bincount(self.who[at], minlength=len(self.size))
        return np.flatnonzero(100 * common >= percent * (self.size + len(s) - common))

    def centre(self, sets: list[np.ndarray]) -> int:
        """The set whose shingles are the most frequent ones on average."""
        new = np.ones(len(self.flat), dtype=bool)
        new[1:] = self.flat[1:] != self.flat[:-1]
        runs = np.append(np.flatnonzero(new), len(self.flat))
        score = np.bincount(self.who, weights=np.repeat(np.diff(runs), np.diff(runs)), minlength=len(sets)) / self.size
        return int(score.argmax())


def block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int, forest: bool) -> list[tuple[int, int]]:
    """Links between left and right, or inside left where right is empty; positions in left + right, each pair once.

    With ``forest``, links that join nothing more may be missing and links inside one side may be added: what links with
    one central set is joined already, so only the other sets look for their partners.
    """
    base, first = len(left), Index(left)
    out: list[tuple[int, int]] = []
    core = np.zeros(base + len(right), dtype=bool)
    second = Index(right) if right and forest else None
    if forest and base > 2:
        c = first.centre(left)
        found = first.linked(left[c], percent)
        if second is not None:
            found = np.concatenate([found, base + second.linked(left[c], percent)])
        core[found] = core[c] = True
        out += [(c, int(x)) for x in found if x != c]
    if not right:
        for q in np.flatnonzero(~core).tolist():
            found = first.linked(left[q], percent)
            out += [(int(x), q) for x in found[core[found] | (found < q)] if x != q]
        return out
    for q in np.flatnonzero(~core[base:]).tolist():
        out += [(int(x), base + q) for x in first.linked(right[q], percent)]
    if second is not None and core.any():
        for q in np.flatnonzero(~core[:base]).tolist():
            found = second.linked(left[q], percent)
            out += [(q, base + int(x)) for x in found[core[base + found]]]
    return out


def verified_links(docs: DataFrame, members: DataFrame, *, id_col: str, text_col: str, size: int, percent: int, block_shingles: int,
                   broadcast_bytes: int, round_shingles: int, most_rounds: int, forest: bool = False) -> DataFrame:
    """A written table ``a, b``: ids of linked classes, or with ``forest`` one tree for each component of a task's links.

    ``members``: doc_id, k1, k2, cid, n, cluster, one row for each class. Tasks are done in rounds, so that the texts of about
    ``round_shingles`` are dealt out at a time, and that a round's members, about ``broadcast_bytes``, go to all tasks: then no other texts
    are dealt out. Where that takes over ``most_rounds`` rounds, members and documents are joined by a shuffle.
    """
    given, members = members, written(in_blocks(members, "cid", "n", block_shingles, broadcast_bytes), "block-members")
    sums = members.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    rounds = max(1, -(-sums.n // max(1, round_shingles)))
    by_size = max(1, -(-80 * sums.rows // max(1, broadcast_bytes)))
    few = max(rounds, by_size) <= most_rounds
    # Without the broadcast each round deals out all texts.
    rounds = max(rounds, by_size) if few else min(rounds, most_rounds)

    def run(table: pa.Table) -> pa.Table:
        # Another row may have the representative's id but not its set.
        table = table.combine_chunks()
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        k1, k2, ids = (table.column(c).to_numpy() for c in ("k1", "k2", "cid"))
        seen, found = set(), []
        for chunk in table.column("text").chunks:
            base = len(found)
            found += [None] * len(chunk)
            for row, s, _, _ in shingle_sets(chunk, size):
                x = base + row
                if len(s) and ids[x] not in seen and digest(s) == (k1[x], k2[x]):
                    seen.add(ids[x])
                    found[x] = s
        left = [x for x, s in enumerate(found) if s is not None and own[x] == i[x]]
        right = [x for x, s in enumerate(found) if s is not None and own[x] != i[x]]
        a = b = np.zeros(0, np.int64)
        if left and (i[0] == j[0] or right):
            pairs = np.array(block_links([found[x] for x in left], [found[x] for x in right], percent, forest), dtype=np.int64).reshape(-1, 2)
            order = ids[left + right]
            a, b = order[pairs[:, 0]], order[pairs[:, 1]]
            if forest and len(a):
                a, b = local_trees(a, b)
        if table.nbytes > 4 << 20:
            del found
            trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = []
    for r in range(rounds):
        own = members.where(F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(rounds)) == r)
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
            F.broadcast(own) if few else own, F.col("id").eqNullSafe(F.col("doc_id")))
        rows = rows.select("text", "k1", "k2", "cid", "own", "cluster", "i", "j")
        out.append(written(rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long"), "links"))
    discard(members, given)
    return out[0] if rounds == 1 else written(reduce(DataFrame.unionByName, out), "links", *out)


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, top_words: int = 200_000,
         hot_list: int = 100, late_list: int = 50, late_shingles: int = 500_000, late_rounds: int = 2, block_shingles: int = 1_000_000,
         broadcast_bytes: int = 32 << 20, pair_rows: int = 20_000_000, round_shingles: int = 200_000_000, most_rounds: int = 8,
         forest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: documents as ``doc_id, k1, k2, n``; classes of equal sets as ``k1, k2, cid, low, rows``; links as ``a, b`` of class ids.

    With ``forest``, trees over the same components stand for the links, as all links of a large family are many.
    """
    frequencies = word_frequencies(docs, text_col, top_words)
    full = written(shingled(docs, frequencies, id_col=id_col, text_col=text_col, size=size, percent=percent), "shingle-sets")
    classes, groups, lists = prefix_groups(docs, full, frequencies, id_col=id_col, text_col=text_col, size=size, percent=percent, late_list=late_list,
                                           late_shingles=late_shingles, late_rounds=late_rounds, broadcast_bytes=broadcast_bytes)
    # The prefixes of all documents go before those of the groups are dealt out.
    sets = written(full.select("doc_id", "k1", "k2", "n"), "sets", full)
    clusters = prefix_clusters(classes, groups, lists, percent, hot_list, broadcast_bytes, pair_rows)
    near = F.broadcast(clusters) if few_rows(clusters, 32, broadcast_bytes) else clusters
    members = written(classes.join(near, "gid").select(F.col("low").alias("doc_id"), "k1", "k2", "cid", "n", "cluster"), "members", clusters)
    links = verified_links(docs, members, id_col=id_col, text_col=text_col, size=size, percent=percent, block_shingles=block_shingles,
                           broadcast_bytes=broadcast_bytes, round_shingles=max(round_shingles, sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 4),
                           most_rounds=most_rounds, forest=forest)
    return sets, classes, links


def _joined(docs: DataFrame, broadcast_bytes: int, options: dict) -> tuple[DataFrame, list[DataFrame]]:
    """The join, and the written tables that it reads."""
    sets, classes, links = link(docs, broadcast_bytes=broadcast_bytes, forest=True, **options)
    trees = written(components(links), "trees", links)
    # Classes of one document without a link are their own components and are looked up nowhere.
    ids = classes.join(trees.withColumnRenamed("node", "cid"), "cid", "left").where("root is not null or rows > 1").withColumn("root", F.coalesce("root", "cid"))
    best = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = written(ids.join(best, "root").select("k1", "k2", "component_id", F.lit(True).alias("known")), "component-ids", trees, classes)
    near = F.broadcast(ids) if few_rows(ids, 40, broadcast_bytes) else ids
    out = sets.join(near, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), [sets, ids]


def join(docs: DataFrame, *, broadcast_bytes: int = 32 << 20, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    return _joined(docs, broadcast_bytes, options)[0]


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20, **options) -> DataFrame:
    """The document with the smallest id of each component, with all columns; empty sets all stay."""
    found, used = _joined(docs, broadcast_bytes, {"id_col": id_col, "text_col": text_col, **options})
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_q_lost_id")).distinct()
    lost = written(lost, "near-copies", *used)
    lost = F.broadcast(lost) if few_rows(lost, 16, broadcast_bytes) else lost
    return docs.join(lost, docs[id_col].eqNullSafe(F.col("_q_lost_id")), "left_anti")
