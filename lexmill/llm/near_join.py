"""N-gram Jaccard join by signature trees.

A document is the set of its distinct five-word shingles; two documents are linked when their
Jaccard similarity is at least 0.8.  The result gives each document its class: the smallest doc_id
it reaches by links.

Plan
1. *profile*: one pass names each document's set by a 64-bit digest, and adds its shingles to a
   fixed array of counters.  Equal sets are one class member from here on.
2. *cells*: two sets this similar share one of their first ``n - ceil(0.8 n) + 1`` shingles in any
   common order.  Rare-first by the counters, so that a passage shared by a third of the corpus comes
   last in every document; beyond 2**15 they count on a logarithmic scale, so they keep telling frequent
   shingles apart at any size.  Counters are noisy, so shingles that still stand among the first of
   ``heavy_from`` sets or more, counted exactly by a shuffle, are put behind all others, and the first
   ones are taken anew.  Any order gives the same links; a worse one makes larger cells.  Sets that share
   such a shingle, directly or through others, form a cell.
   The filters that go to the workers, of heavy shingles and of sets in cells, have 16 bits for each of
   their members, up to 2**28 bits (32 MB).  Beyond that only the more frequent heavy shingles are marked,
   and the other filter lets more sets through to an exact join.
3. *signature trees*: in each cell, a tree over the sets whose nodes hold the OR of their members'
   token bitmaps, the size range and the largest in-set bit collision.  A dual traversal drops a pair
   of nodes when ``popcount(OR & OR)`` cannot reach the overlap that their sizes ask for, or when both
   already are one class; surviving pairs are verified on the exact sets.
   A cell above ``cell_elements`` is dealt into tiles: each tile first, then representatives of the
   tiles' classes, then every set outside the largest class against all tiles.  Nothing is capped.
4. *classes*: connected components of the verified links.

Nulls, empty texts and texts without words have no shingles and link with nothing; a null doc_id
takes part like any other row (its class is the smallest non-null doc_id of the class, or null);
repeated rows are copies of each other; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import counters
from .support import Shelf, connected_components, fresh, table
from .textkit import SHINGLE_WORDS, set_digest, shingle_set, signed, text_bytes, word_hashes

_MASK = np.uint64(counters.SIZE - 1)
_FAN_OUT = 8
_LEAST_BITS, _MOST_BITS = 22, 28
_SLICE = 1 << 16
_EXACT = 1 << 15


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Counters as 16-bit ranks, never falling with the count: exact to 2**15, logarithmic beyond.  Made in place, a slice at a time."""
    ranks = np.empty(len(counts), np.uint16)
    for i in range(0, len(counts), _SLICE):
        piece = counts[i : i + _SLICE]
        far = _EXACT + 512 * np.log2(np.maximum(piece, _EXACT) / _EXACT)
        ranks[i : i + _SLICE] = np.minimum(np.where(piece < _EXACT, piece, far), 2**16 - 1)
    return ranks


def _filter_bits(members: int) -> int:
    return min(max((16 * members).bit_length(), _LEAST_BITS), _MOST_BITS)


def _size(bits: np.ndarray) -> int:
    """How many slots the packed bits have, a power of two."""
    return 8 * len(bits)


def profile(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, th, n, digest) per row (th: hash of the text), and the counter blocks of each task's distinct sets."""

    def run(batches):
        seen, tally = set(), counters.Tally()
        for batch in batches:
            n, digests = [], []
            for text in text_bytes(batch.column(1)):
                s = shingle_set(word_hashes(text), words)
                n.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
                if digests[-1] not in seen and len(s):
                    if len(seen) < 500_000:
                        seen.add(digests[-1])
                    tally.add(s & _MASK)
            rows = len(n)
            yield _profile_batch(batch.column(0), batch.column(2), n, digests, [None] * rows, [None] * rows, [None] * rows)
        for block, salt, raw in counters.block_rows(tally.total(), TaskContext.get().partitionId()):
            yield _profile_batch(pa.array([None], pa.int64()), pa.array([None], pa.int64()), [None], [None], [block], [salt], [raw])

    schema = "id long, th long, n int, digest long, " + counters.BLOCK_SCHEMA
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col)).mapInArrow(run, schema)


def _profile_batch(ids, th, n, digests, block, salt, raw) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, th, pa.array(n, pa.int32()), pa.array(digests, pa.int64()), pa.array(block, pa.int32()), pa.array(salt, pa.int32()), pa.array(raw, pa.binary())],
        names=["id", "th", "n", "digest", "block", "salt", "counts"],
    )


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefixes(docs: DataFrame, text_col: str, words: int, percent: int, rarity, heavy=None) -> DataFrame:
    """(token, n, digest) for the rarest shingles of each set; a task gives a repeated set once."""

    def run(batches):
        seen, rare, last = set(), rarity.value, heavy and heavy.value
        shift = np.uint64(65 - _size(last).bit_length()) if last is not None else None
        for batch in batches:
            tokens, sizes, digests = [], [], []
            for text in text_bytes(batch.column(0)):
                s = shingle_set(word_hashes(text), words)
                if not len(s) or (digest := set_digest(s)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(digest)
                p = prefix_length(len(s), percent)
                # by rarity, then by shingle: s is sorted, so its position breaks ties
                rank = (rare[s & _MASK].astype(np.int64) << 32) | np.arange(len(s))
                if last is not None:
                    rank |= counters.has(last, s >> shift).astype(np.int64) << 62
                first = s[np.partition(rank, p - 1)[:p] & 0x7FFFFFFF]
                tokens.append(first)
                sizes.append(np.full(len(first), len(s), np.int32))
                digests.append(np.full(len(first), digest, np.int64))
                if len(tokens) >= 2000:
                    yield _token_batch(tokens, sizes, digests)
                    tokens, sizes, digests = [], [], []
            if tokens:
                yield _token_batch(tokens, sizes, digests)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, n int, digest long")


def _token_batch(tokens, sizes, digests) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(digests))], names=["token", "n", "digest"])


def _cell_edges(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that share a prefix token and whose sizes could match, as stars around a run's first."""

    def run(batches):
        last = None  # token, n, digest of the last row, and the digest its run began with
        for batch in batches:
            token, n, digest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(token):
                continue
            if last is not None:
                token, n, digest = np.r_[last[0], token], np.r_[np.int32(last[1]), n], np.r_[last[2], digest]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))]
            hub = digest[np.maximum.accumulate(np.where(fresh, np.arange(len(token)), 0))]
            if last is not None:  # the carried row stays in its run
                hub[: np.argmax(fresh[1:]) + 1 if fresh[1:].any() else len(hub)] = last[3]
            last = (token[-1], n[-1], digest[-1], hub[-1])
            pair = np.unique(np.c_[digest, hub][digest != hub], axis=0)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return prefixes.repartition("token").sortWithinPartitions("token", "n", "digest").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, text_col: str, words: int, wanted) -> DataFrame:
    """(digest, shingles) of the sets that the filter lets through; a task gives a repeated set once."""

    def run(batches):
        seen, want = set(), wanted.value
        last = _size(want) - 1
        for batch in batches:
            digests, raw = [], []
            for text in text_bytes(batch.column(0)):
                s = shingle_set(word_hashes(text), words)
                if not len(s):
                    continue
                slot = (digest := set_digest(s)) & last
                if not want[slot >> 3] >> (7 - slot % 8) & 1 or digest in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(digest)
                digests.append(digest)
                raw.append(s.tobytes())
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(raw, pa.binary())], names=["digest", "shingles"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest long, shingles binary")


def _filter_of(nodes: DataFrame, members: int) -> np.ndarray:
    """A filter of the nodes' digests: false positives only cost a later join row."""
    size = 1 << _filter_bits(members)
    return counters.marked(nodes.select(F.col("node").bitwiseAND(F.lit(size - 1)).cast("int")), size)


def _heavy(prefixes: DataFrame, least: int, shelf: Shelf) -> np.ndarray:
    """A filter of the tokens in ``least`` prefixes or more; in twice as many, until they fit its bits."""
    many = prefixes.select("token").repartition("token").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    many = shelf.put(many, "heavy")
    sizes = {r.power: r.tokens for r in many.groupBy(F.floor(F.log2(F.col("n") / least)).alias("power")).agg(F.count("*").alias("tokens")).collect()}
    power = 0
    while 4 * (tokens := sum(c for p, c in sizes.items() if p >= power)) > 1 << _MOST_BITS:
        power += 1
    bits = _filter_bits(tokens)
    found = counters.marked(many.where(F.col("n") >= least << power).select(F.shiftrightunsigned("token", 64 - bits).cast("int")), 1 << bits)
    shelf.drop("heavy")
    return found


class SignatureTree:
    """Sets in a tree of OR-combined bitmaps; ``links`` walks it against itself.

    sets: sorted distinct uint64 arrays.  classes: a label per set; sets of one label are known to be
    one class.  With ``every`` all links are given, without it only those that join two classes.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, classes: list[int] | None = None):
        self.percent = percent
        order = sorted(range(len(sets)), key=lambda i: (int(8 * np.log2(len(sets[i]))), sets[i][0]))
        self.order, self.sets = order, [sets[i] for i in order]
        n = np.array([len(s) for s in self.sets], np.int64)
        bits = 512
        while bits < 4 * n.mean() and bits < 1 << 16:
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            at = (s >> np.uint64(40)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        collide = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, n, n, collide)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, collide = self.levels[-1]
            at = np.arange(0, len(maps), _FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(collide, at)))
        self.parent = list(range(len(sets)))
        first: dict[int, int] = {}
        for i, j in enumerate(order):
            if classes is not None:
                self.parent[i] = self.find(first.setdefault(classes[j], i))
        self.whole = [np.zeros(len(level[0]), bool) for level in self.levels]
        self.whole[0][:] = True

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _hopeful(self, level: int, xs, ys) -> np.ndarray:
        """Which node pairs may hold a link, by size ranges and by the largest possible overlap."""
        maps, low, high, collide = self.levels[level]
        most = np.bitwise_count(maps[xs] & maps[ys]).sum(-1, dtype=np.int64) + np.minimum(collide[xs], collide[ys])
        p = self.percent
        return ((100 + p) * np.minimum(most, np.minimum(high[xs], high[ys])) >= p * (low[xs] + low[ys])) & (100 * high[xs] >= p * low[ys]) & (100 * high[ys] >= p * low[xs])

    def _one_class(self, level: int, x: int, y: int) -> bool:
        return bool(self.whole[level][x] and self.whole[level][y]) and self.find(x * _FAN_OUT**level) == self.find(y * _FAN_OUT**level)

    def _children(self, level: int, x: int) -> range:
        return range(x * _FAN_OUT, min((x + 1) * _FAN_OUT, len(self.levels[level - 1][0])))

    def _walk(self, level: int, pairs: list[tuple[int, int]], every: bool, out: list[tuple[int, int]]) -> None:
        """Pairs of different nodes of a level: drop the hopeless, verify sets, else go down."""
        stack = [(level, pairs)]
        while stack:
            level, pairs = stack.pop()
            xs, ys = (np.fromiter(side, np.int64, len(pairs)) for side in zip(*pairs))
            for x, y in zip(xs[ok := self._hopeful(level, xs, ys)].tolist(), ys[ok].tolist()):
                if not every and self._one_class(level, x, y):
                    continue
                if level:
                    stack.append((level - 1, [(a, b) for a in self._children(level, x) for b in self._children(level, y)]))
                elif self._linked(x, y):
                    out.append((self.order[x], self.order[y]))
                    self.parent[self.find(x)] = self.find(y)

    def _linked(self, x: int, y: int) -> bool:
        a, b = self.sets[x], self.sets[y]
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)

    def links(self, every: bool = False) -> list[tuple[int, int]]:
        """Pairs of positions in ``sets``."""
        out: list[tuple[int, int]] = []
        for level in range(1, len(self.levels)):
            for x in range(len(self.levels[level][0])):
                inside = self._children(level, x)
                for a in inside:  # one row of siblings at a time, so that a class found early prunes the rest
                    if a + 1 < inside.stop:
                        self._walk(level - 1, [(a, b) for b in range(a + 1, inside.stop)], every, out)
                roots = {self.find(a * _FAN_OUT ** (level - 1)) for a in inside}
                self.whole[level][x] = len(roots) == 1 and all(self.whole[level - 1][a] for a in inside)
        return out


def _tree_links(cells: DataFrame, percent: int, every: bool) -> DataFrame:
    """Rows (cell, digest, class, shingles) -> verified links (a, b), one cell in memory at a time."""

    def of_cell(digests, classes, raw):
        got: dict[int, tuple[int, np.ndarray]] = {}
        for digest, label, bytes_ in zip(digests, classes, raw):
            got.setdefault(digest, (label, np.frombuffer(bytes_, np.uint64)))
        if len(got) < 2:
            return
        names = list(got)
        tree = SignatureTree([got[d][1] for d in names], percent, [got[d][0] for d in names])
        if pairs := tree.links(every):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.int64()), pa.array([names[j] for _, j in pairs], pa.int64())], names=["a", "b"])

    def run(batches):
        now, held = None, ([], [], [])
        for batch in batches:
            for cell, digest, label, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if cell != now:
                    yield from of_cell(*held)
                    now, held = cell, ([], [], [])
                for side, value in zip(held, (digest, label, raw)):
                    side.append(value)
        yield from of_cell(*held)

    ready = cells.select("cell", "digest", "label", "shingles").repartition("cell").sortWithinPartitions("cell", "digest")
    return ready.mapInArrow(run, "a long, b long")


def _links_of_cells(spark: SparkSession, shelf: Shelf, members: DataFrame, sets: DataFrame, percent: int, cell_elements: int, every: bool) -> DataFrame:
    """members (digest, root, n) and their sets -> verified links that connect every class of every cell."""
    tiles = members.groupBy("root").agg(F.sum("n").alias("total")).select("root", F.ceil(F.col("total") / cell_elements).cast("long").alias("tiles"))
    big = shelf.put(tiles.where("tiles > 1"), "big_cells")
    tiled = members.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles")))
    whole = tiled.join(sets, "digest")
    if not big.isEmpty():
        whole = shelf.put(whole, "cells")
    cell = lambda *c: F.xxhash64(*c)  # noqa: E731  equal names of two cells only put them into one tree
    found = _tree_links(whole.select(cell("root", "tile").alias("cell"), "digest", F.col("digest").alias("label"), "shingles"), percent, every)
    found = shelf.put(found, "links_tiles")
    if big.isEmpty():
        return found
    tiled = shelf.put(whole.join(big.select("root"), "root", "left_semi").dropDuplicates(["digest"]), "big_sets")

    def labelled(links: DataFrame, name: str) -> DataFrame:
        roots = connected_components(spark, links, shelf, name)
        return tiled.join(roots.withColumnRenamed("node", "digest").withColumnRenamed("root", "class"), "digest", "left").withColumn("label", F.coalesce("class", "digest")).drop("class")

    if not every:
        # one set for each class of each tile
        now = labelled(found, "cc_tiles")
        one = now.groupBy("root", "tile", "label").agg(F.min("digest").alias("digest")).select("digest", "root", "label")
        one = one.join(tiled.select("digest", "n", "shingles"), "digest")
        share = one.groupBy("root").agg(F.ceil(F.sum("n") / cell_elements).cast("long").alias("parts"))
        one = one.join(share, "root").withColumn("part", F.pmod(F.xxhash64("label"), F.col("parts")))
        more = _tree_links(one.select(cell("root", "part", F.lit("r")).alias("cell"), "digest", "label", "shingles"), percent, False)
        found = found.unionByName(shelf.put(more, "links_heads"))

    # every set outside its cell's largest class, against all tiles
    now = shelf.put(labelled(found, "cc_heads"), "labelled") if not every else tiled.withColumn("label", F.col("digest"))
    sizes = now.groupBy("root", "label").agg(F.count("*").alias("members"))
    main = sizes.groupBy("root").agg(F.max_by("label", F.struct("members", "label")).alias("main"))
    outside = now.join(main, "root").where("label <> main")
    slices = outside.groupBy("root").agg(F.ceil(F.sum("n") / cell_elements).cast("long").alias("slices"))
    outside = outside.join(slices, "root").withColumn("slice", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("slices")))
    roaming = outside.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    resident = now.join(slices, "root").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("at", F.col("tile"))
    columns = [cell("root", "at", "slice").alias("cell"), "digest", "label", "shingles"]
    last = _tree_links(roaming.select(*columns).unionByName(resident.select(*columns)), percent, every)
    return found.unionByName(shelf.put(last, "links_rest"))


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    percent: int = 80,
    cell_elements: int = 8_000_000,
    heavy_from: int = 4,
    every_link: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: ``id``, ``th`` (hash of the text), ``n_shingles``, ``component_id`` and ``class`` (null
    without shingles), a row per input row.
    links: ``a``, ``b``, verified pairs of set digests; with ``every_link`` all of them, else enough to
    connect each class.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    both = shelf.put(profile(docs, id_col, text_col, words), "profile")
    rows = both.where("block is null").select("id", "th", "n", "digest")
    rarity = spark.sparkContext.broadcast(rarity_ranks(counters.summed(both.where("block is not null").select("block", "salt", "counts"))))
    heavy = spark.sparkContext.broadcast(_heavy(_prefixes(docs, text_col, words, percent, rarity), heavy_from, shelf))
    cells = connected_components(spark, _cell_edges(_prefixes(docs, text_col, words, percent, rarity, heavy), percent), shelf, "cells_cc")
    nodes = shelf.put(cells.unionByName(cells.select(F.col("root").alias("node"), "root")).distinct(), "nodes")
    wanted = spark.sparkContext.broadcast(_filter_of(nodes, nodes.count()))
    sets = _sets(docs, text_col, words, wanted)
    members = nodes.select(F.col("node").alias("digest"), "root").join(rows.where("digest is not null").groupBy("digest").agg(F.first("n").cast("long").alias("n")), "digest")
    links = _links_of_cells(spark, shelf, members, sets, percent, cell_elements, every_link)
    classes = connected_components(spark, links, shelf, "classes")
    named = rows.where("digest is not null").join(classes.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"), "id")
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_digest = shelf.put(named.select("digest", "root").distinct().join(smallest, "root").select("digest", "component_id", F.col("root").alias("class")), "of_digest")
    out = rows.join(of_digest, "digest", "left").select("id", "th", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "class")
    for spent in (rarity, heavy, wanted):
        spent.unpersist()
    shelf.drop("nodes", "cells", "big_sets", "labelled")
    return out, links


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that of the smallest id. Texts without words stay.

    Rows of classes of one pass straight through; a fixed-size filter of the others' text hashes says
    which rows have to meet the table of heads, so few texts are shuffled.
    """
    shelf = Shelf(docs.sparkSession)
    classes, _ = jaccard_classes(docs, id_col, text_col, **options)
    classes = shelf.put(classes.where("class is not null").select("id", "th", "class"), "one_of_each")
    # written, so that a class of many rows can be split in the join
    heads = shelf.put(classes.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("head"), F.count("*").alias("rows")), "heads")
    several = shelf.put(heads.where("rows > 1").select("class"), "several")
    rows = classes.join(several, "class", "left_semi")
    size = 1 << _filter_bits(heads.where("rows > 1").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    bits = docs.sparkSession.sparkContext.broadcast(counters.marked(rows.select(F.col("th").bitwiseAND(F.lit(size - 1)).cast("int")), size))
    th, h_id, h_th, turn = (fresh(docs, name) for name in ("_th", "_head_id", "_head_th", "_turn"))
    named = docs.withColumn(th, F.xxhash64(text_col))
    at = len(docs.columns)

    def part(marked: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                slots = batch.column(at).to_numpy(zero_copy_only=False) & (size - 1)
                yield batch.filter(pa.array(counters.has(bits.value, slots) == marked))

        return named.mapInArrow(run, named.schema)

    own = part(1)
    empty = F.col(text_col).isNull() | ~F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]"))
    heads = heads.select(F.col("head.id").alias(h_id), F.col("head.th").alias(h_th))
    head = own.where(~empty).join(heads, (F.col(th) == F.col(h_th)) & F.col(id_col).cast("long").eqNullSafe(F.col(h_id)), "left_semi")
    # equal rows are one
    head = head.withColumn(turn, F.row_number().over(W.partitionBy(th, id_col).orderBy(F.lit(1)))).where(F.col(turn) == 1).drop(turn)
    return part(0).unionByName(own.where(empty)).unionByName(head).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classes, _ = jaccard_classes(docs)
    return classes.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: Fixed value: 80 percent of the union.
OP4_SQL = r"""
with recursive doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[k : k + n - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - n + 2)) as k from (select *, least(5, len(w)) as n from doc_words where len(w) > 0))),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as m from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * m >= 80 * (p.n + q.n - m)),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id
from documents d left join sizes s using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
"""
