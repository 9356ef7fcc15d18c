"""Exact Jaccard join of word-shingle sets, and the groups its links make.

1. Documents with equal sets are one class. Classes meet through prefixes: under one global order of
   shingles (those counted often in some batch last, by count; the others first, by hash) two sets with
   similarity t share l shingles among the first n - ceil(t n) + l of each, for any l. With l a seventh of
   the set, a class that shares fewer prefix shingles with all others together has no link and is left out.
2. All classes that share a shingle of their heads (prefixes for l = 1) go to the block of the smallest of them. So any
   two classes that can be linked meet in some block, and a group of near copies makes a few blocks, not one per shingle.
3. Each block is a trie of its sets, ordered by frequency in the block. A set is looked up by walking the
   trie: paths shared by many sets are counted once, and a subtree is left as soon as the shingles that
   remain cannot bring the overlap up. What reaches a leaf is linked exactly.
4. A large block is divided by hash, and its parts are joined. If that leaves several components, its sets get
   finer blocks: per pair of size bands, where a linked pair overlaps by more than a prefix of any size can ask for,
   and in an order that puts shingles of few open sets first. So pages of one template, which share many shingles but
   not enough, do not meet again. In a finer block, sets outside its largest component are looked up in its parts,
   streamed against one trie at a time.

The order only decides how much work there is: any order gives the same links. Class keys and shingles are
64-bit hashes.

Defined results: null texts and texts without words have empty sets and are linked with nothing (not with
each other either); texts of one to four words have one shingle; repeated rows are rows of their own in the
same component; ids may be null (a component's id is its smallest non-null id); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.collocations import Gate, gate
from tidegrid.llm.common import release, stage
from tidegrid.llm.tokens import distinct, pieces, scramble, shingles
from tidegrid.operators.graph import connected_components

SEEN = 3  # counted so often in a batch, a shingle is reported
FREQUENT = 12  # reported so often in all, it is moved to the end of the order
FREQUENT_KEPT = 500_000  # of these at most; the order of the others is by hash
BLOCK = 256  # sets in one trie
EDGES = np.unique((20 * 1.05 ** np.arange(-62, 400)).astype(np.int64))[1:]  # smallest sizes of the size bands

def _at_least(n):
    """Shared prefix shingles that are asked of a set of ``n``; rises with ``n``."""
    return n // 7 + 1


# similarity >= 4/5, as integers: 9 * overlap >= 4 * (size + size)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _sets(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Piece by piece: first row, rows, sorted distinct shingles, bounds, sizes, class key of each row."""
    for p in pieces(batch["text"]):
        h, bounds = distinct(*shingles(p))
        sizes = np.diff(bounds)
        key = np.zeros(p.rows, dtype=np.uint64)
        if len(h):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(scramble(h + np.uint64(77)), dtype=np.uint64)])
            key = scramble((sums[bounds[1:]] - sums[bounds[:-1]]) + sizes.astype(np.uint64))
        yield p.first, p.rows, h, bounds, sizes, key


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and class key of each row, then the shingles that occur often in this batch."""
    for b in batches:
        every = []
        for first, rows, h, bounds, sizes, key in _sets(b):
            part = b.slice(first, rows)
            yield pa.RecordBatch.from_arrays(
                [part["id"], part["th"], pa.array(sizes, pa.int64()), _i64(key), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                names=["id", "th", "n", "f", "token", "k"])
            every.append(h)
        flat = np.sort(np.concatenate(every)) if every else np.empty(0, dtype=np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, dtype=np.int64)
        count = np.diff(np.append(edge, len(flat)))
        often = edge[count >= SEEN]
        m = len(often)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, b["id"].type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
             _i64(flat[often]), pa.array(count[count >= SEEN], pa.int64())],
            names=["id", "th", "n", "f", "token", "k"])


def _place(h: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """0 for ordinary shingles, 1, 2, ... for frequent ones by rising count."""
    out = np.zeros(len(h), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        known = frequent[at] == h
        out[known] = place[at[known]]
    return out


def _prefixes(sent):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, place = sent.value
        for b in batches:
            seen: set[int] = set()
            for _, rows, h, bounds, sizes, key in _sets(b):
                order = _place(h, frequent, place)
                tokens, keys, lens, needs, heads = [], [], [], [], []
                for r in range(rows):
                    n, k = int(sizes[r]), int(key[r])
                    if not n or k in seen:
                        continue
                    seen.add(k)
                    mine, o = h[bounds[r]: bounds[r + 1]], order[bounds[r]: bounds[r + 1]]
                    least = (4 * n + 4) // 5
                    p = min(n, n - least + _at_least(n))
                    plain = mine[o == 0]
                    if len(plain) < p:
                        late = o > 0
                        plain = np.concatenate([plain, mine[late][np.argsort(o[late], kind="stable")]])
                    tokens.append(plain[:p])
                    keys.append(k)
                    lens.append(p)
                    needs.append(_at_least(least))
                    heads.append(np.arange(p) <= n - least)
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [_i64(np.concatenate(tokens)), _i64(np.repeat(np.array(keys, dtype=np.uint64), lens)),
                         pa.array(np.repeat(np.array(needs, dtype=np.int32), lens)), pa.array(np.concatenate(heads))],
                        names=["token", "f", "need", "head"])

    return task


def _full_sets(sent):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Gate(sent.value)
        for b in batches:
            seen: set[int] = set()
            for _, rows, h, bounds, sizes, key in _sets(b):
                take = (sizes > 0) & wanted(key)
                keys, sets = [], []
                for r in np.flatnonzero(take):
                    if int(key[r]) not in seen:
                        seen.add(int(key[r]))
                        keys.append(key[r])
                        sets.append(h[bounds[r]: bounds[r + 1]])
                if keys:
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                    yield pa.RecordBatch.from_arrays(
                        [_i64(np.array(keys, dtype=np.uint64)),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _i64(np.concatenate(sets)))], names=["f", "tokens"])

    return task


class Trie:
    """Compressed trie of shingle sets whose elements are ranked by their frequency among the sets."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        self.vocabulary, where, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), dtype=np.int64)
        rank[np.lexsort((self.vocabulary, -count))] = np.arange(len(count))
        self.rank = rank
        ends = np.cumsum([len(s) for s in sets])
        self.ranked = [np.sort(rank[w]) for w in np.split(where, ends[:-1])]
        order = sorted(range(len(sets)), key=lambda i: self.ranked[i].astype(">u4").tobytes())
        rows = [self.ranked[i] for i in order]
        common = [0]
        for a, b in zip(rows, rows[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.common = np.array(common + [0])
        size = np.array([len(r) for r in rows])
        # node: labels, depth at its end, smallest and largest set below, sets that end here, children
        self.nodes: list[tuple] = []
        root: list[int] = []
        todo = [(0, len(rows), 0, root)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = int(size[lo]) if hi - lo == 1 else int(min(self.common[lo + 1: hi].min(), size[lo:hi].min()))
            children: list[int] = []
            here = [order[i] for i in range(lo, hi) if size[i] == end]
            parent.append(len(self.nodes))
            self.nodes.append((rows[lo][depth:end], end, int(size[lo:hi].min()), int(size[lo:hi].max()), here, children))
            start = lo + len(here)  # sets that end here sort before longer ones
            while start < hi:
                stop = start + 1
                while stop < hi and self.common[stop] > end:
                    stop += 1
                todo.append((start, stop, end, children))
                start = stop
        self.root = root

    def ranks_of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        return np.sort(self.rank[at[self.vocabulary[at] == tokens]])

    def matches(self, ranks: np.ndarray, n: int) -> Iterator[int]:
        """Sets whose similarity with a set of ``n`` shingles (``ranks``: those known here) is 4/5 or more."""
        mark = np.zeros(len(self.rank), dtype=bool)
        mark[ranks] = True
        todo = [(i, 0) for i in self.root]
        while todo:
            i, overlap = todo.pop()
            label, end, least, most, here, children = self.nodes[i]
            left = len(ranks)
            if len(label):
                overlap += int(np.count_nonzero(mark[label]))
                left -= int(np.searchsorted(ranks, label[-1], side="right"))
            if 9 * (overlap + min(left, most - end)) < 4 * (n + least):
                continue
            if here and 9 * overlap >= 4 * (n + end):
                yield from here
            todo += [(c, overlap) for c in children]


class Forest:
    """Joined sets, and only those links that joined something new."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside sorted blocks: of the block's own sets, or of streamed probes with them.

    Rows: block (leader, part), probe (0 or 1; own sets first), f, c (component so far), tokens. Without
    probes a block is joined with itself. A probe gives one link for each other component that it meets.
    """
    block, keys, comps, sets, trie, links, probed = None, [], [], [], None, [], False

    def own() -> None:
        forest, t = Forest(len(keys)), Trie(sets)
        for i, ranks in enumerate(t.ranked):
            for j in t.matches(ranks, len(ranks)):
                if forest.join(i, j):
                    links.append((keys[i], keys[j]))

    def drain() -> Iterator[pa.RecordBatch]:
        if links:
            a, c = zip(*links)
            links.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["src", "dst"])

    for b in batches:
        leader, part, probe, f, comp = (b[c].to_pylist() for c in ("leader", "part", "probe", "f", "c"))
        tokens = b["tokens"]
        flat, ends = tokens.flatten().to_numpy().view(np.uint64), tokens.offsets.to_numpy()
        ends = ends - ends[0]
        for i in range(b.num_rows):
            if block != (leader[i], part[i]):
                if len(keys) > 1 and not probed:
                    own()
                block, keys, comps, sets, trie, probed = (leader[i], part[i]), [], [], [], None, False
            mine = flat[ends[i]: ends[i + 1]]
            if not probe[i]:
                keys.append(f[i])
                comps.append(comp[i])
                sets.append(mine.copy())
                continue
            probed = True
            if not keys:
                continue
            if trie is None:
                trie = Trie(sets)
            met = {comp[i]}
            for j in trie.matches(trie.ranks_of(mine), len(mine)):
                if comps[j] not in met:
                    met.add(comps[j])
                    links.append((f[i], keys[j]))
        yield from drain()
    if len(keys) > 1 and not probed:
        own()
    yield from drain()


def _links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Run the join over (leader, part, probe, f, c) rows."""
    full = blocks.join(sets, "f").select("leader", "part", "probe", "f", "c", "tokens")
    return full.repartition("leader", "part").sortWithinPartitions("leader", "part", "probe").mapInArrow(
        _join_blocks, "src long, dst long")


def components(links: DataFrame) -> DataFrame:
    """(f, c): the component of every class that has a link."""
    ends = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    return connected_components(ends, links).select(F.col("id").alias("f"), F.col("component").alias("c"))


def _finer(order, shared):
    """Prefix shingles of each set for each pair of size bands in which it can have a link.

    Sets in bands from ``x`` and ``y`` up overlap by 4/9 (x + y) at least. Both prefixes leave all but ``need`` of
    that overlap out, so linked sets share ``need`` shingles there, and one within their heads. A shingle that only one
    set holds takes its place in the prefix, but is not passed on.
    """

    def entries(tokens: np.ndarray, known: Gate, frequent: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        n = len(tokens)
        rank = np.where(known(tokens), 1 + _place(tokens, frequent, place), 0)
        by = np.lexsort((tokens, rank))
        ranked, several = tokens[by], rank[by] > 0
        band, low, high = (int(x) - 1 for x in np.searchsorted(EDGES, [n, (4 * n + 4) // 5, 5 * n // 4], side="right"))
        for other in range(low, high + 1):
            x, y = int(EDGES[min(band, other)]), int(EDGES[max(band, other)])
            least = -(-4 * (x + y) // 9)
            need = min(x // 20 + 1, least)
            if n >= least:
                at = np.flatnonzero(several[: n - least + need])
                yield min(band, other), max(band, other), ranked[at], need, at <= n - least, band

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (frequent, place) = Gate(shared.value), order.value
        for b in batches:
            f, c = (b[x].to_numpy() for x in ("f", "c"))
            flat, ends = b["tokens"].flatten().to_numpy().view(np.uint64), b["tokens"].offsets.to_numpy()
            ends = ends - ends[0]
            for i in range(b.num_rows):
                found = [x for x in entries(flat[ends[i]: ends[i + 1]], known, frequent, place) if len(x[2])]
                if found:
                    low, high, tokens, need, head, band = zip(*found)
                    lens = [len(t) for t in tokens]
                    m = sum(lens)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(low, lens), pa.int32()), pa.array(np.repeat(high, lens), pa.int32()),
                         pa.array(np.repeat(band, lens), pa.int32()), _i64(np.concatenate(tokens)), pa.array(np.full(m, f[i])),
                         pa.array(np.full(m, c[i])), pa.array(np.repeat(need, lens), pa.int32()), pa.array(np.concatenate(head))],
                        names=["low", "high", "band", "token", "f", "c", "need", "head"])

    return task


def finer_blocks(members: DataFrame, sets: DataFrame, block: int = BLOCK, frequent: int = FREQUENT_KEPT) -> DataFrame:
    """Rows (leader, part, probe, f, c) that bring all linked ``members`` (f, c) of different components together."""
    spark = members.sparkSession
    held = stage(sets.join(members, "f").select("f", "c", "tokens"), "shingle-open-sets")
    counts = stage(held.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "shingle-open-counts")
    shared, order = gate(counts.select(F.col("token").alias("h"))), spark.sparkContext.broadcast(_frequent(counts, frequent))
    made = "low int, high int, band int, token long, f long, c long, need int, head boolean"
    entries = stage(held.mapInArrow(_finer(order, shared), made), "shingle-open-prefixes")
    shared.unpersist()
    order.unpersist()

    def met_by(rows: DataFrame) -> DataFrame:
        """Shingles that can make a link: held in both bands of the pair, and by sets of two components."""
        ends = rows.groupBy(*pair, "token").agg(F.min("f").alias("leader"), *[f(x).alias(f"{k}_{x}") for x in ("c", "band") for k, f in (("least", F.min), ("most", F.max))])
        return ends.where("least_c < most_c and least_band = low and most_band = high").select(*pair, "token", "leader")

    pair = ["low", "high"]
    live = stage(entries.join(met_by(entries), [*pair, "token"], "left_semi"), "shingle-open-shared")
    enough = live.groupBy(*pair, "f").agg(F.count("*").alias("m"), F.max("need").alias("need")).where("m >= need").select(*pair, "f")
    heads = stage(live.where("head").join(enough, [*pair, "f"], "left_semi").drop("need", "head"), "shingle-open-heads")
    met = heads.join(met_by(heads), [*pair, "token"]).select(F.xxhash64(*pair, "leader").alias("leader"), "f", "c").distinct()
    met = stage(met, "shingle-open-blocks")
    for used in (held, counts, entries, live, heads):
        release(used)
    sizes = met.groupBy("leader", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("leader").agg(
        F.max_by("c", F.struct("m", "c")).alias("main"), F.ceil(F.sum("m") / block).cast("int").alias("parts"),
        F.count("*").alias("comps")).where("comps > 1")
    mixed = met.join(main, "leader")
    own = mixed.select("leader", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("probe"), "f", "c")
    probes = mixed.where("c <> main").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("probe"), "f", "c")
    return own.unionByName(probes)


def linked_in_blocks(met: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links between the sets of each block; ``met`` has (leader, f), ``sets`` has (f, tokens)."""
    parts = met.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    blocks = met.join(parts, "leader").select(
        "leader", "parts", "f", F.explode(F.when(F.col("f") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")))).alias("part"))
    zero = F.lit(0).cast("long").alias("c")
    found = stage(_links(blocks.select("leader", "part", F.lit(0).alias("probe"), "f", zero), sets), "shingle-links")
    divided = blocks.where("parts > 1").select("leader", "f")
    if divided.isEmpty():
        return found
    divided = stage(divided.join(components(found), "f", "left").withColumn("c", F.coalesce("c", "f")), "shingle-divided")
    several = divided.groupBy("leader").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("leader")
    members = stage(divided.join(several, "leader", "left_semi").select("f", "c").distinct(), "shingle-open")
    every = stage(found.unionByName(_links(finer_blocks(members, sets, block), sets)), "shingle-links")
    for used in (found, divided, members):
        release(used)
    return every


def sets_of(keys: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """Sets (f, tokens) of the ``keys`` (f), once each, out of ``made`` by :func:`_full_sets` or its like."""
    return stage(made.groupBy("f").agg(F.first("tokens").alias("tokens")).join(keys, "f", "left_semi"), name)


def profile(df: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, n, f): id, hash of the text, set size, class key; and the table of often counted shingles."""
    rows = df.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    got = stage(rows.mapInArrow(_profile, f"id {kind}, th long, n long, f long, token long, k long"), "shingle-profile")
    return got.where("n is not null").select("id", "th", "n", "f"), got.where("n is null").select("token", "k")


def _frequent(counts: DataFrame, kept: int) -> tuple[np.ndarray, np.ndarray]:
    top = (
        counts.groupBy("token").agg(F.sum("k").alias("k")).where(F.col("k") >= FREQUENT)
        .orderBy(F.desc("k"), "token").limit(kept).toPandas()
    )
    token, k = top["token"].to_numpy(dtype=np.int64).view(np.uint64), top["k"].to_numpy(dtype=np.int64)
    place = np.empty(len(token), dtype=np.int64)
    place[np.lexsort((token, k))] = np.arange(1, len(token) + 1)
    order = np.argsort(token)
    return token[order], place[order]


def _shared(entries: DataFrame) -> DataFrame:
    """(token, leader) of shingles that several classes hold; the leader is the smallest of them."""
    ends = entries.groupBy("token").agg(F.min("f").alias("leader"), F.max("f").alias("last"))
    return ends.where("leader < last").select("token", "leader")


def links(df: DataFrame, counts: DataFrame, text: str = "text", block: int = BLOCK, frequent: int = FREQUENT_KEPT) -> DataFrame:
    """Links (src, dst) of class keys: enough of them to connect all classes that links connect."""
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(_frequent(counts, frequent))
    entries = stage(rows.mapInArrow(_prefixes(order), "token long, f long, need int, head boolean"), "shingle-prefixes")
    live = entries
    for _ in range(2):  # leaving classes out can leave others without partners
        some = stage(live.join(_shared(live).select("token"), "token", "left_semi"), "shingle-shared")
        release(live)
        enough = some.groupBy("f").agg(F.count("*").alias("m"), F.max("need").alias("need")).where("m >= need").select("f")
        live = stage(some.join(enough, "f", "left_semi"), "shingle-live")
        release(some)
    heads = live.where("head").select("token", "f")
    met = stage(heads.join(_shared(heads), "token").select("leader", "f").distinct(), "shingle-blocks")
    release(live)
    # A bitmap of fixed size leaves most other texts out inside the tasks; the join leaves out the rest.
    keys = met.select("f").distinct()
    wanted = gate(keys.select(F.col("f").alias("h")))
    sets = sets_of(keys, rows.mapInArrow(_full_sets(wanted), "f long, tokens array<long>"), "shingle-sets")
    wanted.unpersist()
    found = linked_in_blocks(met, sets, block)
    release(sets)
    release(met)
    return found


def groups(df: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of ``df``: id, th (hash of the text), n_shingles, component (of class keys), component_id."""
    docs, counts = profile(df, id, text)
    roots = components(links(df, counts, text, **how))
    classes = docs.where("n > 0").groupBy("f").agg(F.min("id").alias("low")).join(roots, "f", "left").select(
        "f", "low", F.coalesce("c", "f").alias("c"))
    lows = classes.groupBy("c").agg(F.min("low").alias("low"))
    named = classes.select("f", "c").join(lows, "c")
    return docs.withColumn("f", F.when(F.col("n") > 0, F.col("f"))).join(named, "f", "left").select(
        "id", "th", F.col("n").alias("n_shingles"), F.col("c").alias("component"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"))


def one_per_group(df: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` whose text represents its group: the first by (id, hash of the text).

    Rows without words stay, each id once per text; of rows that repeat an id and its text one stays.
    """
    got = groups(df, id, text, **how)
    first = got.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "th")).alias("k")).select("k.*")
    keep = stage(first.unionByName(got.where("component is null").select("id", "th").distinct()), "shingle-kept")
    again = got.groupBy("id", "th").agg(F.count("*").alias("m")).where("m > 1").select("id", "th")
    rows = df.withColumn("_th", F.xxhash64(text))
    same = lambda k: (rows[id].eqNullSafe(k["id"])) & (rows["_th"] == k["th"])
    kept = rows.join(keep, same(keep), "left_semi")
    again = stage(keep.join(again, keep["id"].eqNullSafe(again["id"]) & (keep["th"] == again["th"]), "left_semi"), "shingle-repeated")
    if again.isEmpty():
        return kept.drop("_th")
    once = kept.join(again, kept[id].eqNullSafe(again["id"]) & (kept["_th"] == again["th"]), "left_anti")
    several = kept.join(again, kept[id].eqNullSafe(again["id"]) & (kept["_th"] == again["th"]), "left_semi")
    return once.unionByName(several.dropDuplicates([id, "_th"])).drop("_th")
