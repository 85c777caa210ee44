"""Jaccard join of documents on their sets of word n-grams, by prefix filter and tries.

1. Every shingle's number goes to a bucket, where its documents are counted; what occurs in one document only can be in no intersection, so the others alone go back.
   A document of which fewer than the threshold's share of shingles came back has no partner.
2. Sets are ordered by (document count, number) all over. Two linked sets share a shingle of their prefixes (the first n - ceil(t n) + 1), so they fall into one
   candidate group: a component of the graph of documents and prefix shingles.
3. In a group the sets form a trie, most common shingle first. A set is matched against all others in one walk: common beginnings are counted once, and a subtree ends
   when its overlap and the lengths that remain cannot reach the threshold, or when it is linked already. Large groups are cut into blocks of bounded size.
4. Links give components. Equal sets are joined once, as one representative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .hashing import mix, shingles, slices, words
from .shipping import hot_join, ship, stored

U = np.uint64
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20
#: Shingles in a block of a candidate group, and the sets that every block of a large group is joined with first.
BLOCK_SHINGLES = 2_000_000
PIVOTS = 64

PART = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("numbers", T.BinaryType()), T.StructField("df", T.BinaryType())])


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set of n with any linked set: ceil(t n)."""
    return -(-percent * n // 100)


def spread(docs: DataFrame, id_col: str, text_col: str, size: int, buckets: int) -> DataFrame:
    """PART rows: for each chunk of documents its shingles by bucket; bucket -1 holds the chunk's documents (rows: null flags, numbers: ids, df: set sizes and digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in slices(batch.column(1), CHUNK_BYTES):
                word, owner = words(data, offsets)
                g, row = shingles(word, owner, b - a, size)
                counts = np.bincount(row, minlength=b - a)
                digests = np.zeros((b - a, 2), U)
                if len(g):
                    full = np.flatnonzero(counts)
                    at = (np.cumsum(counts) - counts)[full]
                    digests[full] = np.stack([np.add.reduceat(mix(g + U(k)), at) for k in (1, 2)], 1)
                key = ids.slice(a, b - a)
                bucket = (g >> U(40)) % U(buckets)
                order = np.argsort(bucket, kind="stable")
                g, row, bucket = g[order], row[order].astype(np.uint32), bucket[order]
                bounds = np.searchsorted(bucket, np.arange(buckets + 1))
                there = [k for k in range(buckets) if bounds[k] < bounds[k + 1]]
                parts = lambda x: [x[bounds[k] : bounds[k + 1]].tobytes() for k in there]  # noqa: E731, B023
                facts = np.concatenate([counts.astype(U)[:, None], digests], 1)
                flags, numbers = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy().astype(np.int64)
                columns = [pa.array([-1, *there], pa.int32()), pa.array([chunk] * (1 + len(there)), pa.int64()), pa.array([flags.tobytes(), *parts(row)], pa.binary()), pa.array([numbers.tobytes(), *parts(g)], pa.binary()), pa.array([facts.tobytes(), *[b""] * len(there)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=PART.fieldNames())
                chunk += 1

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, PART)


def shared_only(table: pa.Table) -> pa.Table:
    """Of a bucket the shingles that several documents hold, with their document count (255 at most)."""
    if table["bucket"][0].as_py() < 0:
        return table
    parts = [np.frombuffer(x.as_py(), U) for x in table["numbers"]]
    g = np.concatenate(parts)
    order = np.argsort(g)
    s = g[order]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    lengths = np.diff(np.append(starts, len(s)))
    df = np.empty(len(g), np.uint8)
    df[order] = np.repeat(np.minimum(lengths, 255), lengths)
    rows, numbers, dfs, at = [], [], [], 0
    for part, row in zip(parts, table["rows"], strict=True):
        d = df[at : at + len(part)]
        at += len(part)
        keep = d > 1
        rows.append(np.frombuffer(row.as_py(), np.uint32)[keep].tobytes())
        numbers.append(part[keep].tobytes())
        dfs.append(d[keep].tobytes())
    return pa.table([table["bucket"], table["chunk"], pa.array(rows, pa.binary()), pa.array(numbers, pa.binary()), pa.array(dfs, pa.binary())], names=PART.fieldNames())


SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("shared", T.BinaryType())])


def joined_sets(percent: int):
    """For a chunk: a SETS row for each document; shared (ordered by document count and number) is null where no partner is possible."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"].to_numpy()
        head = int(np.flatnonzero(bucket == -1)[0])
        pick = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for k, x in enumerate(table[name]) if k != head] or [np.zeros(0, kind)])
        ids = np.frombuffer(table["numbers"][head].as_py(), np.int64)
        null = np.frombuffer(table["rows"][head].as_py(), bool)
        facts = np.frombuffer(table["df"][head].as_py(), U).reshape(-1, 3)
        row, g, df = pick("rows", np.uint32), pick("numbers", U), pick("df", np.uint8)
        order = np.lexsort((g, df, row))
        row, g = row[order], g[order]
        n = facts[:, 0].astype(np.int64)
        m = np.bincount(row, minlength=len(ids))
        ends = np.cumsum(m)
        shared = [g[e - k : e].tobytes() if k and k >= needed(c, percent) else None for e, k, c in zip(ends.tolist(), m.tolist(), n.tolist(), strict=True)]
        return pa.table([pa.array(ids, mask=null), pa.array(n), pa.array(facts[:, 1].copy().view(np.int64)), pa.array(facts[:, 2].copy().view(np.int64)), pa.array(shared, pa.binary())], names=SETS.fieldNames())

    return run


def prefix_shingles(percent: int):
    """(id, g) for the shared shingles of each set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for id_, n, shared in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                g = np.frombuffer(shared, np.int64)
                k = n - needed(n, percent) + 1 - (n - len(g))  # shingles of one document come first
                found.append(g[: max(0, k)])
                ids.append(np.full(max(0, k), id_))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["id", "g"])

    return run


class Trie:
    """Sets in the order of their most common member first, as a trie with runs of members on its edges."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        ranked = [np.sort(x) for x in np.split(rank[inverse], cuts)]
        order = sorted(range(len(sets)), key=lambda k: ranked[k].tolist())
        self.sets, self.sizes, self.order = [ranked[k] for k in order], sizes[order], np.array(order)
        self.percent = percent
        self.label = list(range(len(sets)))  # union-find over positions in order
        self.same: list[bool] = []
        self.nodes: list[tuple] = []  # run, first set, end of sets, sizes' least and most, most members below, children
        self.root = self.grow(0, len(sets), 0)

    def grow(self, lo: int, hi: int, depth: int) -> int:
        """The node for sets lo to hi, which share depth members; built without recursion as runs can nest deeply."""
        todo, made = [(lo, hi, depth, -1)], []
        while todo:
            lo, hi, depth, parent = todo.pop()
            first, last = self.sets[lo], self.sets[hi - 1]  # sorted, so what these two share all share
            k = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:k] != last[depth:k])
            end = depth + int(differ[0]) if len(differ) else k
            me = len(self.nodes)
            below = max(len(s) for s in self.sets[lo:hi]) - end
            self.nodes.append((first[depth:end], lo, hi, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), below, []))
            if parent >= 0:
                self.nodes[parent][6].append(me)
            made.append(me)
            at = lo
            while at < hi and len(self.sets[at]) == end:
                at += 1
            while at < hi:
                nxt, a, b = self.sets[at][end], at, hi
                while a < b:  # the end of the sets that go on with nxt
                    mid = (a + b) // 2
                    if self.sets[mid][end] <= nxt:
                        a = mid + 1
                    else:
                        b = mid
                todo.append((at, a, end, me))
                at = a
        return made[0]

    def enough(self, overlap: int, a: int, b: int) -> bool:
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def find(self, x: int) -> int:
        label = self.label
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    def one_class(self, at: int) -> bool:
        """Whether all sets below a node are linked; remembered once they are, as links only grow. Of a large node that is not known, the nodes below are asked."""
        _, lo, hi, *_, children = self.nodes[at]
        if not self.same[at]:
            if hi - lo <= 32 or not children:
                first = self.find(lo)
                self.same[at] = all(self.find(y) == first for y in range(lo + 1, hi))
            else:
                own = self.nodes[children[0]][1] == lo  # no set ends here
                self.same[at] = own and all(self.same[c] for c in children) and len({self.find(self.nodes[c][1]) for c in children}) == 1
        return self.same[at]

    def links(self, queries: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that join all linked sets, as positions in the given list; with queries, of those against all."""
        out = []
        place = np.argsort(self.order)
        self.same = [False] * len(self.nodes)
        for x in range(len(self.sets)) if queries is None else place[queries].tolist():
            mine = self.sets[x]
            size = int(self.sizes[x])
            stack = [(self.root, 0)]
            while stack:
                at, overlap = stack.pop()
                run, lo, hi, least, most, below, children = self.nodes[at]
                if 100 * most < self.percent * size or 100 * size < self.percent * least:
                    continue
                if self.one_class(at) and self.find(lo) == self.find(x):
                    continue
                left = len(mine)
                if len(run):
                    found = np.searchsorted(mine, run)
                    overlap += int((mine[np.minimum(found, len(mine) - 1)] == run).sum())
                    left = len(mine) - int(np.searchsorted(mine, run[-1], "right"))
                elif at != self.root:
                    left = len(mine) - overlap
                if not self.enough(overlap + min(left, below), size, max(least, -(-self.percent * size // 100))):
                    continue
                end = hi if not children else self.nodes[children[0]][1]
                for y in range(lo, end):
                    if self.enough(overlap, size, int(self.sizes[y])) and (a := self.find(y)) != (b := self.find(x)):
                        out.append((int(self.order[x]), int(self.order[y])))
                        self.label[a] = b
                stack += [(c, overlap) for c in children]
        return out


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def trie_links(percent: int):
    """Links of one block; rows with pivot set are there to be met, not to be asked again; rows of one label are linked already."""

    def run(table: pa.Table) -> pa.Table:
        ids, n = table["id"].to_numpy(), table["n"].to_numpy()
        found: list[tuple[int, int]] = []
        if len(ids) > 1:
            trie = Trie([np.frombuffer(x.as_py(), U) for x in table["shared"]], n, percent)
            if "label" in table.column_names:
                first: dict[int, int] = {}
                trie.label = [first.setdefault(v, k) for k, v in enumerate(table["label"].to_numpy()[trie.order].tolist())]
            found = trie.links(np.flatnonzero(table["side"].to_numpy() == 0).tolist() if "side" in table.column_names else None)
        return pa.table([pa.array([int(ids[i]) for i, _ in found], pa.int64()), pa.array([int(ids[j]) for _, j in found], pa.int64())], names=["a", "b"])

    return run


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Components of documents whose sets of word n-grams have a Jaccard index of at least percent / 100.

    Returns a row for each input row: id_col, n_shingles (size of its set), component_id (smallest id reachable by links, itself included).
    The set: distinct shingles of size words; of fewer words the whole sequence; of no words none, and such a document is linked with nothing. Null text counts as empty. Rows with
    a null id get a null component and link nothing. Rows that repeat an id are one document with several texts. Equal sets are linked. Other columns are not
    read. An empty table gives an empty result. ids are cast to long.
    """
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(128, -(-total // BUCKET_BYTES))
    parts = spread(docs, id_col, text_col, size, buckets)
    by_bucket = parts.withColumn("own", F.when(F.col("bucket") < 0, -F.col("chunk") - 1).otherwise(F.col("bucket").cast("long")))
    back = by_bucket.groupBy("own").applyInArrow(lambda t: shared_only(t.drop(["own"])), PART)
    sets = stored(back.groupBy("chunk").applyInArrow(joined_sets(percent), SETS))

    possible = sets.where("shared is not null and id is not null")
    equal = ["d1", "d2", "n"]
    classes = stored(possible.groupBy(*equal).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("shared").alias("shared")))  # equal sets are one
    reps = classes.select("id", "n", "shared")

    postings = reps.mapInArrow(prefix_shingles(percent), T.StructType([T.StructField("id", T.LongType()), T.StructField("g", T.LongType())]))
    postings = stored(postings)
    common = postings.groupBy("g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("g", "least")
    groups = connected_components(postings.join(common, "g").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())

    placed = stored(reps.join(groups, F.col("id") == F.col("node")).select("id", "n", "shared", F.col("component").alias("grp")))
    weight = placed.groupBy("grp").agg(F.sum(F.octet_length("shared") / 8).alias("w"))
    cut = placed.join(weight.withColumn("pieces", F.ceil(F.col("w") / block_shingles)).drop("w"), "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("pieces")))
    own = cut.groupBy("grp", "block").applyInArrow(lambda t: trie_links(percent)(t), LINK)
    large = cut.where("pieces > 1")
    links = own
    if not large.isEmpty():
        # First every block against the same few sets of its group, then the pairs of blocks that are not one component by then.
        order = F.xxhash64("id", F.lit(1))
        first = large.groupBy("grp").agg(F.slice(F.sort_array(F.collect_list(F.when(F.pmod(order, F.col("pieces")) == 0, F.struct(order.alias("o"), "id", "n", "shared")))), 1, PIVOTS).alias("p"), F.first("pieces").alias("pieces"))
        shown = first.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select("grp", "block", F.explode("p").alias("p")).select("grp", "block", "p.id", "p.n", "p.shared", F.lit(1).alias("side"))
        asked = large.select("grp", "block", "id", "n", "shared", F.lit(0).alias("side"))
        links = stored(own.unionByName(asked.unionByName(shown).groupBy("grp", "block").applyInArrow(lambda t: trie_links(percent)(t), LINK)))
        now = connected_components(links)
        labelled = stored(large.join(now, F.col("id") == F.col("node"), "left").select("grp", "block", "id", "n", "shared", F.coalesce("component", "id").alias("label")))
        facts = labelled.groupBy("grp", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
        left, right = facts.select("grp", *(F.col(c).alias(f"{c}_a") for c in ("block", "lo", "hi", "least", "most"))), facts.select("grp", *(F.col(c).alias(f"{c}_b") for c in ("block", "lo", "hi", "least", "most")))
        open_pairs = left.join(right, "grp").where(F.col("block_a") < F.col("block_b")).where("not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)").where(f"100 * most_a >= {percent} * least_b and 100 * most_b >= {percent} * least_a")
        pairs = open_pairs.select("grp", F.concat_ws("-", "block_a", "block_b").alias("pair"), F.explode(F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_b").alias("block"), F.lit(1).alias("side")))).alias("x")).select("grp", "pair", "x.block", "x.side")
        met = pairs.join(labelled, ["grp", "block"]).groupBy("grp", "pair").applyInArrow(lambda t: trie_links(percent)(t), LINK)
        links = links.unionByName(met)
    linked = connected_components(links)
    joined = classes.join(linked, F.col("id") == F.col("node"), "left").select(*equal, F.coalesce("component", "id").alias("c"), "copies")
    final = hot_join(possible.select("id", *equal), joined, equal, "copies", sets.count()).groupBy("id").agg(F.min("c").alias("c"))
    return sets.join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))
