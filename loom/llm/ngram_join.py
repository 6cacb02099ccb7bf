"""Near-duplicate join on word shingles by a MinHash LSH forest, with exact verification.

1. Signatures. Texts become sets of 5-word shingles; texts with equal sets are one class. A class has TREES
   min-hash sequences, each a path in a prefix trie.
2. Forest. Two classes are candidates where they share a trie node. Prefixes begin at the deepest level at which a pair just at the
   similarity s shares a node with the target probability, 1 - (1 - s^d)^TREES, and are shortened, a value at a time, until the
   recall measured on the texts themselves reaches the target: while signatures are made, every text is compared
   exactly with SAMPLE texts chosen by hash, and the links found are counted by the longest prefix that the two share. All nodes
   have the same depth then, so a node's size plays no part. The trie is never built: a level is a grouping by the hash of a
   prefix, counted with map-side sums, so a node that holds a third of all classes is one row of each map task.
3. Canonical nodes. A pair that shares several nodes is dealt with in the first tree where it does. Nodes are
   cut into tiles of at most TILE by TILE classes; a light pass over 8-byte node numbers finds which classes
   have a pair to verify in which tile, and only their texts travel there. In crowded tiles, pairs whose sets
   differ too much in size to be similar are left out, which loses none.
4. Verification. A tile counts the shingles that pairs have in common and keeps pairs of similarity >= s,
   computed exactly from the sets. It returns, for each class, how many documents it is linked to, and the
   edges of a spanning forest: no list of pairs is ever written, so a group of n near copies gives n rows.
5. Components of these edges, by rounds of joins in which every vertex takes its smallest neighbour.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import WHITE, met, named, parts_for, ranges, slices, text_of, texts_of, written
from loom.llm.words import mix, shingles_of

SHINGLE, SIMILARITY, TREES, DEEPEST, RECALL = 5, 0.8, 16, 8, 0.995
TILE = 512
#: A node of so many classes or more is crowded; there are at most HOT_NODES of them (16 bytes each), by a higher limit if need be.
LEAST_HOT, HOT_NODES = 1024, 100_000
#: Tiles of more classes compare the sizes of sets before texts travel; this changes no result.
SMALL_NODE = 64
#: Wanted classes up to this many (24 bytes each) are sent to all executors to pick texts; more are joined by a shuffle.
BROADCAST_CLASSES = 300_000


#: Texts chosen by hash (of at most SAMPLE_BYTES each) that all texts are compared with to measure recall, and how many links to
#: them it takes to measure: with fewer the depth is that of the formula, less one.
SAMPLE, SAMPLE_BYTES, LEAST_LINKS = 512, 16_384, 200
#: Shingles that more of the sampled texts hold don't find pairs to compare; they count in the comparison.
COMMON = 32

log = logging.getLogger(__name__)


def depth_for(similarity: float, trees: int, recall: float, deepest: int = DEEPEST) -> int:
    """The deepest prefix at which a pair of that similarity shares a node with probability >= recall."""
    for d in range(deepest, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def min_hashes(s: np.ndarray, offsets: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(texts, k) minima of k hashes over each text's shingles; every text here has some."""
    r = np.random.default_rng(seed)
    a, b = (r.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
    low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, k), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(k):
            out[:, j] = np.minimum.reduceat(low * a[j] + high * b[j], offsets[:-1])
    return out


@dataclass
class Sample:
    """Some texts' sets, none near another, by which recall is measured."""

    shingles: np.ndarray  # ascending; those of at most COMMON texts
    owner: np.ndarray
    rare: np.ndarray  # how many of these each text has
    sets: list[np.ndarray]
    paths: np.ndarray  # (texts, trees, depth)

    def longest(self, text: np.ndarray, s: np.ndarray, starts: np.ndarray, paths: np.ndarray, similarity: float) -> np.ndarray:
        """Numbers of links between the texts given (the sorted sets s, text by text) and sampled ones of other sets, by the
        length of the longest prefix that the two have in common in any tree."""
        out = np.zeros(self.paths.shape[2] + 1, np.int64)
        if not len(self.shingles):
            return out
        first = np.searchsorted(self.shingles, s)
        hit = np.flatnonzero(self.shingles[np.minimum(first, len(self.shingles) - 1)] == s)
        many = np.searchsorted(self.shingles, s[hit], side="right") - first[hit]
        own = np.repeat(text[hit], many)
        other = self.owner[np.repeat(first[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pair, common = np.unique(own * len(self.sets) + other, return_counts=True)
        # of a linked text most of what is rare is shared; the rest is decided exactly
        for p in pair[2 * common >= self.rare[pair % len(self.sets)]]:
            i, j = divmod(int(p), len(self.sets))
            mine, theirs = s[starts[i] : starts[i + 1]], self.sets[j]
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if both < max(len(mine), len(theirs)) or len(mine) != len(theirs):
                if both >= similarity * (len(mine) + len(theirs) - both) - 1e-9:
                    same = np.logical_and.accumulate(paths[i] == self.paths[j], axis=1)
                    out[same.sum(1).max()] += 1
        return out


def sampled(given: DataFrame, total: int, trees: int, depth: int, size: int) -> Sample:
    """SAMPLE texts by hash, equal ones once; of those near each other (half or more in common) the first."""
    some = given.filter(F.octet_length("ng_text") <= SAMPLE_BYTES).filter(F.pmod(F.xxhash64(F.lit(9), "ng_mark"), F.lit(max(1, total))) < SAMPLE)
    texts = some.groupBy("ng_mark").agg(F.first("ng_text").alias("text")).orderBy("ng_mark").limit(2 * SAMPLE).toArrow()
    s, off = shingles_of(texts_of(texts.column("text").combine_chunks()), size) if texts.num_rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    sets = [np.unique(s[off[i] : off[i + 1]]) for i in range(len(off) - 1) if off[i + 1] > off[i]]
    kept: list[int] = []
    if sets:
        n, every = np.array([len(x) for x in sets]), np.arange(len(sets))
        both = common_counts(sets, every, every)
        near = both >= 0.5 * (n[:, None] + n[None, :] - both)
        for i in every:
            if not near[i, kept].any():
                kept.append(int(i))
    sets = [sets[i] for i in kept]
    if not sets:
        return Sample(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros((0, trees, depth), np.uint32))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    paths = min_hashes(flat, np.concatenate([[0], np.cumsum([len(x) for x in sets])]), trees * depth).reshape(len(sets), trees, depth)
    _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
    few = times[back] <= COMMON
    order = np.argsort(flat[few], kind="stable")
    owner = owner[few][order]
    return Sample(flat[few][order], owner, np.bincount(owner, minlength=len(sets)), sets, paths)


def signatures(trees: int, depth: int, size: int, similarity: float, sent):
    """Arrow function: (id, text hash, text) -> (ng_id, ng_mark, ng_set, ng_set2, ng_count, ng_paths): a
    row for each text with words; ng_paths are its paths, `depth` values a tree. A row with ng_count 0 has numbers of
    links to sampled texts by length of prefix instead."""

    def batch(ids: list, marks: list, texts: list[bytes], seen: np.ndarray) -> pa.RecordBatch | None:
        s, off = shingles_of(texts, size)
        has = np.flatnonzero(np.diff(off) > 0)
        if not len(has):
            return None
        starts = np.append(off[has], off[-1])
        # each text's sorted set
        text = np.repeat(np.arange(len(has)), np.diff(starts))
        order = np.lexsort((s, text))
        s, text = s[order], text[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])])
        s, text = s[new], text[new]
        count = np.bincount(text, minlength=len(has))
        starts = np.concatenate([[0], np.cumsum(count)])
        with np.errstate(over="ignore"):
            one = mix(np.add.reduceat(mix(s), starts[:-1]) + count.astype(np.uint64))
            two = mix(np.bitwise_xor.reduceat(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts[:-1]) + np.uint64(1))
            m = min_hashes(s, starts, trees * depth)
        seen += sent.value.longest(text, s, starts, m.reshape(len(has), trees, depth), similarity)
        return rows([ids[i] for i in has], [marks[i] for i in has], one.view(np.int64), two.view(np.int64), count.astype(np.int32), m.view(np.int32))

    def rows(ids, marks, one, two, count, paths: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(paths) + 1, dtype=np.int32) * paths.shape[1]), pa.array(paths.ravel()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(count, pa.int32()), lists],
            names=["ng_id", "ng_mark", "ng_set", "ng_set2", "ng_count", "ng_paths"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(depth + 1, np.int64)
        for b in slices(batches, most=1 << 20):
            out = batch(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), seen)
            if out is not None:
                yield out
        if seen.any():
            yield rows([None], [0], [0], [0], [0], np.minimum(seen, np.iinfo(np.int32).max).astype(np.int32)[None, :])

    return run


def shortened(seen: np.ndarray, deepest: int, recall: float) -> tuple[int, float | None]:
    """(depth, its measured recall) from numbers of links by the longest shared prefix: from `deepest` on, shortened until the links
    that share so long a prefix are `recall` of all. With fewer than LEAST_LINKS nothing is measured, and it is one less."""
    total = int(seen.sum())
    if total < LEAST_LINKS:
        return max(1, deepest - 1), None
    depth = deepest
    while depth > 1 and seen[depth:].sum() < recall * total:
        depth -= 1
    return depth, float(seen[depth:].sum() / total)


def first_shared(left: np.ndarray, right: np.ndarray, tree: int) -> np.ndarray:
    """Which pairs share a node in no tree before `tree`. left (a, TREES), right (b, TREES): node numbers."""
    seen = np.zeros((len(left), len(right)), bool)
    for t in range(tree):
        seen |= left[:, t, None] == right[None, :, t]
    return ~seen


def upper(n_left: int, n_right: int, same: bool) -> np.ndarray:
    """Each unordered pair once: above the diagonal where a block meets itself."""
    return np.triu(np.ones((n_left, n_right), bool), 1) if same else np.ones((n_left, n_right), bool)


def needed(similarity: float, small: int):
    """Group function over a tile: the classes that have a canonical pair here, in tiles of more than `small`
    classes one whose sizes of sets allow the similarity."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tree, side = key[1].as_py(), t.column("side").to_numpy()
        cls, size = t.column("cls").to_numpy(), t.column("size").to_numpy().astype(float)
        nodes = np.array(t.column("nodes").to_pylist(), np.int64).reshape(len(cls), -1)
        same = key[2].as_py() == key[3].as_py()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        ok = first_shared(nodes[left], nodes[right], tree) & upper(len(left), len(right), same)
        if len(cls) > small:
            a, b = size[left][:, None], size[right][None, :]
            ok &= np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6
        wanted = np.unique(np.concatenate([left[ok.any(1)], right[ok.any(0)]]))
        t = t.take(pa.array(wanted))
        kinds = {"node": pa.int64(), "tree": pa.int32(), "i": pa.int32(), "j": pa.int32(), "cls": pa.int64(), "side": pa.int32(), "nodes": pa.list_(pa.int64())}
        return t.select(list(kinds)).cast(pa.schema(list(kinds.items())))

    return run


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) numbers of common elements, by products of 0/1 matrices over the elements that two sets
    at least have; elements are taken in slices of bounded size."""
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[back] > 1
    back, own = back[shared], own[shared]
    _, back = np.unique(back, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(back.max()) + 1 if len(back) else 0
    width = 4096
    order = np.argsort(back, kind="stable")
    back, own = back[order], own[order]
    cuts = np.searchsorted(back, np.arange(0, total + width, width))
    for c in range(len(cuts) - 1):
        b, o = back[cuts[c] : cuts[c + 1]] - c * width, own[cuts[c] : cuts[c + 1]]
        if not len(b):
            continue
        m = np.zeros((len(sets), int(b.max()) + 1), np.float32)
        m[o, b] = 1
        out += m[left] @ m[right].T
    return out


def verified(similarity: float, size: int):
    """Group function over a tile with texts: for each class the documents it is linked to here, and the edges
    of a spanning forest."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tree, same = key[1].as_py(), key[2].as_py() == key[3].as_py()
        side, cls, copies = t.column("side").to_numpy(), t.column("cls").to_numpy(), t.column("copies").to_numpy()
        nodes = np.array(t.column("nodes").to_pylist(), np.int64).reshape(len(cls), -1)
        sets: list[np.ndarray] = []
        texts = t.column("text").combine_chunks()
        for a, z in ranges(texts):
            s, off = shingles_of(texts_of(texts.slice(a, z - a)), size)
            sets += [np.unique(s[off[k] : off[k + 1]]) for k in range(z - a)]
        n = np.array([len(s) for s in sets], np.float64)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        ok = first_shared(nodes[left], nodes[right], tree) & upper(len(left), len(right), same)
        links, parent = np.zeros(len(cls), np.int64), np.arange(len(cls))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if ok.any():
            both = common_counts(sets, left, right)
            # similarity >= s, in whole numbers but for s itself: common >= s * (a + b - common)
            ok &= both >= similarity * (n[left][:, None] + n[right][None, :] - both) - 1e-9
            links[left] += ok.astype(np.int64) @ copies[right]
            links[right] += ok.T.astype(np.int64) @ copies[left]
            # rows of a spanning forest: a class that has already been joined to its first partner's tree adds nothing
            for k in np.flatnonzero(ok.any(1)):
                a = root(left[k])
                for m in np.unique([root(x) for x in right[np.flatnonzero(ok[k])]]):
                    m = root(m)
                    if m != a:
                        parent[max(a, m)] = min(a, m)
                        a = min(a, m)
        at = np.flatnonzero(links)
        roots = np.array([cls[root(i)] for i in at], np.int64)
        return pa.table({"cls": pa.array(cls[at], pa.int64()), "links": pa.array(links[at]), "root": pa.array(roots, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(cls, root): the smallest class of each connected component of edges (a, b); vertices without edges have no row.

    Every round each vertex takes the smallest label among itself and its neighbours, and then its label's
    label, so that paths halve; labels are a written table, and only the number of changes comes to the driver."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, "a").select("a", F.least("l", "m").alias("n"), F.col("l").alias("was"))
        jump = label.select(F.col("a").alias("n"), F.col("l").alias("far"))
        after = written(step.join(jump, "n", "left").select("a", F.least("n", F.coalesce("far", "n")).alias("l"), "was"), "labels")
        if after.filter("l <> was").limit(1).count() == 0:
            return after.select(F.col("a").alias("cls"), F.col("l").alias("root"))
        label = after.select("a", "l")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", similarity=SIMILARITY, size=SHINGLE, trees=TREES, recall=RECALL, broadcast_classes=BROADCAST_CLASSES) -> DataFrame:
    """One row per row of docs: the id, group_id (smallest id of its component of links), copy_id (smallest id
    with the same shingle set), n_links (long: other rows of similarity >= `similarity`, copies included) and
    n_copies (long: rows with the same shingle set).

    Similarity is Jaccard's over sets of `size` words (by 64-bit hashes); words are split at white space. Links are
    verified exactly; one just at the similarity is found with about the probability `recall`, and of all links, as measured on
    a sample, that share is.

    Defined cases: a text of fewer words is one shingle of all its words; null, empty and white texts have
    no shingles and are linked to nothing, each a group of its own; rows with a null id take part, and an id
    that is null is never the smallest of a group beside others; repeated rows are copies of each other;
    an empty table gives an empty one; other columns play no part.
    """
    given, linked = _linked(docs, id_col, text_col, similarity, size, trees, recall, broadcast_classes)
    ids = docs.schema[id_col].dataType
    cast = lambda c: F.col(c).cast(ids)
    out = linked.select(cast("ng_id").alias(id_col), cast("best.id").alias("group_id"), cast("copy_id").alias("copy_id"), (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"))
    alone = given.filter(F.length(F.trim(F.col("ng_text"), F.lit(WHITE))) == 0)
    alone = alone.select(*[cast("ng_id").alias(c) for c in (id_col, "group_id", "copy_id")], F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def representatives(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """One row of each group of links, with all columns of docs, whatever their names: of a group the row with the
    smallest id, of rows with that id the one whose text's hash is smallest.

    Defined cases: as in `near_duplicates`; a null id is chosen only where a group has no other; rows without words
    stay, each id and text once; of rows equal in id and text one stays.
    """
    _, linked = _linked(docs, id_col, text_col, **how)
    # rows that don't stay as they are: those of other ids or texts than the chosen ones, and repeated ones
    seen = linked.select("ng_id", "ng_mark", ((F.col("best.mark") == F.col("ng_mark")) & F.col("best.id").eqNullSafe(F.col("ng_id"))).alias("chosen"))
    odd = written(seen.groupBy("ng_id", "ng_mark").agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not chosen"), "odd")
    place = {c: f"ng_c{i}" for i, c in enumerate(docs.columns)}
    own, text = docs.toDF(*place.values()), text_of(place[text_col])
    own = own.withColumns({"ng_key": F.col(place[id_col]).cast("long"), "ng_hash": F.xxhash64(text), "ng_empty": F.length(F.trim(text, F.lit(WHITE))) == 0})
    both = own.join(odd, F.col("ng_key").eqNullSafe(F.col("ng_id")) & (F.col("ng_hash") == F.col("ng_mark")), "left")
    plain = both.filter("chosen is null and not ng_empty")
    once = both.filter("chosen or ng_empty").dropDuplicates(["ng_key", "ng_hash"])
    return plain.select(*place.values()).unionByName(once.select(*place.values())).toDF(*docs.columns)


def _linked(docs: DataFrame, id_col, text_col, similarity=SIMILARITY, size=SHINGLE, trees=TREES, recall=RECALL, broadcast_classes=BROADCAST_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(ng_id, ng_mark, ng_text of all rows; ng_id, ng_mark, best, copy_id, copies, links of the rows with words). ng_mark is a
    hash of the text; best (none, id, mark) is the row of the group that stands for it."""
    spark = docs.sparkSession
    deepest = depth_for(similarity, trees, recall)
    text = text_of(text_col)
    given = docs.select(named(id_col).cast("long").alias("ng_id"), F.xxhash64(text).alias("ng_mark"), text.alias("ng_text"))
    total = docs.count()
    sent = spark.sparkContext.broadcast(sampled(given, total, trees, deepest, size))
    schema = "ng_id long, ng_mark long, ng_set long, ng_set2 long, ng_count int, ng_paths array<int>"
    made = written(given.mapInArrow(signatures(trees, deepest, size, similarity, sent), schema), "signatures")
    seen = np.zeros(deepest + 1, np.int64)
    for r in made.filter("ng_count = 0").select(F.posexplode("ng_paths").alias("length", "n")).groupBy("length").agg(F.sum("n").alias("n")).collect():
        seen[r["length"]] = r["n"]
    depth, reached = shortened(seen, deepest, recall)
    log.info("prefixes of %d, measured recall %s of %d links", depth, reached, seen.sum())
    rows = made.filter("ng_count > 0")
    nodes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.slice("ng_paths", t * deepest + 1, depth))).alias("ng_nodes")
    same_set = ["ng_set", "ng_set2", "ng_count"]
    # classes of equal sets; their smallest id and their number of rows
    rep = F.min(F.struct(F.col("ng_id").isNull().alias("none"), F.col("ng_id").alias("id"), F.col("ng_mark").alias("mark"))).alias("rep")
    classes = rows.groupBy(*same_set).agg(rep, F.count(F.lit(1)).alias("copies"), F.first("ng_paths").alias("ng_paths"))
    classes = written(classes.select(*same_set, F.xxhash64(*same_set).alias("cls"), "rep", "copies", nodes), "classes")

    # the forest: nodes with at least two classes
    paths = classes.select("cls", F.col("ng_count").alias("size"), F.posexplode("ng_nodes").alias("tree", "node"))
    count = written(paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    # crowded nodes, HOT_NODES at most whatever the input, meet their classes where these lie; the others by a shuffle
    least = max(LEAST_HOT, -(-trees * classes.count() // HOT_NODES))
    hot = F.broadcast(count.filter(F.col("n") >= least))
    few = paths.join(hot.select("node"), "node", "left_anti").join(count.filter(F.col("n") < least), "node")
    found = written(paths.join(hot, "node").unionByName(few.select("node", *paths.columns[:-1], "n")).select("cls", "size", "tree", "node", "n"), "nodes")

    # all node numbers of a class, by tree; a class's own number, which nobody shares, where it has none
    all_nodes = found.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("at"))
    all_nodes = all_nodes.select("cls", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.element_at("at", t), F.xxhash64("cls", t))).alias("nodes"))
    member = found.join(all_nodes, "cls")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(5), "cls"), tiles).cast("int")
    member = member.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    member = member.select("node", "tree", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "cls", "size", "nodes", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    tile = ["node", "tree", "i", "j"]
    # tiles are work for processors, not bytes: their number of partitions is fixed, so that none are put together
    copies = found.agg(F.sum(F.ceil(F.col("n") / TILE))).first()[0] or 0
    n = parts_for(spark, 200 * copies, 4 << 20)
    wanted = written(member.repartition(n, *tile).groupBy(*tile).applyInArrow(needed(similarity, SMALL_NODE), "node long, tree int, i int, j int, cls long, side int, nodes array<long>"), "wanted")

    # one text of each wanted class travels: that of one row of it, found again by id and text hash
    chosen = written(wanted.select("cls").distinct().join(classes.select("cls", F.col("rep.id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"), "copies"), "cls"), "chosen")
    on = F.col("ng_id").eqNullSafe(F.col("rep_id")) & (F.col("ng_mark") == F.col("rep_mark"))
    picked = given.join(F.broadcast(chosen) if chosen.count() <= broadcast_classes else chosen, on).select("cls", "copies", F.col("ng_text").alias("text")).dropDuplicates(["cls"])
    loaded = wanted.join(picked, "cls").select(*tile, "cls", "side", "nodes", "copies", "text")
    got = written(loaded.repartition(n, *tile).groupBy(*tile).applyInArrow(verified(similarity, size), "cls long, links long, root long"), "links")

    links = got.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(got.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    best = comp.join(classes.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("best"))
    of_class = classes.join(links, "cls", "left").join(comp.join(best, "root").select("cls", "best"), "cls", "left")
    of_class = of_class.select(*same_set, F.col("rep.id").alias("copy_id"), F.coalesce("best", "rep").alias("best"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    # a set that many rows have meets them by a broadcast
    return given, met(rows.select("ng_id", "ng_mark", *same_set), of_class, same_set, "copies", total).drop(*same_set)


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import documents

    return near_duplicates(documents(spark, sf_dir))
