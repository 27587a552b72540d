"""MinHash near-duplicates (op1): bottom-k sketches from one hash function.

1. Each document becomes the set of its word shingles, hashed once; its sketch is the k
   smallest hashes. Documents with equal sets form one class, which is one node below; the
   set names the class, not an id, so texts that share a doc_id are told apart.
2. The inverted lists of the retained values say which nodes overlap. Two linked nodes
   (Jaccard >= 0.8) share at least half of their retained values: the chance that they do
   not is 1.9e-8 at a Jaccard similarity of 0.8 for k = 64, less above it, and none for
   sets that fit into a sketch. So of a node's values only the rarest k - k/2 + 1 are
   needed as keys: some of them lies in every linked node's keys too. Frequent passages
   thus join documents only where they make up more than half of them.
3. All nodes of a list form a cloud around the pivot, the node whose values are the most
   common. Every node is compared with its pivot first. What is linked to it is linked to one another, so only
   nodes that are not go on, and are compared with the cloud: a cloud of near copies takes
   rows in proportion to its nodes. Clouds are cut into blocks of ``BLOCK`` nodes; a task
   holds two blocks at most, whatever the size of the cloud.
4. In a task the sketches give, for all pairs of its nodes at once, an estimate of the
   Jaccard similarity from the part of the union's sketch both know. Pairs estimated below
   0.5 drop out (again a chance of 1.9e-8 for a pair at 0.8).
5. For the rest the full sets are built again from the texts, and a task counts the exact
   intersections. Of the links it finds, it emits those that join nodes it has not joined
   already (a spanning forest).
6. Alternating stars turn the links into components.

No list, cloud or component is ever emitted as all pairs, and nothing is capped: large
groups only become more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.batches import FOLD, U, list_array, mix64, text_blocks, word_spans
from touchpoint.llm.components import components
from touchpoint.llm.stages import free_name, small_batches, written

SHINGLE = 4
NEED, OF = 80, 100  # linked: OF * intersection >= NEED * union
SKETCH = 64
#: Estimates below the threshold by more than this drop a pair: six standard errors.
MARGIN = 0.3
#: Nodes in a block; a task compares two.
BLOCK = 256
#: Elements multiplied at a time.
STRIP = 4096
#: Nodes up to which the ids of documents to verify are broadcast (eight bytes each).
BROADCAST_NODES = 300_000


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random-looking value of every byte and its
    place in the word. (A polynomial modulo 2^64 would give some pairs of long regular words
    equal hashes.)"""
    if not len(starts):
        return np.empty(0, U)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = mix64(((place.astype(U) << U(8)) | data[np.repeat(starts, length) + place]) * U(0x9E3779B97F4A7C15) + U(1))
    return mix64(np.add.reduceat(value, first) + length.astype(U))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block. With fewer words than
    ``size``, the whole sequence is the one shingle; without words there is none."""
    data = FOLD[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    out = []
    n = np.diff(first)
    if len(words) >= size:
        joined = np.zeros(len(words) - size + 1, U)
        for k in range(size):
            joined = mix64(joined * U(31) + words[k : k + len(joined)])
    for d in range(len(n)):
        a = first[d]
        if n[d] >= size:
            out.append(np.unique(joined[a : a + n[d] - size + 1]))
        elif n[d]:
            h = U(int(n[d]))
            for w in words[a : a + n[d]]:
                h = mix64(np.array([h * U(31) + w], U))[0]
            out.append(np.array([h], U))
        else:
            out.append(np.empty(0, U))
    return out


def sketches(docs: DataFrame, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1 and h2 (a 128-bit hash of the set), sketch
    (ascending)."""
    cut = docs.select("doc_id", "text_hash", docs["text"].cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, end, data, offsets in text_blocks(batch, "text"):
                    sets = shingle_sets(data, offsets, size)
                    low = [(s[:k] >> U(1)).astype(np.int64) for s in sets]
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in low])))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(at, end - at),
                            batch.column("text_hash").slice(at, end - at),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([int(mix64(s + U(1)).sum(dtype=U).astype(np.int64)) for s in sets], pa.int64()),
                            pa.array([int(np.bitwise_xor.reduce(mix64(s + U(2)), initial=U(0)).astype(np.int64)) for s in sets], pa.int64()),
                            list_array(np.concatenate(low), ends),
                        ],
                        ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sketch"],
                    )

    return cut.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sketch array<long>")


def clouds(nodes: DataFrame, k: int = SKETCH) -> DataFrame:
    """(pivot, node): the members of each cloud, pivot included. ``nodes``: node, n, sketch."""
    postings = nodes.select("node", "n", F.explode("sketch").alias("value"))
    # counts and pivots are written, so that their joins are with a table and the list of a
    # frequent value can be split over tasks
    shared = written(postings.groupBy("value").agg(F.count("*").alias("c")).where(F.col("c") > 1), "shared")
    common = postings.join(shared, "value")
    kept = F.least(F.first("n"), F.lit(k))
    keys = kept - F.ceil(kept / 2) + 1  # values that cannot all miss the other's half
    lone = kept - F.count("*")  # values in no other node: the rarest of all
    by_node = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("values"), (keys - lone).cast("int").alias("take"), F.sum("c").alias("common"))
    entries = by_node.where(F.col("take") > 0).select("node", "common", F.explode(F.slice("values", F.lit(1), F.col("take"))).alias("e"))
    entries = written(entries.select("node", "common", F.col("e.value").alias("value")), "entries")
    # the text that the others were made from has the most common values, and is near to most
    middle = F.max(F.struct("common", "node"))["node"]
    pivots = written(entries.groupBy("value").agg(middle.alias("pivot"), F.count("*").alias("c")).where(F.col("c") > 1).drop("c"), "pivots")
    return entries.join(pivots, "value").select("pivot", "node").distinct()


def star_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pivot, i, j, node): the nodes of each cloud in blocks i, each with the pivot."""
    others = members.where(F.col("node") != F.col("pivot"))
    sizes = written(others.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "cloud-sizes")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    nodes = others.join(sizes, "pivot").select("pivot", own.alias("i"), "node")
    pivots = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("pivot").alias("node"))
    return nodes.unionByName(pivots).select("pivot", "i", F.lit(0).alias("j"), "node")


def cross_blocks(some: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pivot, i, j, node): each block i of ``some`` nodes of a cloud with each block j of all
    its members."""
    count = lambda df, name: df.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias(name), F.count("*").alias(f"{name}_nodes"))
    sizes = count(some, "si").join(count(members, "sj"), "pivot").where(F.col("sj_nodes") > 1)
    sizes = written(sizes.select("pivot", "si", "sj"), "cloud-sizes")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = some.join(sizes, "pivot").select("pivot", place("si").alias("i"), every("sj").alias("j"), "node")
    columns = members.join(sizes, "pivot").select("pivot", every("si").alias("i"), place("sj").alias("j"), "node")
    return rows.unionByName(columns).distinct()


def by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "node")


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(pivot, nodes, arrays) for each (pivot, i, j) of a sorted partition."""
    key, nodes, arrays = None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "i", "j")), strict=True))
        own = batch.column("node").to_numpy(zero_copy_only=False)
        lists = batch.column(column)
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for r, k in enumerate(keys):
            if k != key:
                if len(nodes) > 1:
                    yield key[0], np.array(nodes), arrays
                key, nodes, arrays = k, [], []
            nodes.append(own[r])
            arrays.append(flat[ends[r] : ends[r + 1]].copy())
    if len(nodes) > 1:
        yield key[0], np.array(nodes), arrays


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets, as a matrix product over
    the elements that occur in several; the diagonal means nothing."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.empty(0, bool)
    element = np.cumsum(new) - 1
    often = np.bincount(element)[element] > 1 if len(flat) else new
    element, owner = element[often], owner[often]
    out = np.zeros((n, n), np.float32)
    if not len(element):
        return out
    element = np.unique(element, return_inverse=True)[1]
    for at in range(0, int(element[-1]) + 1, STRIP):
        a, b = np.searchsorted(element, [at, at + STRIP])
        strip = np.zeros((n, min(STRIP, int(element[-1]) + 1 - at)), np.float32)
        strip[owner[a:b], element[a:b] - at] = 1
        out += strip @ strip.T
    return out


def estimates(low: list[np.ndarray], k: int = SKETCH) -> np.ndarray:
    """Jaccard estimates of all pairs from sketches: below the smaller of two sketches'
    bounds both are complete, so their shared and joint values there are those of the
    union's sketch."""
    shared = intersections(low)
    sizes = np.array([len(x) for x in low])
    bound = np.array([x[-1] if len(x) >= k else np.iinfo(np.int64).max for x in low])
    upto = np.stack([np.searchsorted(x, bound, "right") for x in low])  # values of i within j's bound
    union = np.minimum(upto, sizes[:, None]) + np.minimum(upto.T, sizes[None, :]) - shared
    return shared / np.maximum(union, 1)


def likely_nodes(rows: DataFrame, star: bool, k: int = SKETCH) -> DataFrame:
    """(pivot, node) for nodes whose estimate with another one of their task (``star``: with
    the pivot) is near the threshold."""
    least = NEED / OF - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pivot, nodes, low in groups(batches, "sketch"):
            near = estimates(low, k)
            np.fill_diagonal(near, 0)
            has = nodes[near[nodes == pivot][0] >= least] if star else nodes[(near >= least).any(1)]
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), pivot, np.int64)), pa.array(has.astype(np.int64))], ["pivot", "node"])

    return by_task(rows).mapInArrow(run, "pivot long, node long").distinct()


def star_links(rows: DataFrame) -> DataFrame:
    """(u, v): the pivot and each node of its cloud that is linked to it, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pivot, nodes, sets in groups(batches, "shingles"):
            own = sets[int(np.flatnonzero(nodes == pivot)[0])]
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            both = np.bincount(owner[np.isin(np.concatenate(sets), own)], minlength=len(sets))
            linked = nodes[(both * OF >= (sizes + len(own) - both) * NEED) & (nodes != pivot)]
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(linked), pivot, np.int64)), pa.array(linked.astype(np.int64))], ["u", "v"])

    return by_task(rows).mapInArrow(run, "u long, v long")


def exact_links(rows: DataFrame) -> DataFrame:
    """(u, v): links confirmed on the full sets; a spanning forest of each task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sets in groups(batches, "shingles"):
            both = intersections(sets).astype(np.int64)
            sizes = np.array([len(s) for s in sets])
            linked = np.triu(both * OF >= (sizes[:, None] + sizes[None, :] - both) * NEED, 1)
            parent = np.arange(len(nodes))
            u, v = [], []
            for a, b in zip(*np.nonzero(linked), strict=True):
                ra, rb = _root(parent, a), _root(parent, b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    u.append(nodes[a])
                    v.append(nodes[b])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return by_task(rows).mapInArrow(run, "u long, v long")


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return int(x)


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles). ``nodes``: node, and doc_id and text_hash of a text of that class."""
    n = nodes.count()
    wanted = nodes.select("node", F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    wanted = F.broadcast(wanted) if n <= BROADCAST_NODES else wanted
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))
    chosen = docs.join(wanted, same).select("node", F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, end, data, offsets in text_blocks(batch, "text"):
                    sets = [s.astype(np.int64) for s in shingle_sets(data, offsets, size)]
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                    yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, end - at), list_array(np.concatenate(sets), ends)], ["node", "shingles"])

    # rows that repeat one doc_id and text give the same set each
    return chosen.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def all_links(docs: DataFrame, classes: DataFrame, size: int, k: int) -> DataFrame:
    """(u, v): links of the classes (node, doc_id, text_hash, n_shingles, sketch) whose
    components are those of all links."""
    nodes = classes.select("node", F.col("n_shingles").alias("n"), "sketch")
    texts, sketch = classes.select("node", "doc_id", "text_hash"), nodes.select("node", "sketch")
    members = written(clouds(nodes, k), "clouds")
    near = written(likely_nodes(star_blocks(members).join(sketch, "node"), True, k), "near-pivot")
    wanted = near.select("node").unionByName(near.select(F.col("pivot").alias("node"))).distinct()
    sets = written(full_sets(docs, texts.join(wanted, "node", "left_semi"), size), "sets")
    linked = written(star_links(star_blocks(near).join(sets, "node")), "star-links")
    # nodes beside the pivot that are not linked to it may be linked to other nodes of the cloud
    others = members.where(F.col("node") != F.col("pivot"))
    loose = written(others.join(linked.select(F.col("u").alias("pivot"), F.col("v").alias("node")), ["pivot", "node"], "left_anti"), "loose")
    if not loose.limit(1).count():
        return linked
    likely = written(likely_nodes(cross_blocks(loose, others).join(sketch, "node"), False, k), "likely")
    more = texts.join(likely.select("node").distinct().join(sets, "node", "left_anti"), "node", "left_semi")
    sets = sets.unionByName(written(full_sets(docs, more, size), "more-sets"))
    rest = loose.join(likely, ["pivot", "node"], "left_semi")
    return linked.unionByName(exact_links(cross_blocks(rest, likely).join(sets, "node")))


def judged(docs: DataFrame, size: int, k: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, text_hash): doc_id, text_hash, n_shingles,
    component (a number; null without shingles)."""
    sketched = written(sketches(docs, size, k), "sketches")
    key = ["n_shingles", "h1", "h2"]
    usable = sketched.where(F.col("n_shingles") > 0)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = usable.groupBy(*key).agg(first.alias("r"), F.first("sketch").alias("sketch"))
    # numbers of the written rows, so they stay what they are
    classes = written(classes.select(*key, F.monotonically_increasing_id().alias("node"), "r.doc_id", "r.text_hash", "sketch"), "classes")
    found = written(components(all_links(docs, classes, size, k)), "components")
    labelled = classes.select(*key, "node").join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    return sketched.select("doc_id", "text_hash", *key).join(labelled, key, "left").select("doc_id", "text_hash", "n_shingles", "component")


def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links), kept (doc_id = component_id).

    Null, empty and blank texts have no shingles and link with nothing, not even each
    other. doc_id is an integer; rows that repeat one are judged each by its own text, so
    several texts under one doc_id may lie in several components. A row without a doc_id
    takes no part: its component is null and it is kept. Other columns are ignored. Ties
    cannot occur: the smallest id is unique.
    """
    small_batches(docs.sparkSession)
    keyed = with_text_hash(docs)
    rows = written(judged(keyed.where(F.col("doc_id").isNotNull()), size, k), "judged")
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(written(least, "least-ids"), "component", "left")
    component = F.coalesce("component_id", "doc_id")
    out = named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    if not keyed.where(F.col("doc_id").isNull()).limit(1).count():
        return out
    none = sketches(keyed.where(F.col("doc_id").isNull()), size, k)
    return out.unionByName(none.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: the one of the
    smallest doc_id, of those the one of the smallest text hash, rows without a doc_id last.

    Rows are judged by their own text, so of several texts under one doc_id each stays that
    is no near-duplicate of another row, and copies without a doc_id go too. Of rows that are
    equal in doc_id and text one stays. Texts without words are no copies of one another: of
    them only rows that repeat a doc_id go.
    """
    small_batches(docs.sparkSession)
    rows = written(judged(with_text_hash(docs), size, SKETCH), "judged")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    winners = written(rows.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("w")), "winners")
    lost = rows.join(winners, "component").where(order != F.col("w"))
    key, own, i, h = (free_name(docs, n) for n in ("own_id", "own_hash", "other_id", "other_hash"))
    gone = written(lost.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), "gone")
    same = F.col(key).eqNullSafe(F.col(i)) & (F.col(own) == F.col(h))
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), own: F.xxhash64(F.col("text").cast("string"))})
    left = marked.join(F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone, same, "left_anti")
    again = rows.where("component IS NOT NULL OR doc_id IS NOT NULL").join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(h)), "left_anti")
    again = again.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.count("*").alias("copies")).where("copies > 1")
    again = written(again.select(i, h), "again")
    if not again.limit(1).count():
        return left.select(docs.columns)
    once = left.join(again, same, "left_semi").dropDuplicates([key, own])
    return left.join(again, same, "left_anti").unionByName(once).select(docs.columns)


def oracle_sql(size: int = SHINGLE) -> str:
    """``near_duplicates`` in DuckDB SQL: all pairs that share a shingle, then reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, list_slice(ws, k, k + {size - 1}) AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, least(len(ws), 1)) + 1)) AS k FROM d)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
),
link AS (
  SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
  WHERE {OF} * c >= {NEED} * (a.n + b.n - c)
),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN link l ON l.u = r.seen
),
least_of AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
""".replace("\\\\", "\\")
