"""N-gram Jaccard join with a MinHash LSH forest.

Every text's set of word n-grams is sketched once; texts with equal sets become one node. Each of
``TREES`` trees holds the nodes' signatures; nodes of equal prefixes form a branch. Prefixes begin at
``DEPTH`` values and are shortened until a pair that lies on the threshold still shares one in some
tree with the chance ``recall``; more similar pairs do so more often. So the recall holds for each pair,
however similar the other pairs of the corpus are.

Nodes that share a branch are gathered by connected component, and the pairs of a component are
verified exactly, by counting common n-grams with a matrix product over the n-grams that two or more of
its texts hold. A component over ``BLOCK`` texts or ``GRAMS`` n-grams is taken apart into its branches
again, and a branch that is still over them into pairs of blocks; a pair of texts counts in the first
branch that it shares. So no task's work grows with a component, and no pair of a branch is left out.

Links are counted where they are found and never listed: what leaves a task is a row for each node,
with the documents that it is linked to and the least node that it hangs together with. So copies, and
groups of near copies of any size, give as many rows as there are documents.

Scale: texts are read twice and shuffled once; of those that share no branch only the id and the set's
hash go on. Sketches take ``4 * TREES * depth`` bytes a text, branches 16 bytes a tree. Sets of n-grams
stand as 64-bit hashes, n-grams as 52-bit ones: a text of 1,000 n-grams has a false common n-gram with
another about once in four billion pairs.

Defined cases: a text of under n words is one n-gram of all its words; a text without words, or a null
one, has no links, is a class of its own and always stays; a null id is an id like others, but no class
is named after it while there is another; rows equal in id and n-gram set count once in ``classes``;
rows of one id with different sets are different documents; a very long text is one like others; of
equal rows ``one_of_each`` keeps one, of documents that tie by id the one of the least text hash; an
empty table gives an empty result. Columns beside the id and the text are never read, and
``one_of_each`` returns them as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components, least_labels
from ._io import forget, table, written
from ._words import Words, mix, slices

N, THRESHOLD, RECALL = 3, 0.6, 0.95
TREES, DEPTH = 16, 6
#: Texts, and n-grams of them, that are compared at once with each other or with as many others.
BLOCK, GRAMS = 2048, 1 << 22
_SEEDS = np.random.default_rng(7).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROWS = 4096  # of a slice, so that a row number fits beside 52 bits of hash


def _grams(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of each row, row by row, and where each row's begin (rows + 1)."""
    words = Words(column)
    count = np.diff(words.first)
    width = np.minimum(count, n)
    at = np.flatnonzero((words.left >= n) | (words.place == 0))
    key = (words.windows(at, width[words.doc[at]]) >> np.uint64(12)) | words.doc[at].astype(np.uint64) << np.uint64(52)
    key = np.unique(key)
    return key & np.uint64((1 << 52) - 1), np.searchsorted(key >> np.uint64(52), np.arange(len(column) + 1))


def _sketch(n: int, depth: int):
    """``doc, same, node, n_grams, roots``: a row's set of n-grams and its branch in each tree; the last
    three are null where a text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", rows=_ROWS):
                grams, first = _grams(part.column("text"), n)
                size = np.diff(first)
                full = np.flatnonzero(size)
                roots = np.zeros((len(full), TREES), np.uint64)
                node = np.zeros(len(size), np.uint64)
                if len(full):
                    begin = first[full]
                    grams = mix(grams)
                    for k, seed in enumerate(_SEEDS[: TREES * depth]):
                        tree = k // depth
                        roots[:, tree] = mix(roots[:, tree] ^ np.minimum.reduceat(grams * seed, begin) >> np.uint64(32) ^ np.uint64(k << 40))
                    node[full] = mix(np.add.reduceat(grams, begin) ^ mix(np.add.reduceat(mix(grams), begin)))
                none = size == 0
                off = np.concatenate([[0], np.cumsum(size > 0)]) * TREES
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("same"), pa.array(node.view(np.int64), mask=none), pa.array(size.astype(np.int32), mask=none), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(roots.reshape(-1).view(np.int64)))],
                    ["doc", "same", "node", "n_grams", "roots"],
                )

    return work


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("text")).withColumn("same", F.xxhash64("text"))


def chance(similarity: float, depth: int) -> float:
    """That a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def _depth(threshold: float, recall: float) -> int:
    """The deepest prefix at which a pair of the threshold's similarity meets the recall."""
    return next((d for d in range(DEPTH, 1, -1) if chance(threshold, d) >= recall), 1)


def _counts(grams: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common n-grams of the texts ``left`` with the texts ``right``."""
    _, code, held = np.unique(grams, return_inverse=True, return_counts=True)
    shared = held[code] > 1
    owner, code = owner[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = max(256, 2**24 // max(1, n))
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [c, c + width])
        held_by = np.zeros((n, min(width, int(code[-1]) + 1 - c)), np.float32)
        held_by[owner[a:b], code[a:b] - c] = 1
        total += held_by[left] @ held_by[right].T
    return total


def _verify(n: int, threshold: float, links: bool):
    """For each unit of a task's rows: with ``links`` a row ``a, b, links, jaccard`` for every node that is
    linked, with the least node that it hangs together with here and the documents it is linked to; else
    a row for every pair."""

    def pairs_of(nodes, cross, roots, tree, grams, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = len(nodes)
        size = np.diff(first)
        owner = np.repeat(np.arange(m), size)
        left, right = (np.flatnonzero(cross == 0), np.flatnonzero(cross == 1)) if (cross >= 0).any() else (np.arange(m),) * 2
        common = _counts(grams, owner, m, left, right)
        jaccard = common / np.maximum(size[left][:, None] + size[right][None, :] - common, 1)
        near = jaccard >= np.float32(threshold) - 1e-6
        if left is right:
            near &= np.tri(m, k=-1, dtype=bool).T
        i, j = np.nonzero(near)
        exact = common[i, j].astype(np.float64)
        i, j = left[i], right[j]
        exact = exact / (size[i] + size[j] - exact)
        ok = exact >= threshold
        if tree:  # a pair counts in the first branch that it shares
            ok &= ~(roots[i, :tree] == roots[j, :tree]).any(1)
        return i[ok], j[ok], exact[ok]

    def rows(nodes, weight, i, j, exact) -> list[np.ndarray]:
        if not links:
            return [nodes[i], nodes[j], np.zeros(len(i), np.int64), exact]
        total = np.zeros(len(nodes), np.int64)
        np.add.at(total, i, weight[j])
        np.add.at(total, j, weight[i])
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        root = least_labels(rank[i], rank[j], len(nodes))
        hit = np.flatnonzero(total)
        return [nodes[hit], nodes[order[root[rank[hit]]]], total[hit], np.zeros(len(hit))]

    def unit(held: list[tuple]) -> list[np.ndarray] | None:
        nodes, cross, weight, roots, grams, size = (np.concatenate([h[k] for h in held]) for k in range(1, 7))
        nodes, first = np.unique(nodes, return_index=True)
        if len(nodes) < 2:
            return None
        if len(first) < len(cross):  # repeated rows of a text
            of = np.repeat(np.arange(len(size)), size)
            grams = grams[np.isin(of, first)]
        cross, weight, roots, size = cross[first], weight[first], roots[first], size[first]
        return rows(nodes, weight, *pairs_of(nodes, cross, roots, held[0][0][3], grams, np.concatenate([[0], np.cumsum(size)])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made: list[list[np.ndarray]] = []
        ready = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*made)]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "links", "jaccard"])

        for batch in batches:
            for part in slices(batch, "text", rows=_ROWS):
                g, first = _grams(part.column("text"), n)
                key = np.stack([part.column(c).to_numpy() for c in _UNIT], 1)
                nodes, cross, weight = (part.column(c).to_numpy() for c in ("node", "side", "docs"))
                roots = part.column("roots").flatten().to_numpy().reshape(part.num_rows, TREES)
                edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), part.num_rows]
                for a, b in itertools.pairwise(edge):
                    this = tuple(key[a].tolist())
                    if held and held[0][0] != this:
                        if (out := unit(held)) is not None:
                            made.append(out)
                            ready += len(out[0])
                        held = []
                        if ready > 10_000:
                            yield flush()
                            ready = 0
                    held.append((this, nodes[a:b], cross[a:b], weight[a:b], roots[a:b], g[first[a] : first[b]], np.diff(first[a : b + 1])))
        if held and (out := unit(held)) is not None:
            made.append(out)
        if made:
            yield flush()

    return work


_UNIT = ("unit", "i", "j", "tree")


def _found(docs: DataFrame, sketch: DataFrame, nodes: DataFrame, n: int, threshold: float, links: bool, block: int) -> tuple[DataFrame, DataFrame]:
    """What ``_verify`` gives for every unit, and the labels of the nodes' components."""
    trie = nodes.select(F.col("node").alias("a"), F.posexplode("roots").alias("tree", "root"))
    # The sum of the members tells branches apart; one that is as another tree's has no pairs of its own.
    mixed = F.sum(F.xxhash64("a") % (1 << 40)).alias("members")
    heads = written(trie.groupBy("tree", "root").agg(F.min("a").alias("head"), F.count("*").alias("size"), mixed).where("size > 1"), "branches")
    edges = trie.join(heads.select("tree", "root", "head"), ["tree", "root"]).where("a != head").select("a", F.col("head").alias("b"))
    labels = components(edges)
    one = written(labels.join(nodes, "node").select("node", "label", "roots", "docs", "n_grams"), "members")
    size = one.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    size = size.select("label", F.ceil(F.greatest(F.col("n") / block, F.col("grams") / GRAMS)).cast("int").alias("parts"))
    sized = one.join(size, "label")
    small = sized.where("parts = 1").select("node", "roots", "docs", F.col("label").alias("unit"), F.lit(0).alias("tree"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"))
    # Large components: a unit for each branch and pair of its blocks.
    large = sized.where("parts > 1").select("node", "roots", "docs", "n_grams", F.posexplode("roots").alias("tree", "root"))
    own = heads.groupBy("members", "size").agg(F.min(F.struct("tree", "root")).alias("x")).select("x.tree", "x.root")
    large = large.join(own, ["tree", "root"])
    sums = large.groupBy("tree", "root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    sums = sums.select("tree", "root", F.ceil(F.greatest(F.col("n") / block, F.col("grams") / GRAMS)).cast("int").alias("parts"))
    large = large.join(sums, ["tree", "root"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("k", x).alias("i"), F.greatest("k", x).alias("j"), F.when(F.col("k") == x, -1).when(F.col("k") > x, 1).otherwise(0).alias("side")))
    large = large.select("node", "roots", "docs", "tree", F.col("root").alias("unit"), F.explode(others).alias("x")).select("node", "roots", "docs", "unit", "tree", "x.*")
    members = small.unionByName(large)
    which = sketch.where("node is not null").groupBy("node").agg(F.min(F.struct("doc", "same")).alias("x")).select("node", "x.*")
    text = _keyed(docs, "doc", "text").join(which.join(one.select("node"), "node").withColumnsRenamed({"doc": "d", "same": "s"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s"))).select("node", "text")
    found = text.join(members, "node").select("unit", "tree", "i", "j", "side", "node", "docs", "roots", "text")
    found = found.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "node")
    return found.mapInArrow(_verify(n, threshold, links), "a long, b long, links long, jaccard double"), labels


def _start(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two columns, the sketch of every row, and the nodes with the documents that each stands for."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    sketch = _keyed(rows, "doc", "text").select("doc", "same", "text").mapInArrow(_sketch(n, _depth(threshold, recall)), "doc long, same long, node long, n_grams int, roots array<long>")
    sketch = written(sketch, "sketch")
    docs_of = sketch.where("node is not null").groupBy("doc", "node").agg(F.first("n_grams").alias("n_grams"), F.first("roots").alias("roots"))
    nodes = docs_of.groupBy("node").agg(F.count("*").alias("docs"), F.first("n_grams").alias("n_grams"), F.first("roots").alias("roots"))
    return rows, sketch, written(nodes, "nodes")


def _classes(rows: DataFrame, sketch: DataFrame, nodes: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """``node, class, links`` of the nodes that are linked to others; the class is a node's."""
    found, _ = _found(rows, sketch, nodes, n, threshold, True, block)
    found = written(found, "links")
    labels = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return links.join(labels, "node").select("node", F.col("label").alias("class"), "links")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``doc_a, doc_b, jaccard`` with ``doc_a < doc_b``: the pairs of different n-gram sets with a Jaccard
    similarity of ``threshold`` or more, each set by the least id that has it, and each further id of a
    set beside that least one, with similarity 1. So copies give as many rows as there are copies. A
    null id is in no pair."""
    rows, sketch, nodes = _start(docs, id_col, text_col, n, threshold, recall)
    pairs, _ = _found(rows, sketch, nodes, n, threshold, False, block)
    held = sketch.where("doc is not null and node is not null").groupBy("doc", "node").agg(F.lit(1).alias("one"))
    least = held.groupBy("node").agg(F.min("doc").alias("first"))
    left, right = least.toDF("a", "x"), least.toDF("b", "y")
    near = pairs.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    member = held.join(least, "node").where("doc != first").select(F.col("first").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(member)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, n_links``: for every document the least id of those that links connect it
    with, its own if there is none, and the number of other documents whose n-gram set has a Jaccard
    similarity of ``threshold`` or more to its own."""
    rows, sketch, nodes = _start(docs, id_col, text_col, n, threshold, recall)
    linked = _classes(rows, sketch, nodes, n, threshold, block)
    held = sketch.groupBy("doc", "node").agg(F.lit(1).alias("one"))
    least = held.where("node is not null").groupBy("node").agg(F.min("doc").alias("least"), F.count("*").alias("docs"))
    named = least.join(linked, "node", "left").withColumn("class", F.coalesce("class", "node"))
    first = named.groupBy("class").agg(F.min("least").alias("class_id"))
    named = named.join(first, "class").select(F.col("node").alias("at"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links")).where("n_links > 0")
    out = held.join(named, F.col("node") == F.col("at"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.when(F.col("at").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The documents without near copies: of each group that links connect, the one of the least id
    (then text hash) stays, and of rows equal in both the first. Texts without words all stay."""
    rows, sketch, nodes = _start(docs, id_col, text_col, n, threshold, recall)
    linked = _classes(rows, sketch, nodes, n, threshold, block)
    held = sketch.where("node is not null").groupBy("doc", "same", "node").agg(F.count("*").alias("rows"))
    best = held.groupBy("node").agg(F.min(F.struct("doc", "same")).alias("x"))
    named = best.join(linked, "node", "left").withColumn("class", F.coalesce("class", "node"))
    first = named.groupBy("class").agg(F.min("x").alias("x"))
    named = named.select("node", "class").join(first, "class").select(F.col("node").alias("at"), "x")
    ruled = held.join(named, F.col("node") == F.col("at")).withColumn("lost", ~(F.col("doc").eqNullSafe(F.col("x.doc")) & (F.col("same") == F.col("x.same"))))
    ruled = written(ruled.where("lost or rows > 1").select(F.col("doc").alias("__lw_doc"), F.col("same").alias("__lw_same"), F.col("lost").alias("__lw_lost")), "lost")
    names = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__lw_row"), F.col(f"`{id_col}`").cast("long").alias("__lw_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__lw_hash"))
    same = F.col("__lw_id").eqNullSafe(F.col("__lw_doc")) & (F.col("__lw_hash") == F.col("__lw_same"))
    left = keyed.join(ruled.where("__lw_lost"), same, "left_anti")
    copied = ruled.where("not __lw_lost")
    if not copied.isEmpty():  # rows equal in id and text
        copied = copied.select("__lw_doc", "__lw_same")
        other = left.join(copied, same, "left_anti")
        again = left.join(copied, same, "left_semi").withColumn("__lw_k", F.row_number().over(Window.partitionBy("__lw_id", "__lw_hash").orderBy(F.to_json("__lw_row"))))
        left = other.unionByName(again.where("__lw_k = 1").drop("__lw_k"))
    forget(sketch, nodes)
    return left.select("__lw_row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, and how many others have a trigram Jaccard similarity of 0.6 or more to it."""
    return classes(table(spark, sf_dir, "documents"))
