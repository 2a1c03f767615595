"""Exact Jaccard self-join of documents on word shingles, as a grouped prefix join.

A link needs 100 * |x & y| >= 80 * |x | y|.  The work is done in two parts.

*Which documents can have a partner at all?*  The shingles of a set are sorted by hash, and
neighbours in that order make pairs.  A shingle that only x has breaks two pairs of x, one that
only y has breaks one; so with 80 percent at most D = 0.4 n of the n - 1 pairs of x are missing
in y.  By the prefix lemma the first D + l pairs of either (in the order of their hashes) share
at least l.  A document of whose prefix fewer pairs occur in any other prefix is out.  Unrelated
documents have many shingles in common but hardly any pairs, at any size of the corpus.  Equal
sets meet as one node, and a slice of documents settles the pairs that are common within it, so
none brings more than one row a slice to the exchange, however many documents have it.

*Grouped prefix join of the rest.*  Their shingles are put in the order of rising frequency, and
shingles that only one document has are taken out; they can be in no intersection, so a document
with too few others is out, and the size of a partner is bounded from both sides.  Nodes with
identical prefixes and size are one group.  Groups that meet in the list of a prefix shingle are
candidates if their sizes fit.  Pairs are expanded and verified in two steps so that a list of
thousands of near copies costs no square (where in its list a node stands bounds the size of its
partners there, since all that two sets share stands behind the first shingle they share): first every member against the most central member of
the list; the links found give components, and then only members of different components of a
list are compared, those outside its main component against all others.  Links within a
component would not change the result.

Sets, words and shingles are told apart by 64-bit hashes.  Null texts and texts without words
have no shingles and link with nothing; with fewer words than a shingle has, the whole sequence
is the one shingle.  Rows without an id get a null component and link nothing.  Rows with the
same id are one document where a component is named.  An empty table gives an empty result.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import text_slices
from lurewatch.llm.components import components
from lurewatch.session import stage

SHINGLE_WORDS = 5
# A link needs PERCENT * |union| <= 100 * |intersection|.
PERCENT = 80
# Size of the bitmap of documents that may have a partner.
MARKS = 1 << 24
# Pairs that prefixes must share, as a part of the set.
SHARED_PART = 0.05

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    pa.set_cpu_count(1)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if "" in distinct:  # what leading and trailing white space leaves
        real = index != distinct.index("")
        before = np.concatenate([[0], np.cumsum(real)])
        index, bounds = index[real], before[bounds]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct] or [0], np.uint64)[index]
    rolled = hashes[: max(0, len(hashes) - size + 1)].copy()
    for back in range(1, size):
        rolled *= _ODD
        rolled += hashes[back : back + len(rolled)]
    rolled ^= rolled >> np.uint64(32)
    rolled *= _MIX
    rolled ^= rolled >> np.uint64(29)
    rolled = rolled.view(np.int64)
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= size:
            row = np.sort(rolled[begin : end - size + 1])
            out.append(row[np.concatenate([[True], row[1:] != row[:-1]])])
        elif end > begin:
            whole = xxhash.xxh3_64_intdigest(hashes[begin:end].tobytes(), seed=end - begin)
            out.append(np.array([whole], np.uint64).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _broken(n: int) -> int:
    """The most pairs of a set of ``n`` that a linked set can lack.

    With i common shingles these are 2 (n - i) + (m - i) for a partner of size m; a link needs
    i >= c (n + m) and m >= n * PERCENT / 100.
    """
    c = PERCENT / (100 + PERCENT)
    return int(n * ((2 - 3 * c) + (1 - 3 * c) * PERCENT / 100) + 1e-9)


def _wanted(n: int) -> int:
    return max(1, int(SHARED_PART * n))


def neighbour_pairs(shingles: np.ndarray) -> np.ndarray:
    """The prefix of the pairs of a sorted set, in the order of their hashes."""
    if len(shingles) < 4:  # a smaller set links with equal sets only
        return shingles[:0]
    left = shingles[:-1].view(np.uint64) * _ODD
    left += shingles[1:].view(np.uint64)
    left ^= left >> np.uint64(31)
    left *= _MIX
    pairs = np.sort(left.view(np.int64))
    return pairs[: _broken(len(shingles)) + _wanted(len(shingles))]


def _nodes(docs: DataFrame) -> DataFrame:
    """``doc_id, node, n`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            known = batch.column("doc_id").is_valid().to_pylist()
            nodes = [_node(s) if len(s) and k else None for s, k in zip(sets, known, strict=True)]
            arrays = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "n"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, node long, n long")


def _entries(docs: DataFrame) -> DataFrame:
    """``pair, node, weight``: what a slice of documents cannot settle by itself.

    A pair that one node of the slice has is a row of weight 1.  A pair that several have is one
    row without a node; that these nodes share it is settled, and how many pairs of a node are
    settled is a row of that negative weight, under the node's own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = {_node(s): s for s in shingle_sets(batch.column("text")) if len(s)}
            prefixes = {node: neighbour_pairs(s) for node, s in sets.items()}
            nodes = np.repeat(np.array(list(prefixes), np.int64), [len(p) for p in prefixes.values()])
            if not len(nodes):
                continue
            pairs = np.concatenate(list(prefixes.values()))
            values, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            settled = counts[inverse] > 1
            some, how_many = np.unique(nodes[settled], return_counts=True)
            common = values[counts > 1]
            pair = np.concatenate([pairs[~settled], common, some])
            node = np.concatenate([nodes[~settled], np.zeros(len(common), np.int64), some])
            weight = np.concatenate([np.ones(int((~settled).sum()), np.int64), np.zeros(len(common), np.int64), -how_many])
            arrays = [pa.array(pair), pa.array(node, mask=weight == 0), pa.array(weight.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["pair", "node", "weight"])

    return docs.filter("doc_id is not null").mapInArrow(run, "pair long, node long, weight int")


def _partnered(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, first_doc`` of the nodes whose prefix shares enough with other prefixes."""
    # A pair has one row for each slice at most.
    of_pair = Window.partitionBy("pair")
    low, high = F.min("node").over(of_pair), F.max("node").over(of_pair)
    common = F.min("weight").over(of_pair) == 0
    seen = (
        _entries(docs).withColumn("shared", (low != high) | common)
        .filter("weight < 0 or (weight = 1 and shared)")
        .groupBy("node").agg(F.sum(F.abs("weight")).alias("met"))
    )
    sets = nodes.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("first_doc")
    )
    smallest = F.ceil(F.col("n") * PERCENT / 100)
    wanted = F.greatest(F.lit(1), F.floor(smallest * SHARED_PART))
    return sets.join(seen, "node").filter(F.col("met") >= wanted).select("node", "n", "first_doc")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, shingles`` of the wanted nodes, from the text of their first document."""
    # Most texts are told to be none of them before any text moves, by a bitmap of id hashes: at
    # most MARKS / 64 rows however many nodes there are, so it can be sent to every task.
    mark = F.pmod(F.xxhash64("first_doc"), F.lit(MARKS))
    word, bit = F.shiftright(mark, 6), (mark % 64).cast("int")
    words = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    rows = docs.select(F.col("doc_id").alias("first_doc"), "text").withColumns({"word": word, "bit": bit})
    rows = rows.join(F.broadcast(words), "word").filter("shiftright(bits, bit) & 1 = 1").select("first_doc", "text")
    rows = rows.join(wanted.select("first_doc", "node"), "first_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            asked = batch.column("node").to_pylist()
            # Another text under the same id is not the one.
            keep = [i for i, s in enumerate(sets) if len(s) and _node(s) == asked[i]]
            arrays = [
                pa.array([asked[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()),
                pa.array([sets[i] for i in keep], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, n long, shingles array<long>")


def _by_frequency(sets: DataFrame) -> DataFrame:
    """``node, n, m, shared``: the m shared shingles of a node, rarest first, if they can be
    enough for a link."""
    rows = sets.select(F.explode("shingles").alias("shingle"), "node", "n")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    shared = rows.join(often, "shingle").groupBy("node", "n").agg(
        F.array_sort(F.collect_set(F.struct("often", "shingle"))).alias("s")
    )
    m = F.size("s").cast("long")
    return shared.select("node", "n", m.alias("m"), F.col("s.shingle").alias("shared")).filter(
        100 * F.col("m") >= PERCENT * F.col("n")
    )


def _most(common):
    """The largest partner with which ``common`` shared shingles can make a link."""
    return F.floor((100 + PERCENT) * common / PERCENT - F.col("n"))


def _fits(a: str, b: str):
    """Whether the sizes of two sets allow a link, given what they can share at most."""
    return F.expr(
        f"{PERCENT} * greatest({a}.n, {b}.n) <= 100 * least({a}.n, {b}.n) and {a}.n <= {b}.most and {b}.n <= {a}.most"
    )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs (a, b)``, by the whole intersection."""
    of = lambda end: sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("shared").alias(f"s_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    met = F.size(F.array_intersect("s_a", "s_b"))
    linked = (100 + PERCENT) * met >= PERCENT * (F.col("n_a") + F.col("n_b"))
    return both.filter(linked).select("a", "b")


def links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links between nodes that connect all that link, and the components they give."""
    needed = F.ceil(F.col("n") * PERCENT / 100)
    prefix = F.slice("shared", F.lit(1), (F.col("m") - needed + 1).cast("int"))
    # Identical prefix and size (which give m as well): one group.
    members = stage(
        sets.select("node", "n", "m", prefix.alias("prefix"), F.xxhash64(prefix, "n").alias("gid")), "members"
    )
    central = F.min("node")
    groups = members.groupBy("gid", "prefix", "n", "m").agg(central.alias("central"))
    # All that a node shares with one that it first meets in this list stands from here on.
    entries = groups.select(F.posexplode("prefix").alias("at", "shingle"), "gid", "n", "m", "central")
    lists = stage(entries.withColumn("most", _most(F.col("m") - F.col("at"))).drop("at"), "lists")

    # Every group of a list against the list's most central group.
    hub = F.min(F.struct((F.col("n") - F.col("m")).alias("dead"), "central", "gid", "n", "most"))
    hubs = lists.groupBy("shingle").agg(hub.alias("h"), F.count("*").alias("groups")).filter("groups > 1")
    hubs = hubs.select("shingle", "h.*")
    stars = (
        lists.alias("g").join(hubs.alias("h"), "shingle")
        .filter((F.col("g.gid") != F.col("h.gid")) & _fits("g", "h"))
        .select(F.col("g.gid").alias("gid"), F.col("h.central").alias("b")).distinct()
    )
    own = groups.select("gid", F.col("central").alias("b"))
    nodes = members.select("gid", F.col("node").alias("a"))
    pairs = nodes.join(stars.unionByName(own), "gid").filter("a <> b").select("a", "b").distinct()
    found = stage(_verified(pairs, sets), "star-links")
    roots = components(found)

    # What is left: members of one list in different components.
    labelled = stage(
        members.join(roots, "node", "left").select("node", "gid", F.coalesce("root", "node").alias("root")), "labelled"
    )
    parts = labelled.select("gid", "root").distinct()
    spread = stage(lists.select("shingle", "gid", "n", "most").join(parts, "gid"), "spread")
    sizes = spread.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    mains = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    mains = mains.filter("roots > 1").select("shingle", "main")
    mixed = spread.join(mains, "shingle")
    left, right = mixed.filter("root <> main").alias("l"), mixed.alias("r")
    once = F.expr("r.root = r.main or l.gid < r.gid or (l.gid = r.gid and l.root < r.root)")
    across = (
        left.join(right, F.expr("l.shingle = r.shingle and l.root <> r.root") & once & _fits("l", "r"))
        .select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("gid", "root")]).distinct()
    )
    ends = {
        s: labelled.select(F.col("node").alias(f"{s}_node"), F.col("gid").alias(f"{s}_gid"), F.col("root").alias(f"{s}_root"))
        for s in "lr"
    }
    rest = across.join(ends["l"], ["l_gid", "l_root"]).join(ends["r"], ["r_gid", "r_root"])
    rest = rest.select(F.greatest("l_node", "r_node").alias("a"), F.least("l_node", "r_node").alias("b")).distinct()
    more = stage(_verified(rest, sets), "cross-links")
    if more.isEmpty():
        return found, roots
    everything = found.unionByName(more)
    return everything, components(everything)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = stage(_nodes(docs), "nodes")
    wanted = stage(_partnered(docs, sets), "partnered")
    whole = stage(_whole_sets(docs, wanted), "whole-sets")
    rare_first = stage(_by_frequency(whole), "rare-first")
    _, roots = links(rare_first)

    nodes = sets.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_doc"))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Only roots with links can have another node; the others keep their own first document.
    firsts = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    component = named.join(firsts, "root").select("node", "component_id")
    out = sets.select("doc_id", "node", "n").join(component, "node", "left")
    return out.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that name their component, and rows without an id; all columns."""
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
