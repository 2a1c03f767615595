"""Merkle manifest of a table by time-forward processing.

Every row is a leaf.  The leaves of a source, ordered by id, and above them the roots of all
sources, ordered by source, are the leaves of ternary hash trees.  A node is labelled by (level,
place); a digest travels forward from a node to its parent through a priority queue ordered by
label, and once the root is known the proof suffixes travel the same way back, from parents to
children, in the reversed order of labels.

The queue is external in this sense: a tree is worked off in blocks of ``FAN ** LEVELS`` leaves.
Within a block the queue is a heap; messages between blocks are rows that an exchange by block
and a sort by label deliver.  A source that holds a third of all rows is many blocks.  The number
of passes grows with the logarithm of the rows, six levels a pass, and every pass is written to
the shared folder.  Only digests move, never texts.

Places within a source come from a range partitioning by (source, id): the place in the own
partition plus what earlier partitions hold of the source, so no task holds a source either.

Null fields count as ``-``.  A null source is a source of its own and comes first, null ids come
first within a source; rows with equal ids are ordered by their digest, repeated rows are leaves
of their own.  Rows without an id are never tampered with.  A source of one row has that leaf as
its root, and so has a table of one source.  Other columns are not looked at.  An empty table has
no leaves and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import arrow_schema
from lurewatch.session import stage

FAN = 3
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows of digests that are sorted together, on average at most.
RANKED_TOGETHER = 1_000_000
PROOF = "array<struct<left string, right string>>"
Siblings = tuple[str, str]  # digests left and right of a node in its run


def digest_of(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field with its length, so that no two rows read alike."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(fields[name]) for name in FIELDS]), 256)


def height(leaves: Column) -> Column:
    """Levels above the leaves of a tree; a lone leaf has none."""
    powers = F.array(*[F.lit(FAN**level) for level in range(40)])
    return F.size(F.filter(powers, lambda power: power < leaves))


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place within its group, and ``height``, that of the group's tree."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANKED_TOGETHER))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    # The number holds the partition in its upper bits and counts the rows of the partition.
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    # One row for each partition and each source that it holds.
    held = ranged.groupBy(group, "part").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    every = Window.partitionBy(group)
    earlier = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        F.col(group).alias("_group"), F.col("part").alias("_part"), "begin",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), height(F.sum("n").over(every)).alias("height"),
    )
    joined = ranged.join(held, ranged[group].eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")))
    idx = F.col("at") - F.col("begin") + F.col("before")
    return joined.select(*rows.columns, idx.alias("idx"), "height")


def forward(first: int, digests: list[str], levels: int) -> list[list[str]]:
    """Digests of a block by level: its leaves, which stand from place ``first`` on, their parents,
    and so on ``levels`` times.  Labels are (level, place); messages go to the parent's label."""
    done: list[list[str]] = [[] for _ in range(levels + 1)]
    queue = [(0, first + i, 0, digest) for i, digest in enumerate(digests)]
    while queue:
        level, place = queue[0][:2]
        received = []
        while queue and queue[0][:2] == (level, place):
            received.append(heappop(queue)[3])
        own = received[0] if level == 0 else digest_of(*received)
        done[level].append(own)
        if level < levels:
            heappush(queue, (level + 1, place // FAN, place % FAN, own))
    return done


def backward(first: int, nodes: list[list[str]], suffix: list[Siblings]) -> list[list[Siblings]]:
    """Proofs of the leaves of a block, from the top's ``suffix``, in the reversed order of labels."""
    levels = len(nodes) - 1
    out: list[list[Siblings]] = [[] for _ in nodes[0]]
    starts = [first // FAN**level for level in range(levels + 1)]
    queue = [(-levels, -starts[levels], suffix)]
    heapify(queue)
    while queue:
        level, place, proof = heappop(queue)
        level, place = -level, -place
        if level == 0:
            out[place - first] = proof
            continue
        below, begin = nodes[level - 1], starts[level - 1]
        run = below[place * FAN - begin : place * FAN - begin + FAN]
        for i in range(len(run)):
            own = ("".join(run[:i]), "".join(run[i + 1 :]))
            heappush(queue, (-(level - 1), -(place * FAN + i), [own, *proof]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of sorted batches that agree in ``key``, together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in key):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sorted_blocks(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a block in one task, at most ``FAN ** LEVELS`` leaves of it, in order."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *order)


def _block() -> Column:
    return F.expr(f"idx div {FAN**LEVELS}")


def sweep_up(leaves: DataFrame) -> list[DataFrame]:
    """``grp, idx, height, digest`` after each pass over staged leaves; the last has the roots."""
    passes = [leaves]
    tallest = leaves.agg(F.max("height")).first()[0] or 0
    nodes = leaves.select("grp", "idx", "height", "digest")
    schema = arrow_schema(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for held in _blocks(batches, ("grp", "block")):
            levels = min(LEVELS, held[0]["height"])
            top = forward(held[0]["idx"], [r["digest"] for r in held], levels)[-1][0]
            rows.append({"grp": held[0]["grp"], "idx": held[0]["block"], "height": held[0]["height"] - levels, "digest": top})
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    for _ in range(-(-tallest // LEVELS)):
        sent = _sorted_blocks(nodes.withColumn("block", _block()), "idx")
        nodes = stage(sent.mapInArrow(run, nodes.schema), "merkle-nodes")
        passes.append(nodes)
    return passes


def sweep_down(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The columns of the leaves, ``proof`` and ``subroot``.

    ``above`` has ``grp, proof``: what the root of each tree has as a proof itself.  It arrives at
    the leaves as a suffix of theirs, together with the digest of that root.
    """
    tops = passes[-1].join(above.withColumnsRenamed({"grp": "_grp", "proof": "_proof"}), F.col("grp").eqNullSafe(F.col("_grp")))
    messages = tops.select("grp", "idx", F.col("_proof").cast(PROOF).alias("proof"), F.col("digest").alias("subroot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, ("grp", "block")):
            # The row of the block itself comes first: what its top has as a proof.
            suffix, own = [(s["left"], s["right"]) for s in held[0]["proof"]], held[1:]
            nodes = forward(own[0]["idx"], [r["digest"] for r in own], min(LEVELS, own[0]["height"]))
            for row, proof in zip(own, backward(own[0]["idx"], nodes, suffix), strict=True):
                row["proof"] = [{"left": left, "right": right} for left, right in proof]
                row["subroot"] = held[0]["subroot"]
            yield pa.RecordBatch.from_pylist(own, schema)

    for number in range(len(passes) - 2, -1, -1):
        nodes = passes[number].withColumn("proof", F.lit(None).cast(PROOF)).withColumn("subroot", F.lit(None).cast("string"))
        schema = arrow_schema(nodes)
        tops = messages.select("grp", F.lit(-1).cast("long").alias("idx"), F.col("idx").alias("block"), "proof", "subroot")
        sent = _sorted_blocks(nodes.withColumn("block", _block()).unionByName(tops, allowMissingColumns=True), "idx")
        found = sent.mapInArrow(run, nodes.schema)
        messages = stage(found, "merkle-proofs") if number else found
    if len(passes) == 1:  # no tree has more than one leaf
        keep = [c for c in passes[0].columns if c not in messages.columns]
        own = passes[0].select(F.col("grp").alias("_grp"), *keep)
        messages = own.join(messages, F.col("_grp").eqNullSafe(F.col("grp"))).drop("_grp")
    return messages


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to with the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof`` of every row, and ``folded_root, verified``.

    ``proof`` holds the siblings from the leaf to the root.  ``tampered_text`` is the text as it
    is found when the manifest is verified; without it rows are verified as they are.
    """
    fields = {name: F.col(f"`{name}`") for name in FIELDS}
    found = fields | ({} if tampered_text is None else {"text": tampered_text})
    rows = docs.select(
        "doc_id", F.col("source").alias("grp"), leaf_digest(fields).alias("digest"), leaf_digest(found).alias("found")
    )
    leaves = stage(places(stage(rows, "merkle-leaves"), "grp", ["doc_id", "digest", "found"]), "merkle-leaves")
    below = sweep_up(leaves)

    # The tree above: one leaf for each source.
    subroots = below[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "digest")
    above = sweep_up(stage(places(subroots, "grp", ["source"]), "merkle-sources"))
    top = above[-1].select("grp", F.array().cast(PROOF).alias("proof"))
    sources = sweep_down(above, top).select(F.col("source").alias("grp"), "proof")
    proofs = sweep_down(below, stage(sources, "merkle-sources"))

    root = above[-1].first()  # one row, or none of an empty table
    out = proofs.select(
        "doc_id", F.col("grp").alias("source"), F.col("digest").alias("leaf"), "subroot",
        F.lit(root.digest if root else None).cast("string").alias("root"), "proof", "found",
    )
    out = out.withColumn("folded_root", fold(F.col("found"), F.col("proof"))).drop("found")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    """One digest over all siblings of a proof, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest verified against texts of which every other one has lost its line breaks."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, text).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified"
    )
