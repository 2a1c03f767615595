"""Quality scores from two Zstandard dictionaries, one of good and one of bad labelled text.

Each text is compressed whole, in blocks, with either dictionary.  Text that is like the good
examples gets shorter with the good dictionary; the difference of the two sizes over their sum is
the raw score.  A logistic curve fitted on labelled texts that neither dictionary has seen turns
it into a probability.

Training reads a bounded sample of labelled rows (``examples`` per class, ``example_bytes`` of
each).  Scoring reads every byte of every text.  Null and empty texts get the score of a text
that neither dictionary favours.  Labels other than 0 and 1 and rows without an id are not
learned from; repeated rows of a table count once in training and are scored each.  Without
labelled rows of both classes there is nothing to learn and ``train`` raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import text_slices

EXAMPLES = 1500
EXAMPLE_BYTES = 4096
BLOCK_BYTES = 4096
LEVEL = 3
# Classes are cut by so many leading bits of the hash before they are ranked.
BUCKET_BITS = 14


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, raw, score`` of every row; a score of 1 is most likely good."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = None
            for batch in text_slices(batches, "text"):
                scorer = scorer or TwoDictionaries(self.good, self.bad)
                raw = scorer.raw(batch.column("text").to_pylist())
                proba = 1 / (1 + np.exp(-(self.slope * raw + self.intercept)))
                arrays = [batch.column("doc_id"), pa.array(raw), pa.array(proba)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "raw", "score"])

        return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, raw double, score double")


class TwoDictionaries:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        def compressor(data: bytes):
            held = zstd.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            return zstd.ZstdCompressor(level=LEVEL, dict_data=held, **options).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """(bad size - good size) / (bad size + good size) of each text, over all its blocks."""
        out = np.zeros(len(texts))
        for row, text in enumerate(texts):
            if not text:
                continue
            data, with_good, with_bad = text.encode(), 0, 0
            for start in range(0, len(data), BLOCK_BYTES):
                block = data[start : start + BLOCK_BYTES]
                with_good += len(self.good(block))
                with_bad += len(self.bad(block))
            out[row] = (with_bad - with_good) / (with_bad + with_good)
        return out


def sample_labelled(
    docs: DataFrame, labels: DataFrame, held_out, label_col: str = "quality",
    examples: int = EXAMPLES,
) -> list[tuple[str, int]]:
    """At most ``2 * examples`` texts of each class, drawn by the hash of the id.

    An id counts once for a label however often it is labelled, and gives one text, that of the
    smallest hash, however many rows it has.
    """
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
        .select("doc_id", F.col(label_col).cast("int").alias("label")).distinct()
        .withColumn("draw", F.xxhash64(F.col("doc_id").cast("string")))
        .withColumn("bucket", F.shiftrightunsigned("draw", 64 - BUCKET_BITS))
    )
    # How many ids each class has below a hash: at most 2 ** BUCKET_BITS counts of either class.
    cuts = {0: 0, 1: 0}
    found = {0: 0, 1: 0}
    for label, bucket, n in sorted(chosen.groupBy("label", "bucket").count().collect()):
        if found[label] < 2 * examples:
            found[label] += n
            cuts[label] = bucket
    # Only what lies up to the cut is ranked: the sample and the rest of its last bucket.
    below = F.col("bucket") <= F.when(F.col("label") == 1, cuts[1]).otherwise(cuts[0])
    order = Window.partitionBy("label").orderBy("draw", "doc_id")
    ids = chosen.filter(below).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2 * examples)
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    # At most 2 * examples ids of either class: small enough to send to the texts at any size.
    rows = texts.join(F.broadcast(ids.select("doc_id", "label", "draw")), "doc_id")
    # A long text gives the part at a place that its hash picks.
    places = F.greatest(F.lit(1), F.ceil(F.length("text") / EXAMPLE_BYTES))
    part = F.substr("text", (F.pmod(F.col("draw"), places) * EXAMPLE_BYTES + 1).cast("int"), F.lit(EXAMPLE_BYTES))
    rows = rows.select("doc_id", "label", "draw", F.struct(F.xxhash64("text").alias("h"), part.alias("text")).alias("t"))
    # One text of each id and label: a minimum is taken in every task before rows move.
    picked = rows.groupBy("label", "doc_id", "draw").agg(F.min("t").alias("t")).collect()
    if len(picked) > 4 * examples:
        raise AssertionError("the sample is larger than its bound")
    return [(r.t.text, r.label) for r in sorted(picked, key=lambda r: (r.draw, r.label, r.t.text))]


def train(examples: list[tuple[str, int]], dictionary_bytes: int = 112_640) -> QualityModel:
    """Dictionaries from every other example, the curve from the rest."""
    parts: dict[tuple[int, int], list[bytes]] = {}
    seen = [0, 0]
    for text, label in examples:
        parts.setdefault((label, seen[label] % 2), []).append(text.encode())
        seen[label] += 1
    if min(seen) < 2:
        raise ValueError("quality needs at least two labelled texts of each class")
    good, bad = (_dictionary(parts[label, 0], dictionary_bytes) for label in (1, 0))
    scorer = TwoDictionaries(good, bad)
    texts = [(t.decode(), label) for label in (0, 1) for t in parts[label, 1]]
    raw = scorer.raw([t for t, _ in texts])
    slope, intercept = _logistic(raw, np.array([label for _, label in texts], float))
    return QualityModel(good, bad, slope, intercept)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-size:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a weak pull of the slope towards zero."""
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weights = np.zeros(2)
    pull = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + pull @ weights
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + pull, gradient)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned outside the fold crc32(id) % 3 = 1."""
    from lurewatch.llm.common import fold

    model = train(sample_labelled(docs, labels, fold("doc_id", 3, 1)))
    return model.score(docs).select(
        "doc_id", fold("doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw",
    )
