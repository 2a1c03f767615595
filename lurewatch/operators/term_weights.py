"""TF-IDF over word 1-2-grams.

Term statistics come from one aggregation; the vocabulary (at most ``max_features`` terms) and
its weights are the only things that reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lurewatch import constants as K

# Maximal runs of two or more word characters.
TOKEN_PATTERN = f"[{K.WORD_CLASS}]{{2,}}"

# Words, and entries of vectors, that a task has in hand at once.
WORDS_AT_ONCE = 1 << 20
ENTRIES_AT_ONCE = 1 << 18


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def terms_of(words: Column) -> Column:
    """Unigrams followed by bigrams."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return F.concat(words, F.when(F.size(words) >= 2, pairs).otherwise(F.slice(words, 1, 0)))


def listed_terms(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``terms`` of each text.  An explode of one value is a boundary that expressions do not
    cross, so a text is cut into tokens once however often its terms are used."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = df.select(*keep, F.explode(F.array(tokens(text))).alias("words"))
    return words.select(*keep, F.explode(F.array(terms_of(F.col("words")))).alias("terms"))


def term_stats(
    df: DataFrame, text_col: str = "text_combined", min_df: int = 3,
    restrict: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """term, tf (occurrences), df (texts that hold it) for terms in at least ``min_df`` texts.

    ``restrict`` may drop rows of terms that are not wanted before they are added up.
    """
    rows = counted_terms(df, text_col)
    return summed_terms(restrict(rows) if restrict else rows, min_df)


def summed_terms(counted: DataFrame, min_df: int) -> DataFrame:
    """Totals of the rows of :func:`counted_terms`; the exchange sees a row per task and term."""
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).filter(F.col("df") >= min_df)


def counted_terms(df: DataFrame, text_col: str = "text_combined") -> DataFrame:
    """``term, tf, df`` of runs of texts, a row per run and term: parts of :func:`term_stats`.

    Spark cuts the texts into words; the terms of a run are counted as numbers and become strings
    once each, instead of a row for each of their occurrences.
    """
    words = df.select(tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    return words.mapInArrow(_counted_runs, "term string, tf long, df long")


def _counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs((batch.column(0) for batch in batches), WORDS_AT_ONCE):
        yield _counted(run)


def _runs(lists: Iterator[pa.Array], most: int) -> Iterator[pa.Array]:
    """The lists again, in arrays of about ``most`` values."""
    held, size = [], 0
    for array in lists:
        for _, part in _parts(array, most):
            held.append(part)
            size += int(_lengths(part).sum())
            if size >= most:
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def _parts(lists: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most`` values, and where they begin."""
    cuts = np.flatnonzero(np.diff(np.cumsum(_lengths(lists)) // most)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(lists)], strict=True):
        yield start, lists.slice(start, stop - start)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(rows: np.ndarray) -> np.ndarray:
    """Places of words that another word of the same text follows."""
    return np.flatnonzero(rows[1:] == rows[:-1])


def _coded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as places in the array of those that occur, and that array."""
    coded = pa.array(numbers).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _counted(lists: pa.Array) -> pa.RecordBatch:
    """A term as a number: that of its word, or behind all words that of its pair of words."""
    rows = np.repeat(np.arange(len(lists)), _lengths(lists))
    words = lists.flatten().dictionary_encode()
    word, n_words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    at = _pairs(rows)
    code, terms = _coded(np.concatenate([word, n_words + word[at] * n_words + word[at + 1]]))
    # A text and a term in it, once each.
    held = _coded(np.concatenate([rows, rows[at]]) * len(terms) + code)[1]
    left, right = np.divmod(terms - n_words, max(n_words, 1))
    single = terms < n_words
    first = words.dictionary.take(pa.array(np.where(single, terms, left)))
    pairs = pc.binary_join_element_wise(first, words.dictionary.take(pa.array(np.where(single, 0, right))), " ")
    return pa.RecordBatch.from_arrays(
        [
            pc.if_else(pa.array(single), first, pairs),
            pa.array(np.bincount(code, minlength=len(terms)), pa.int64()),
            pa.array(np.bincount(held % max(len(terms), 1), minlength=len(terms)), pa.int64()),
        ],
        ["term", "tf", "df"],
    )


def tfidf_rows(df: DataFrame, weights: DataFrame, id_col: str, text_col: str = "text_combined") -> DataFrame:
    """``id, term, weight`` of every text and term of ``weights (term, idf)``; the weights of a
    text make up a vector of unit length.  Texts without such a term have no rows; rows with equal
    ids are one text.

    The weights, a row a term, reach every task.  A text's terms are counted where the text is read;
    only their numbers and counts move, to bring equal ids together.
    """
    known = weights.select("term", F.col("idf").cast("double")).toArrow()  # as many rows as the vocabulary
    terms, idf = known["term"].combine_chunks(), known["idf"].to_numpy()
    index = _term_index(terms.to_pylist())
    id_field = df.select(F.col(id_col).alias(id_col)).schema[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in _parts(batch.column(1), WORDS_AT_ONCE):
                yield _counts_of_known(batch.column(0).slice(start, len(part)), part, index, len(terms))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group, position, n in _joined_texts(batches, len(terms)):
            weight = n * idf[position]
            length = np.sqrt(np.bincount(group, weights=weight * weight, minlength=len(ids)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(group)), terms.take(pa.array(position)), pa.array(weight / length[group])],
                [id_col, "term", "weight"],
            )

    words = df.select(F.col(id_col).alias(id_col), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    ids = f"`{id_col.replace('`', '``')}`"
    counts = words.mapInArrow(
        count, StructType([id_field, *StructType.fromDDL("positions array<int>, counts array<int>").fields])
    )
    return counts.repartition(F.col(ids)).sortWithinPartitions(F.col(ids)).mapInArrow(
        weigh, StructType([id_field, StructField("term", StringType()), StructField("weight", DoubleType())])
    )


def _term_index(terms: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the position of each word among the terms or -1, pairs of words as numbers in order,
    and the positions of these pairs."""
    parts = [term.split(" ") for term in terms]
    words = sorted({word for part in parts for word in part})
    code = {word: at for at, word in enumerate(words)}
    single = np.full(len(words), -1, np.int64)
    pairs = []
    for position, part in enumerate(parts):
        if len(part) == 1:
            single[code[part[0]]] = position
        elif len(part) == 2:
            pairs.append((code[part[0]] * len(words) + code[part[1]], position))
    pairs.sort()
    numbers = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.array(words, pa.string()), single, numbers[:, 0].copy(), numbers[:, 1].copy()


def _counts_of_known(ids: pa.Array, lists: pa.Array, index: tuple, n_terms: int) -> pa.RecordBatch:
    """Positions and counts of the known terms of each text; texts without any are left out."""
    words, single, pairs, places = index
    rows = np.repeat(np.arange(len(lists)), _lengths(lists))
    coded = lists.flatten().dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy().astype(np.int64)
    word = known[coded.indices.to_numpy(zero_copy_only=False)]
    of_word = np.append(single, -1)[word]  # unknown words are -1, the last place
    at = _pairs(rows)
    number = np.where((word[at] >= 0) & (word[at + 1] >= 0), word[at] * len(words) + word[at + 1], -1)
    place = np.searchsorted(pairs, number)
    of_pair = np.where(np.append(pairs, -2)[place] == number, np.append(places, -1)[place], -1)
    position, row = np.concatenate([of_word, of_pair]), np.concatenate([rows, rows[at]])
    held, n = np.unique(row[position >= 0] * max(n_terms, 1) + position[position >= 0], return_counts=True)
    row, position = np.divmod(held, max(n_terms, 1))
    texts, sizes = np.unique(row, return_counts=True)
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(texts)), pa.ListArray.from_arrays(ends, pa.array(position, pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(n, pa.int32())),
        ],
        ["id", "positions", "counts"],
    )


def _joined_texts(batches: Iterator[pa.RecordBatch], n_terms: int):
    """Ids, and of every entry its place among them, its term and its count; equal ids, which come
    one after the other, are joined.  A text is held back until another follows."""
    held = None
    for batch in batches:
        for start, part in _parts(batch.column(1), ENTRIES_AT_ONCE):
            ids, sizes = batch.column(0).slice(start, len(part)), _lengths(part)
            position = part.flatten().to_numpy().astype(np.int64)
            n = batch.column(2).slice(start, len(part)).flatten().to_numpy().astype(np.int64)
            if held is not None:
                ids, sizes = pa.concat_arrays([held[0], ids]), np.append(len(held[1]), sizes)
                position, n = np.append(held[1], position), np.append(held[2], n)
            if not len(ids):
                continue
            before, after = ids.slice(0, len(ids) - 1), ids.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(before, after), False), pc.and_(pc.is_null(before), pc.is_null(after)))
            starts = np.append(True, ~same.to_numpy(zero_copy_only=False).astype(bool))
            group = np.repeat(np.cumsum(starts) - 1, sizes)
            ids = ids.take(pa.array(np.flatnonzero(starts)))
            if not starts.all():
                entries, at = np.unique(group * max(n_terms, 1) + position, return_inverse=True)
                n = np.bincount(at, weights=n).astype(np.int64)
                group, position = np.divmod(entries, max(n_terms, 1))
            last = group == len(ids) - 1
            held = ids.slice(len(ids) - 1), position[last], n[last]
            if len(ids) > 1:
                yield ids.slice(0, len(ids) - 1), group[~last], position[~last], n[~last]
    if held is not None:
        yield held[0], np.zeros(len(held[1]), np.int64), held[1], held[2]


def vocabulary(stats: DataFrame, max_features: int = 20_000) -> DataFrame:
    """The most frequent terms of the corpus; ties go to the smaller term."""
    return stats.orderBy(F.desc("tf"), "term").limit(max_features)


def idf_weights(terms: DataFrame, n_texts: int | Column) -> DataFrame:
    """Smoothed inverse document frequency ``ln((1 + n) / (1 + df)) + 1``."""
    n = n_texts if isinstance(n_texts, Column) else F.lit(n_texts)
    return terms.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def fit_tfidf(
    df: DataFrame,
    text_col: str = "text_combined",
    output_col: str = "features",
    max_features: int = 20_000,
    min_df: int = 3,
) -> PipelineModel:
    """A pipeline model from text to unit-length TF-IDF vectors."""
    n_texts = df.count()
    terms = (
        idf_weights(vocabulary(term_stats(df, text_col, min_df), max_features), n_texts)
        .select("term", "idf")
        .collect()  # at most max_features rows
    )
    if not terms:
        raise ValueError(f"no term occurs in {min_df} or more texts")
    terms.sort(key=lambda r: r["term"])
    counts = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in terms], inputCol="_terms", outputCol="_counts"
    )
    stages = [
        SQLTransformer(
            statement=f"SELECT *, coalesce(`{text_col}`, '') AS _text FROM __THIS__"
        ),
        RegexTokenizer(
            inputCol="_text", outputCol="_words", pattern=TOKEN_PATTERN, gaps=False,
            toLowercase=True,
        ),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        counts,
        ElementwiseProduct(
            scalingVec=Vectors.dense([r["idf"] for r in terms]),
            inputCol="_counts", outputCol="_weighted",
        ),
        Normalizer(p=2.0, inputCol="_weighted", outputCol=output_col),
        SQLTransformer(
            statement=_without("_text", "_words", "_pairs", "_terms", "_counts", "_weighted")
        ),
    ]
    return Pipeline(stages=stages).fit(df.limit(0))


def fitted_weights(vectors: PipelineModel) -> tuple[list[str], list[float]]:
    """Terms and their inverse document frequencies, in the order of the vectors' components."""
    counts = next(s for s in vectors.stages if isinstance(s, CountVectorizerModel))
    product = next(s for s in vectors.stages if isinstance(s, ElementwiseProduct))
    return counts.vocabulary, [float(x) for x in product.getScalingVec()]


def _without(*columns: str) -> str:
    return f"SELECT * EXCEPT ({', '.join(columns)}) FROM __THIS__"
