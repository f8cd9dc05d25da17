"""Language identification by nearest centroids.

Texts become vectors of hashed n-grams (of the UTF-8 bytes of their lower-cased letters, with one
space for anything between), weighted by TF-IDF and normalised. Each language is
described by several centroids, found by spherical k-means over its labelled texts; a text gets the
language of the centroid with the largest cosine. Where even that cosine is below what the language
shows for texts of that length, the text is rejected: for each language and each power of two of
letters the bound is a little under nearly all cosines of the sample's texts of that length, or of
stretches of longer ones where these are few. Short texts say little, so their bounds are low, and
the shortest have none.

Document frequencies are counted over all labelled rows that may be learned from. Only the centroids
are fitted on a sample of about ``sample_rows`` labelled rows (a documented bound), dealt evenly to the
languages, ``LEAST_ROWS`` to each at least: the rows whose hash is below the language's share. The
languages themselves may be ``sample_rows`` at most and no more than a model of MODEL_BYTES holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, flat, fresh, lower, mix, pieces, ranges, schema_of

UNKNOWN = "und"
#: n-gram lengths in bytes, and the number of hashed features (a power of two).
GRAMS = (1, 2, 3)
FEATURES = 1 << 13
CENTROIDS = 4
SAMPLE_ROWS = 4_000
LEAST_ROWS = 50
#: A text is rejected if its best cosine is below this share of a low quantile of the sample's.
REJECT_SHARE = 0.9
REJECT_QUANTILE = 0.005
#: Lengths of stretches are 2^SHORTEST to 2^LONGEST bytes of letters; shorter texts are not rejected.
SHORTEST, LONGEST = 4, 12
#: Whole texts of one length, and stretches, that a quantile needs; with fewer stretches the bound is
#: half of the least.
LEAST_TEXTS, LEAST_STRETCHES = 100, 40
MODEL_BYTES = 64 << 20
#: Texts in one block of vectors.
BLOCK = 256


@dataclass(frozen=True)
class LanguageModel:
    """languages[i] is the language of centroids[i] (unit rows); idf by feature; least[i] the least cosine
    accepted for each length class."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of letters (a-z and beyond ASCII) with one space where others stood, and the offsets."""
    data = lower(data)
    other = (data < 97) | ((data > 122) & (data < 128))
    keep = np.ones(len(data), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    position = np.flatnonzero(keep)
    return np.where(other, np.uint8(32), data)[position], np.searchsorted(position, offsets)


Letters = tuple[np.ndarray, np.ndarray]


def letters_of(texts: pa.Array) -> Letters:
    return letters(*flat(pc.utf8_lower(texts)))


def length_class(lengths: np.ndarray) -> np.ndarray:
    """The power of two that a number of letters reaches, LONGEST at most."""
    return np.minimum(np.frexp(np.maximum(lengths, 1).astype(np.float64))[1] - 1, LONGEST)


def counts(found: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-gram counts over the letters of each whole text: text, feature, count, by text."""
    data, offsets = found
    data = data.astype(np.uint64)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    code, found = np.zeros(len(data), np.uint64), [np.empty(0, np.int64)]
    for length in range(1, min(max(GRAMS), len(data)) + 1):
        code = code[: len(data) - length + 1] | data[length - 1 :] << np.uint64(8 * (length - 1))
        if length in GRAMS:
            whole = of[: len(code)] == of[length - 1 :]
            feature = (mix(code + np.uint64(length << 56)) >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)
            found.append((of[: len(code)] * FEATURES + feature)[whole])
    count = np.bincount(np.concatenate(found), minlength=1)
    place = np.flatnonzero(count)
    return place // FEATURES, place % FEATURES, count[place]


def weights(texts: Letters, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors, with damped counts: text, feature, weight. A text may have none."""
    text, feature, count = counts(texts)
    weight = np.log1p(count).astype(np.float32) * idf[feature]
    norm = np.sqrt(np.bincount(text, weight * weight, minlength=1))
    return text, feature, (weight / norm[text]).astype(np.float32)


def cosines(texts: Letters, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cosine of each text with each centroid; zero for a text without n-grams."""
    text, feature, weight = weights(texts, idf)
    out = np.zeros((len(texts[1]) - 1, len(centroids)), np.float32)
    if len(text):
        begins = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[begins]] = np.add.reduceat(centroids.T[feature] * weight[:, None], begins, axis=0)
    return out


def dense(texts: Letters, idf: np.ndarray) -> np.ndarray:
    text, feature, weight = weights(texts, idf)
    out = np.zeros((len(texts[1]) - 1, FEATURES), np.float32)
    out[text, feature] = weight
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for first in range(0, batch.num_rows, BLOCK):
            yield batch.slice(first, BLOCK)


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; FEATURES rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(FEATURES, np.int64), 0
        for batch in blocks(batches):
            total += np.bincount(counts(letters_of(batch.column("text")))[1], minlength=FEATURES)
            texts += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, texts))], ["feature", "texts"]
        )

    found = rows.select("text").mapInArrow(run, "feature bigint, texts bigint").groupBy("feature").agg(F.sum("texts").alias("texts"))
    out = np.zeros(FEATURES + 1, np.int64)
    for feature, texts in found.collect():
        out[feature] = texts
    return out[:-1], int(out[-1])


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids of unit rows; begun with rows far from each other, so without chance."""
    chosen = [0]
    best = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        far = int(np.argmin(best))
        if best[far] > 1 - 1e-6:
            break
        chosen.append(far)
        best = np.maximum(best, rows @ rows[far])
    centres = rows[chosen]
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[nearest == i].sum(axis=0) for i in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def stretches(found: Letters, length: int) -> Letters:
    """One stretch of ``length`` bytes out of each text that has as many, at a place that depends on its size."""
    data, offsets = found
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    place = offsets[:-1][long] + (size[long] * 2654435761) % (size[long] - length + 1)
    return data[ranges(place, np.full(len(long), length))], np.arange(len(long) + 1) * length


def _best(found: Letters, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The largest cosine of each text, a block of texts at a time."""
    data, offsets = found
    out = [np.empty(0, np.float32)]
    for first in range(0, len(offsets) - 1, BLOCK):
        part = offsets[first : first + BLOCK + 1]
        out.append(cosines((data[part[0] : part[-1]], part - part[0]), idf, centroids).max(axis=1))
    return np.concatenate(out)


def _some(found: Letters, chosen: np.ndarray) -> Letters:
    data, offsets = found
    size = np.diff(offsets)[chosen]
    return data[ranges(offsets[:-1][chosen], size)], np.concatenate([[0], np.cumsum(size)])


def bounds(found: Letters, idf: np.ndarray, centroids: int, share: float) -> np.ndarray:
    """The least cosine accepted for each length class, from a language's sample.

    Either half of the sample is compared with centroids of the other half: a text is never nearer
    because it was learned from. A bound comes from the texts of its length, or from stretches of
    longer ones where these are few.
    """
    texts = np.arange(len(found[1]) - 1)
    best: dict[int, list[np.ndarray]] = {c: [] for c in range(SHORTEST, LONGEST + 1)}
    cut: dict[int, list[np.ndarray]] = {c: [] for c in best}
    for half in range(2):
        learned, told = (_some(found, texts[texts % 2 == n]) for n in (1 - half, half))
        if len(learned[1]) == 1:
            continue
        means = spherical_means(dense(learned, idf), centroids)
        nearest, of = _best(told, idf, means), length_class(np.diff(told[1]))
        for c in best:
            best[c].append(nearest[of == c])
            cut[c].append(_best(stretches(told, 1 << c), idf, means))
    out = np.zeros(LONGEST + 1)
    for c in best:
        if sum(map(len, best[c])) >= LEAST_TEXTS:
            out[c] = share * np.quantile(np.concatenate(best[c]), REJECT_QUANTILE)
            continue
        near = np.concatenate([np.empty(0), *cut[c]])
        if len(near) >= LEAST_STRETCHES:
            out[c] = share * np.quantile(near, REJECT_QUANTILE)
        elif len(near):
            out[c] = 0.5 * near.min()
        if len(near) < LEAST_STRETCHES and c > SHORTEST:  # too few are as long: no more than shorter ones show
            out[c] = min(out[c], out[c - 1]) if len(near) else out[c - 1]
    return out


def fit(
    df: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    centroids: int = CENTROIDS,
    sample_rows: int = SAMPLE_ROWS,
    reject_share: float = REJECT_SHARE,
) -> LanguageModel:
    """A model of the rows where ``learn`` holds, the label is not NULL and the text has a letter.

    Without such rows the model knows no language and rejects every text.
    """
    rows = df.select(
        col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"), learn.alias("learn")
    ).filter("learn AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    frequency, texts = _document_frequencies(rows)
    idf = np.log((1 + texts) / (1 + frequency)).astype(np.float32) + np.float32(1)
    by_language = dict(rows.groupBy("lang").count().limit(sample_rows + 1).collect()) if texts else {}
    if not by_language:
        return LanguageModel((), np.zeros((0, FEATURES), np.float32), idf, np.zeros((0, LONGEST + 1)))
    most = min(sample_rows, MODEL_BYTES // (4 * FEATURES * centroids))
    if len(by_language) > most:
        raise ValueError(f"over {most} languages, more than the sample or the model allows; labels look wrong")
    # A row is in the sample if its hash is low enough: no shuffle, and repeats of a row count once.
    wanted = max(LEAST_ROWS, sample_rows // len(by_language))
    limits = [(lang, int(min(1.0, wanted / n) * (1 << 62))) for lang, n in by_language.items()]
    limits = df.sparkSession.createDataFrame(limits, "lang string, most bigint")
    chosen = (
        rows.withColumn("mark", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
        .join(F.broadcast(limits), "lang")
        .filter("mark <= most")
        .groupBy("lang", "doc_id", "mark")
        .agg(F.first("text").alias("text"))
    )

    def centres(table: pa.Table) -> pa.Table:
        # In one order, however the rows came: the means begin with the first.
        texts = letters_of(table.sort_by([("mark", "ascending"), ("text", "ascending")])["text"].combine_chunks())
        means = spherical_means(dense(texts, idf), centroids)
        least = bounds(texts, idf, centroids, reject_share)
        return pa.table(
            {
                "lang": pa.array([table["lang"][0].as_py()] * len(means), pa.string()),
                "least": pa.array([least.tolist()] * len(means)),
                "centre": pa.array([m.astype("<f4").tobytes() for m in means], pa.binary()),
            }
        )

    found = (
        chosen.select("lang", "mark", "text")
        .groupBy("lang")
        .applyInArrow(centres, "lang string, least array<double>, centre binary")
        .collect()
    )
    found = sorted(found, key=lambda row: (row["lang"], bytes(row["centre"])))
    return LanguageModel(
        tuple(row["lang"] for row in found),
        np.stack([np.frombuffer(bytes(row["centre"]), "<f4") for row in found]),
        idf,
        np.array([row["least"] for row in found]),
    )


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and lang_pred, score, rejected (renamed if ``df`` has such columns).

    lang_pred is a learned language, or ``und`` where the text is NULL or has no letter; score is the
    cosine with the nearest centroid, 0 to 1. rejected holds for ``und`` and for texts farther from
    their nearest centroid than the model accepts for its language and the text's length. Ties go to the first language in order. Only the text is
    looked at, all of it. The model's size is FEATURES x centroids x languages, whatever the data.
    """
    names = [fresh(df, name) for name in ("lang_pred", "score", "rejected")]
    has_letter = fresh(df, "has_letter")
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = df.withColumn(has_letter, text.rlike("\\p{L}"))
    at = df.columns.index(text_col)
    schema = schema_of(df, "`{}` string, `{}` double, `{}` boolean".format(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = np.full(batch.num_rows, UNKNOWN, object)
            score, least = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            done = 0
            for block in blocks(iter([pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], ["text"])])):
                if len(m.languages):
                    found = letters_of(block.column("text"))
                    cosine = cosines(found, m.idf, m.centroids)
                    best = np.argmax(cosine, axis=1)
                    lang[done : done + block.num_rows] = np.array(m.languages, object)[best]
                    score[done : done + block.num_rows] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                    least[done : done + block.num_rows] = m.least[best, length_class(np.diff(found[1]))]
                done += block.num_rows
            known = np.asarray(batch.column(has_letter)) & (len(m.languages) > 0)
            lang[~known], score[~known] = UNKNOWN, 0.0
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(lang, pa.string()), pa.array(score), pa.array(~known | (score < least))], schema.names
            )

    return rows.mapInArrow(run, schema)
