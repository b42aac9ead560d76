"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors (operator 2).

A text is lower-cased and all but its letters become spaces; its byte n-grams of lengths 2 to 4 are counted in a
fixed number of hashed dimensions. Counts are damped (1 + log), weighted by inverse document frequency and scaled
to length one. Each language has several centroids, found by spherical k-means over its training vectors; a text
gets the language of the centroid of largest cosine. A text is rejected if it has no letter, or if its distance
to the nearest centroid is larger than the radius of that centroid's language: a high quantile of the distances of
training texts from centroids of which they were held back, with a margin that leaves room for texts of a word or two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm.hashing import unused

UNDETERMINED = "und"
#: Odd multipliers of the n-gram hash, one for each byte of the n-gram.
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


@dataclass
class Model:
    """Centroids of all languages: `vectors` [centroid, dimension], the language and the rejection distance of each."""

    idf: np.ndarray
    vectors: np.ndarray
    languages: list[str]
    radius: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.idf.size


def _damped(batch: pa.Array, dimensions: int, at_once: int = 128):
    """Blocks of 1 + log(count) over the hashed n-grams of each text, and the first row of each block."""
    lowered = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(batch, "")), r"\PL+", " ")
    for first in range(0, len(lowered), at_once):
        texts = lowered.slice(first, at_once)
        out = np.zeros((len(texts), dimensions), np.float32)
        for k, text in enumerate(texts):
            b = np.frombuffer(b" " + text.as_buffer().to_pybytes() + b" ", np.uint8).astype(np.uint32)
            codes = b[:-1] * FACTORS[0] + b[1:] * FACTORS[1]
            kinds = [codes]
            for n in (2, 3):
                if b.size > n:
                    codes = codes[:-1] + b[n:] * FACTORS[n]
                    kinds.append(codes)
            mixed = np.concatenate(kinds)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            mixed >>= np.uint32(32 - (dimensions - 1).bit_length())
            counts = np.bincount(mixed, minlength=dimensions)
            there = np.flatnonzero(counts)
            out[k, there] = 1 + np.log(counts[there].astype(np.float32))
        yield first, out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors; starts from the farthest-first rows, so the same rows give the same centroids."""
    centres = [x[int((x @ x.mean(axis=0)).argmax())]]
    for _ in range(min(k, len(x)) - 1):
        near = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(near.argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[home == j].mean(axis=0) if (home == j).any() else c[j] for j in range(len(c))]))
    return c


def _held_back(x: np.ndarray, k: int) -> np.ndarray:
    """Distances of the rows of each half (every other row) from the nearest centroid of the other half."""
    halves = (x[::2], x[1::2])
    return np.concatenate([1 - (b @ _spherical_kmeans(a, k).T).max(axis=1) for a, b in (halves, halves[::-1])])


def fit(labelled: DataFrame, per_language: int = 500, centroids: int = 4, dimensions: int = 1 << 13, margin: float = 0.2, quantile: float = 0.99, farthest: float = 0.92, most_languages: int = 1000, most_rows: int = 3000) -> Model:
    """Fit a model on labelled(doc_id, text, lang), rows with null lang or text left out.

    The fit uses a bounded sample: about `per_language` rows of each language, chosen by a hash of doc_id with a
    threshold from the language's row count (all rows where it has fewer), about `most_rows` in all. Whole texts are turned into sparse
    vectors on the executors, written in the shared folder, and a task finds the centroids of a language; only
    centroids and counts of `dimensions` numbers a language come to the driver. Languages are as many as `lang` has values, `most_languages` at most. With no labelled row the model knows no language.

    The radius of a language is the `quantile` of its held-back distances plus `margin`, `farthest` at most, so a
    few odd or mislabelled rows do not set it.
    """
    rows = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().take(most_languages + 1)}
    if not counts:
        return Model(np.ones(dimensions, np.float32), np.zeros((0, dimensions), np.float32), [], np.zeros(0))
    if len(counts) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    per_language = min(per_language, most_rows / len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, per_language / n)])
    draw = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col("lang")]).select("id", "lang", "text")

    def vectors(batches):
        for batch in batches:
            for first, block in _damped(batch.column(2), dimensions):
                found = [np.flatnonzero(r) for r in block]
                yield pa.record_batch(
                    [batch.column(0).slice(first, len(block)), batch.column(1).slice(first, len(block)), pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()), pa.array([r[f].astype("<f4").tobytes() for r, f in zip(block, found, strict=True)], pa.binary())],
                    names=["id", "lang", "at", "value"],
                )

    def dense(table):
        x = np.zeros((table.num_rows, dimensions), np.float32)
        for k, (at, value) in enumerate(zip(table["at"], table["value"], strict=True)):
            x[k, np.frombuffer(at.as_buffer(), "<u4")] = np.frombuffer(value.as_buffer(), "<f4")
        return x

    def holders(table):
        return pa.table({"rows": pa.array([table.num_rows]), "held": pa.array([np.count_nonzero(dense(table), axis=0).astype("<i8").tobytes()], pa.binary())})

    def clusters(table):
        x = dense(table.sort_by([("id", "ascending"), ("at", "ascending"), ("value", "ascending")]))
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        far = float(np.quantile(_held_back(x, centroids), quantile)) if len(x) > 1 else 1.0
        return pa.table({"lang": table["lang"].slice(0, 1), "far": pa.array([far]), "centres": pa.array([_spherical_kmeans(x, centroids).astype("<f4").tobytes()], pa.binary())})

    found = runtime.materialise(sample.mapInArrow(vectors, "id string, lang string, at binary, value binary"), "language_vectors")
    held, n = np.zeros(dimensions, np.int64), 0
    for r in found.groupBy("lang").applyInArrow(holders, "rows long, held binary").collect():
        held += np.frombuffer(r["held"], "<i8")
        n += r["rows"]
    idf = (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)
    got = found.groupBy("lang").applyInArrow(clusters, "lang string, far double, centres binary").collect()
    runtime.discard(found)
    c, of, radius = [np.zeros((0, dimensions), np.float32)], [], []
    for r in sorted(got, key=lambda r: r["lang"]):
        c.append(np.frombuffer(r["centres"], "<f4").reshape(-1, dimensions))
        of += [r["lang"]] * len(c[-1])
        radius += [min(r["far"] + margin, farthest)] * len(c[-1])
    return Model(idf, np.concatenate(c), of, np.array(radius))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """docs with all its columns, whatever their names, in a struct `row`, then lang_pred, score and rejected."""
    return predict(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), model, ["row"])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs(text, ...) -> the columns of `keep`, then lang_pred, score, rejected.

    Columns of `keep` that have one of those three names already are left out. score is the cosine with the nearest centroid, between 0 and 1. Null texts and texts without a letter get
    'und', score 0 and rejected. Very long texts are counted whole. Ties go to the first centroid in order of
    language. Equal texts get equal values; columns that are not in `keep` are not read; an empty table gives an
    empty one. A model that knows no language gives 'und' and score 0 to all, and rejects only what has no letter.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # centroids x dimensions floats: its size is set by parameters
    letters = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    added = ("lang_pred", "score", "rejected")
    keep = [k for k in keep if k.lower() not in added]
    inputs = docs.select(*keep, F.when(letters, F.col("text").cast("string")).alias(unused(keep, "letters")))
    schema = docs.select(*keep).schema
    for name, kind in zip(added, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)

    def guess(batches):
        m = shared.value
        languages = np.array(m.languages, object)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            none = text.is_null().to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(text), int), np.zeros(len(text))
            if not len(languages):
                yield pa.record_batch([*batch.columns[:-1], pa.array([UNDETERMINED] * len(text), pa.string()), pa.array(score), pa.array(none)], names=[*batch.schema.names[:-1], *added])
                continue
            for first, block in _damped(text, m.dimensions):
                cosine = _unit(block * m.idf) @ m.vectors.T
                best[first : first + len(block)] = cosine.argmax(axis=1)
                score[first : first + len(block)] = cosine.max(axis=1)
            rejected = none | (1 - score > m.radius[best])
            score = np.where(none, 0.0, np.clip(score, 0, 1))
            named = np.where(none, UNDETERMINED, languages[best])
            yield pa.record_batch([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names[:-1], *added])

    return inputs.mapInArrow(guess, schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that is never learnt from: crc32 of the id's text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, keep: list[str], **parameters) -> DataFrame:
    """Fit on the labelled rows that are not held out and predict every row of docs(doc_id, text, lang, ...).

    Rows with a null doc_id are not held out. Null or empty texts, repeated rows, an empty table and one without
    labels: see fit() and predict().
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), **parameters)
    return predict(docs, model, keep)
