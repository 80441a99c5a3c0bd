"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.common import settle, with_fields

UNKNOWN = "und"
#: n-gram vectors held at once; more of them are added up block by block.
BLOCK = 8192

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once for each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_vectors(points: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """A random vector of -1 and 1 for each code point, which depends on the code point alone."""
    bits = [
        np.random.Generator(np.random.PCG64([seed, int(p)])).integers(0, 2, dimensions, dtype=np.int8)
        for p in points
    ]
    return (np.array(bits, np.int8).reshape(len(points), dimensions) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, n: int, dimensions: int, seed: int) -> np.ndarray:
    """Vectors of n-grams, given as rows of n code points: each letter's vector is permuted (rotated) by its
    place from the end, and the letters are bound by multiplication."""
    points, where = np.unique(grams, return_inverse=True)
    letters, where = letter_vectors(points, dimensions, seed), where.reshape(grams.shape)
    bound = np.ones((len(grams), dimensions), np.int8)
    for place in range(n):
        bound *= np.roll(letters, n - 1 - place, axis=1)[where[:, place]]
    return bound


def text_points(text: str) -> np.ndarray:
    """The letters of a text in lower case, runs of all else as one space, a space at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    points = np.where(is_letter, points, np.uint32(32))
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    space = points == 32
    return points[np.concatenate(([True], ~(space[1:] & space[:-1])))]


def gram_counts(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts as rows of code points, and how often each text has each."""
    runs, owners = [], []
    for k, text in enumerate(texts):
        points = text_points(text) if text else np.empty(0, np.uint32)
        if len(points) >= n:
            runs.append(points)
            owners.append(k)
    if not runs:
        return np.empty((0, n), np.uint32), np.zeros((len(texts), 0), np.float32)
    alphabet, codes = np.unique(np.concatenate(runs), return_inverse=True)
    codes, size = codes.astype(np.int64), len(alphabet)
    names = codes[:len(codes) - n + 1].copy()
    for place in range(1, n):
        names = names * size + codes[place:len(codes) - n + 1 + place]
    ends = np.cumsum([len(r) for r in runs])
    starts = ends - [len(r) for r in runs]
    if size**n <= 1 << 22:  # the usual alphabets: look names up in a table
        seen = np.zeros(size**n, bool)
        seen[names] = True
        distinct = np.flatnonzero(seen)
        index = np.zeros(size**n, np.int32)
        index[distinct] = np.arange(len(distinct), dtype=np.int32)
        names = index[names]
    else:
        distinct, names = np.unique(names, return_inverse=True)
    counts = np.zeros((len(texts), len(distinct)), np.float32)
    for k, lo, hi in zip(owners, starts, ends):
        counts[k] = np.bincount(names[lo:hi - n + 1], minlength=len(distinct))
    digits = distinct[:, None] // size ** np.arange(n - 1, -1, -1, dtype=np.int64) % size
    # n-grams over the seam of two texts are counted by none of them
    used = counts.any(axis=0)
    return alphabet[digits[used]], counts[:, used]


def document_vectors(
    grams: np.ndarray, counts: np.ndarray, n: int, dimensions: int, seed: int,
) -> np.ndarray:
    """Bundles: the sum of each text's n-gram vectors, by count."""
    total = np.zeros((len(counts), dimensions), np.float32)
    for lo in range(0, len(grams), BLOCK):
        vectors = gram_vectors(grams[lo:lo + BLOCK], n, dimensions, seed).astype(np.float32)
        total += counts[:, lo:lo + BLOCK] @ vectors
    return total


def _texts(
    column: pa.Array, most_rows: int = 128, most_chars: int = 1 << 19, most_counts: int = 1 << 24,
) -> Iterator[list[str | None]]:
    """Texts in groups, of which the counts of n-grams (of up to as many as there are characters, for each text) have a
    bounded size; a text that is longer is a group of its own."""
    group, chars = [], 0
    for value in column:
        text = value.as_py()
        size = len(text) if text else 0
        if group and (len(group) >= most_rows or chars + size > min(most_chars, most_counts // (len(group) + 1))):
            yield group
            group, chars = [], 0
        group.append(text)
        chars += size
    if group:
        yield group


def prototypes(
    docs: DataFrame, learn: Column, n: int = 3, dimensions: int = 1024, seed: int = 1, most_labels: int = 10_000,
) -> dict[str, np.ndarray]:
    """The bundle (sum) of all document vectors of each language, from ``text`` and ``lang`` of the rows
    where ``learn`` holds; none of an empty table. Tasks add up their rows first; one vector for each label of a language
    goes to the driver. The labels are counted before: with more than ``most_labels``, ``lang`` holds something
    else than languages, and a ValueError says so."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in _texts(batch.column("text")):
                grams, counts = gram_counts(texts, n)
                of, at = langs[at:at + len(texts)], at + len(texts)
                if len(grams):
                    known = sorted({x for x, some in zip(of, counts.any(axis=1)) if some})
                    by_lang = np.array([counts[[x == lang for x in of]].sum(axis=0) for lang in known])
                    for lang, total in zip(known, document_vectors(grams, by_lang, n, dimensions, seed)):
                        sums[lang] = sums.get(lang, 0) + total.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            ["lang", "vector"],
        )

    parts = docs.where(learn & F.col("lang").isNotNull()).select("lang", "text")
    added = (
        parts.mapInArrow(bundle, "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("place", "value"))
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("vector"))
    )
    added = settle(added)
    if (labels := added.count()) > most_labels:
        raise ValueError(f"{labels} labels of a language; up to {most_labels} are expected")
    return {r["lang"]: np.array([v["value"] for v in r["vector"]]) for r in added.orderBy("lang").collect()}


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], *keep: str, n: int = 3, seed: int = 1,
) -> DataFrame:
    """``keep``, lang_pred and score for every row: the language whose prototype has the greatest cosine with
    the document's vector, ties to the first name, and that cosine, 0 at least. Only ``text`` is
    looked at. Texts that are null, empty or without a letter are ``und`` with score 0, and so is
    every text if nothing was learned; repeated rows get equal answers, an empty table none. Other columns are not
    looked at, whatever their names."""
    schema = with_fields(docs, keep, "lang_pred string, score double")
    names = sorted(profiles)
    matrix = np.array([profiles[k] / max(np.linalg.norm(profiles[k]), 1e-300) for k in names], np.float32)
    dimensions = matrix.shape[1] if names else 0

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for texts in _texts(batch.column("text")):
                grams, counts = gram_counts(texts, n)
                if not names or not len(grams):
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                vectors = document_vectors(grams, counts, n, dimensions, seed)
                lengths = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ matrix.T) / np.maximum(lengths, 1e-30)[:, None]
                best, known = cosines.argmax(axis=1), counts.any(axis=1)
                langs += [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                top = np.where(known, cosines[np.arange(len(best)), best], 0)
                scores += np.clip(top, 0, 1).astype(np.float64).tolist()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    return docs.select(*keep, "text").mapInArrow(predict, schema)


def language_of(docs: DataFrame, dimensions: int = 1024) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from those not held out. A null doc_id is not
    held out; an empty table gives no row; other columns are not looked at, whatever their names."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    profiles = prototypes(rows, ~F.col("held_out"), dimensions=dimensions)
    return identify(rows, profiles, "doc_id", "held_out")
