"""Token ids by a public vocabulary, and token counts by an exact length histogram."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.llm.common import settle

#: Texts of these characters alone are encoded word by word: they are in composed form, lower case does
#: not depend on the neighbours, and Python and the vocabulary agree on what is a letter, a digit or white space.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e¡-©«-±´¶-¸»¿-ɏ]*")
#: Words remembered by a worker; beyond, it starts anew.
REMEMBERED = 1_000_000

# ---------------------------------------------------------------------------
# How the word vocabulary prepares text, and the same split for Python.
# ---------------------------------------------------------------------------
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the
    others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to what the vocabulary's own
    encoder gives without special tokens added.

    If the vocabulary prepares text as above, no token crosses white space, so each distinct word is merged
    once, by the vocabulary's own model, and remembered. Texts with special tokens or with characters
    beyond ``PLAIN``, and all texts of other vocabularies, go to the encoder whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        settings = json.loads(self.encoder.to_str())
        normalizer, splits = settings["normalizer"] or {}, settings["pre_tokenizer"] or {}
        self.by_word = (
            [x["type"] for x in normalizer.get("normalizers", [])] == NORMALIZERS
            and [x["type"] for x in splits.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and splits["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        )
        self.model, self.letters = self.encoder.model, byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            letters = piece.encode().decode("latin-1").translate(self.letters)
            ids = [token.id for token in self.model.tokenize(letters)]
            found = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or "<|" in text or not PLAIN.fullmatch(text):
            ids = self.encoder.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words, split = self.words, text.lower().split()
        try:
            return b"".join([words[w] for w in split])
        except KeyError:
            new = {w for w in split if w not in words}
        if len(words) + len(new) > REMEMBERED:
            words.clear()
            self.pieces.clear()
            new = set(split)
        for word in new:
            words[word] = b"".join([self._piece(x) for x in PIECE.findall(word)])
        return b"".join([words[w] for w in split])


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process, kept over its tasks."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def n_tokens(text: Column, vocabulary: str) -> Column:
    """Number of tokens of a whole text; null and empty have 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = word_ids(vocabulary)
        return pd.Series([len(encode(t)) // 4 for t in texts], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, vocabulary: str, by: Sequence[str] = ()) -> DataFrame:
    """Documents by exact encoded length: ``by``, n_tokens, docs. Null and empty texts count with
    length 0, repeated rows count each time, null keys are a group; an empty table gives no row. The
    histogram, a row for each length that occurs, is settled, so that texts are encoded once."""
    lengths = docs.select(*by, n_tokens(F.col("text"), vocabulary).alias("n_tokens"))
    return settle(lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("docs")))


def with_suffix_sums(histogram: DataFrame, by: Sequence[str] = (), block: int = 128) -> DataFrame:
    """For each length, taken as a context limit: docs_at_least and tokens_at_least (documents of this
    length or more, and their tokens), truncated_tokens (all tokens if every document is cut to the
    limit) and share_within (documents that fit, 0 to 1).

    Lengths are summed in blocks first: one window runs over the blocks, which are as many as the
    longest document has blocks of tokens, and one within each block, so no task gets all lengths.
    """
    keyed = histogram.withColumn("_block", F.floor(F.col("n_tokens") / block))
    later = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    blocks = (
        keyed.groupBy(*by, "_block")
        .agg(F.sum("docs").alias("_d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("_t"))
        .select(
            *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_b"),
            F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_later_docs"),
            F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_later_tokens"),
            F.sum("_d").over(everything).alias("_all_docs"),
            F.sum("_t").over(everything).alias("_all_tokens"),
        )
    )
    match = F.col("_block") == F.col("_b")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = (
        Window.partitionBy(*by, "_block").orderBy(F.desc("n_tokens"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tokens = F.col("docs") * F.col("n_tokens")
    return (
        keyed.withColumn("_docs", F.sum("docs").over(within)).withColumn("_tokens", F.sum(tokens).over(within))
        .join(blocks, match)
        .select(
            *by, "n_tokens", "docs",
            (F.col("_docs") + F.col("_later_docs")).alias("docs_at_least"),
            (F.col("_tokens") + F.col("_later_tokens")).alias("tokens_at_least"),
            (F.col("_all_tokens") - F.col("_tokens") - F.col("_later_tokens")
             + F.col("n_tokens") * (F.col("_docs") + F.col("_later_docs"))).alias("truncated_tokens"),
            ((F.col("_all_docs") - F.col("_docs") - F.col("_later_docs") + F.col("docs")) / F.col("_all_docs"))
            .alias("share_within"),
        )
    )


def totals(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """For any context limits: docs, tokens, docs_over (longer than the limit) and truncated_tokens."""
    each = sums.withColumn("limit", F.explode(F.array([F.lit(int(x)).cast("long") for x in limits])))
    over = F.col("n_tokens") > F.col("limit")
    return each.groupBy(*by, "limit").agg(
        F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens"),
        F.sum(F.when(over, F.col("docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.col("docs") * F.least("n_tokens", "limit")).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The smallest length within which at least the given share of the documents fits."""
    each = sums.withColumn("share", F.explode(F.array([F.lit(float(x)) for x in shares])))
    return each.where("share_within >= share").groupBy(*by, "share").agg(F.min("n_tokens").alias("n_tokens"))
