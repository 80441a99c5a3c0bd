"""Quality rules that vote, with accuracies estimated by expectation-maximisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.common import settle, with_fields

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")

# ---------------------------------------------------------------------------
# Frequent words of the four languages of the corpus.
# ---------------------------------------------------------------------------
FREQUENT = frozenset(
    "a an and are as at be by for from in is it not of on or that the this to was were with "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine es für ist mit nicht sich sie und von zu "
    "al como con del el las lo los más no para por se su una y".split()
)

#: Each rule looks at one measure: below ``bad`` or above it, as the sign says, it votes against the
#: document, beyond ``good`` on the other side for it, and between the two it abstains.
RULES = (
    ("length", +1, 25.0, 60.0),
    ("word_length_low", +1, 3.0, 3.5),
    ("word_length_high", -1, 10.0, 8.0),
    ("symbols", -1, 0.10, 0.01),
    ("duplicate_lines", -1, 0.50, 0.30),
    ("repeated_words", -1, 0.30, 0.20),
    ("frequent_words", +1, 0.05, 0.12),
    ("letters", +1, 0.75, 0.85),
    ("capitals", -1, 0.30, 0.15),
    ("distinct_words", +1, 0.20, 0.50),
)
#: Chances to vote for, to abstain and to vote against, for documents of good and of bad quality.
USUAL = {True: (0.80, 0.17, 0.03), False: (0.45, 0.20, 0.35)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(numbers: np.ndarray, width: int = 8) -> int:
    """Words within windows of ``width`` (a power of two) that are found twice or more. Windows are named
    by doubling: a name stands for exactly one sequence, so nothing rests on a hash."""
    n = len(numbers) - width + 1
    if n < 2:
        return 0
    names, step = numbers, 1
    while step < width:
        pairs = names[:-step] * np.int64(names.max() + 1) + names[step:]
        names, step = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * step
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + width, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts of a whole text, and the measures the rules look at; null counts as empty."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    ids: dict[str, int] = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    n_lines = n_dup = 0
    lines: set[str] = set()
    for line in text.split("\n"):
        if WORDS.search(line):
            n_lines += 1
            n_dup += line in lines
            lines.add(line)
    chars = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    repeats = repeated_words(numbers)
    lower = text.lower()
    letters = len(re.findall(r"[^\W\d_]", lower))
    capitals = sum(1 for a, b in zip(text, lower) if a != b) if len(lower) == len(text) else 0
    frequent = sum(1 for w in lower.split() if w.strip(".,;:!?") in FREQUENT)
    each = max(n, 1)
    return [n, chars, symbols, n_dup, repeats], [
        float(n), chars / each, chars / each, symbols / each, n_dup / max(n_lines, 1), repeats / each,
        frequent / each, letters / max(chars, 1), capitals / max(letters, 1),
        len(ids) / each ** 0.8 if n else 0.0,
    ]


def votes(measures: list[float]) -> int:
    """All votes as one number, a base-3 digit for each rule: 0 abstains, 1 for, 2 against."""
    code = 0
    for value, (_, sign, bad, good) in zip(measures, RULES):
        code = 3 * code + (2 if sign * value < sign * bad else 1 if sign * value >= sign * good else 0)
    return code


def ballots(codes: np.ndarray) -> np.ndarray:
    """Vote numbers to a matrix of -1, 0 and 1."""
    powers = 3 ** np.arange(len(RULES) - 1, -1, -1)
    return np.array([0, 1, -1])[codes[:, None] // powers % 3]


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The posterior probability of good quality of each vote number, by expectation-maximisation.

    The hidden quality decides each rule's chances to vote for, against or to abstain, independently of
    the other rules. Chances start from what such rules usually do, ``USUAL``: a vote against says
    much more than one for. The same chances stay as a prior of one document for each rule, so that no
    rule turns round or becomes certain by a handful of documents."""
    votes_of = ballots(codes)
    weight = counts.astype(np.float64)
    kinds = np.stack([votes_of == v for v in (1, 0, -1)], axis=2).astype(np.float64)
    chances = [np.tile(np.array(USUAL[good]), (len(RULES), 1)) for good in (True, False)]
    share = 0.8
    posterior = np.full(len(codes), share)
    for _ in range(rounds):
        logs = [
            np.log(part) + np.einsum("prk,rk->p", kinds, np.log(chance))
            for part, chance in zip((share, 1 - share), chances)
        ]
        after = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))
        done = np.abs(after - posterior).max(initial=0) < 1e-9
        posterior = after
        if done:
            break
        share = ((weight * posterior).sum() + 0.8) / (weight.sum() + 1)
        for k, (good, belief) in enumerate(((True, posterior), (False, 1 - posterior))):
            mass = np.einsum("p,prk->rk", weight * belief, kinds) + np.array(USUAL[good])
            chances[k] = mass / mass.sum(axis=1, keepdims=True)
    return posterior


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the base counts and ``votes`` of every row of ``docs`` (needs ``text``)."""
    schema = with_fields(docs, keep, ", ".join(f"{c} long" for c in BASE) + ", votes int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, codes = [], []
            for text in batch.column("text"):
                base, values = measure(text.as_py())
                counts.append(base)
                codes.append(votes(values))
            columns = list(zip(*counts)) or [()] * len(BASE)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(c, pa.int64()) for c in columns],
                 pa.array(codes, pa.int32())], [*keep, *BASE, "votes"],
            )

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def judged(rows: DataFrame, patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (posterior probability) and kept to rows of ``measured``. ``patterns`` has the
    number ``n`` of documents for each combination of ``votes``, of all documents.

    There are at most 3 to the power of the number of rules (59,049) of these, so they go to the driver
    and back whatever the size of the corpus."""
    counted = patterns.orderBy("votes").collect()
    codes = np.array([r["votes"] for r in counted], np.int64)
    found = estimate(codes, np.array([r["n"] for r in counted], np.int64)) if counted else []
    quality = rows.sparkSession.createDataFrame(
        [(int(c), float(q)) for c, q in zip(codes, found)], "_votes int, quality double"
    )
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        rows.join(F.broadcast(quality), F.col("votes") == F.col("_votes")).drop("_votes")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    )


def weak_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, kept, quality and votes of every document.

    Null and empty texts have no word, so they fail the base; repeated rows are judged each, equally;
    an empty table gives no row; other columns are not looked at."""
    counted = settle(measured(docs.select("doc_id", "text"), "doc_id"))
    patterns = counted.groupBy("votes").agg(F.count("*").alias("n"))
    return judged(counted, patterns, least).select("doc_id", *BASE, "base_failed", "kept", "quality", "votes")


def kept_rows(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns in their order. Each text is measured once: rows
    are settled with their votes between the estimate and the decision, as writing them is much
    cheaper than a second pass over all words. Odd rows are judged as by ``weak_quality``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    counted = settle(measured(rows, "row"))
    patterns = counted.groupBy("votes").agg(F.count("*").alias("n"))
    return judged(counted, patterns, least).where("kept").select("row.*")
