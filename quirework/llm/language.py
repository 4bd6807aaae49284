"""Language identification by words first, backing off to shorter and shorter character n-grams.

Each language has a table of relative word frequencies and one of character
n-grams for each length from 5 to 1. A word known to any language scores by its
log frequency in each; a language without it pays a fixed penalty. An unknown
word scores by the mean over its longest n-grams of which any is known. A text
scores by the mean over its words; the best language wins.

The tables are fitted on a bounded sample of labelled rows: about SAMPLE of each
language, chosen by a hash of the id. This bounds what is broadcast; within the
sample every word and n-gram is learned. Counting runs in Spark, split by parts
of the hashes; only the sample's tables reach the driver. Words are runs of
letters and their marks of any script, in lower case.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text when nothing was learned. A text with letters of which nothing
is known ties between all languages. Ties go to the language first by code
point. Languages that are null are not learned. Empty tables give empty
results; other columns pass through, save those named like the outputs, which
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folds, tokens

#: Labelled rows of each language that the tables are fitted on, about.
SAMPLE = 3000
#: Parts, by the top bits of the hash, in which each table is counted.
PARTS = 8
LONGEST = 5
#: Added to the largest cost of a table for a language that lacks the entry.
PENALTY = 1.0
#: How sharply the score tells languages apart.
SHARPNESS = 8.0
BLOCK_BYTES = 8 << 20


def lettered(texts: pa.Array) -> tuple[np.ndarray, tokens.Words]:
    """Which texts have a letter; and the words of all: runs of letters and marks, in lower case."""
    texts = pc.fill_null(texts, "")
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}\p{M}]+", replacement=" ")
    return pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool), tokens.cut(plain)


@dataclass
class Model:
    """tables[0] has words, tables[n] n-grams: sorted hashes, and a row of costs (-log10 of the frequency) by language."""

    langs: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]

    def look_up(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes table n has, and their rows."""
        hashes, costs = self.tables[n]
        if not len(hashes):
            return np.zeros(len(h), bool), np.zeros((0, len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        known = hashes[at] == h
        return known, costs[at[known]]

    def word_costs(self, vocabulary: tokens.Vocabulary) -> np.ndarray:
        """Costs of each distinct word by language; 0 where no n-gram of it is known."""
        out = np.zeros((len(vocabulary.hash), len(self.langs)))
        known, costs = self.look_up(0, vocabulary.hash)
        out[known] = costs
        rest = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                break
            points, word = vocabulary.text(rest, " ", " ")
            h, word = tokens.char_ngrams(points, word, n)
            known, costs = self.look_up(n, h)
            word = word[known]
            times = np.bincount(word, minlength=len(rest))
            found = times > 0
            for k in range(len(self.langs)):
                out[rest[found], k] = np.bincount(word, costs[:, k], len(rest))[found] / times[found]
            rest = rest[~found]
        return out


def _counts(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", BLOCK_BYTES // 2):
                _, words = lettered(part.column("text"))
                vocabulary = tokens.Vocabulary(words)
                lang = np.array([langs.index(x) for x in part.column("lang").to_pylist()], dtype=np.int64)
                pair, times = np.unique(vocabulary.of * len(langs) + lang[words.doc], return_counts=True)
                word, of = pair // len(langs), pair % len(langs)
                points, place = vocabulary.text(np.arange(len(vocabulary.hash)), " ", " ")
                used = np.zeros((len(vocabulary.hash), len(langs)))
                used[word, of] = times
                for n in range(LONGEST + 1):
                    h, at = (vocabulary.hash, np.arange(len(vocabulary.hash))) if n == 0 else tokens.char_ngrams(points, place, n)
                    distinct, number = np.unique(h, return_inverse=True)
                    total = np.stack([np.bincount(number, used[at, k], len(distinct)) for k in range(len(langs))], 1)
                    for p, (low, high) in enumerate(pairwise(np.searchsorted(distinct >> tokens.U64(64 - PARTS.bit_length() + 1), np.arange(PARTS + 1, dtype=tokens.U64)))):
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([p], pa.int32()), pa.array([distinct[low:high].tobytes()], pa.binary()), pa.array([total[low:high].astype(np.float32).tobytes()], pa.binary())], ["n", "part", "hashes", "counts"])

    return run


def _read(hashes: list[bytes], counts: list[bytes], langs: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(counts), np.float32).reshape(-1, langs)


def _sum(langs: int):
    def run(group: pa.Table) -> pa.Table:
        h, counts = _read(group.column("hashes").to_pylist(), group.column("counts").to_pylist(), langs)
        distinct, number = np.unique(h, return_inverse=True)
        total = np.stack([np.bincount(number, counts[:, k], len(distinct)) for k in range(langs)], 1).astype(np.float32)
        return pa.table({"n": group.column("n")[:1], "part": group.column("part")[:1], "hashes": pa.array([distinct.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def costs(counts: np.ndarray) -> np.ndarray:
    """-log10 of each entry's share of its language; a language without it pays PENALTY more than the largest of these."""
    shares = counts / np.maximum(1, counts.sum(0, dtype=np.float64))
    out = -np.log10(np.where(shares > 0, shares, 1))
    return np.where(shares > 0, out, out.max(initial=0) + PENALTY).astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on about sample rows of each language of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    some, counts = folds.about(rows, "lang", "doc_id", sample)
    langs = sorted(counts)
    schema = "n int, part int, hashes binary, counts binary"
    tables = some.select("text", "lang").mapInArrow(_counts(langs), schema).groupBy("n", "part").applyInArrow(_sum(len(langs)), schema).collect()
    model = Model(langs, [])
    for n in range(LONGEST + 1):
        own = sorted((r for r in tables if r["n"] == n), key=lambda r: r["part"])
        hashes, counts = _read([bytes(r["hashes"]) for r in own], [bytes(r["counts"]) for r in own], len(langs)) if langs else (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
        model.tables.append((hashes, costs(counts)))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the model's share for it among all languages."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for part in tokens.slices(batch, text_col, BLOCK_BYTES):
                has_letter, words = lettered(part.column(text_col))
                if not model.langs:
                    best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                else:
                    vocabulary = tokens.Vocabulary(words)
                    costs = model.word_costs(vocabulary)
                    each = np.stack([tokens.doc_sums(costs[vocabulary.of, k], words) for k in range(len(model.langs))], 1) / np.maximum(1, words.count)[:, None]
                    best = each.argmin(1)
                    score = 1 / np.exp(-SHARPNESS * (each - each.min(1, keepdims=True))).sum(1)
                    score[~has_letter], best[~has_letter] = 0.0, len(model.langs)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
