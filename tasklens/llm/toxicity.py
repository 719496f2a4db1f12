"""Toxicity by compression distance: two zstandard dictionaries, word windows, a calibrated chance.

A window is one word of a text, lower-cased, behind a fixed carrier that both dictionaries hold, so that its frame is in
compressed form. Its gain is its length in bytes under the ordinary dictionary less that under the toxic one. The
dictionaries come from labelled texts: the ordinary one holds their commonest windows, the toxic one those and the
windows that mark toxic texts, whole words first and then beginnings of words that mark the toxic texts still left,
ranked by log odds and document frequency. The numbers and rates of windows beyond several gains become a chance by a
logistic calibration on the same bounded sample. The dictionaries differ in the marks alone, so a window that shares no
six bytes with them and holds no shorter mark counts as without gain and isn't compressed. Windows repeat, so gains are kept in a bounded cache.

This replaces dictionaries that zstandard trains on whole texts of each class, which find half of the toxic rows at
best: see the README's figures.
"""

from __future__ import annotations

import re

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import labelled_sample, map_rows, table

MOST_LABELLED = 20_000
#: Words of the dictionaries; share of the best mark's weight that a mark must have; documents it must stand in.
ORDINARY_WORDS, MARK_WORDS, LEAST_SHARE, LEAST_DOCS = 1500, 200, 0.2, 3
#: Most marks, of the greatest weight, that the 200 are picked from.
MOST_MARKS = 5000
STARTS = range(5, 11)
CARRIER, CACHE, LEVELS = "~ a window of the text follows here:", 300_000, (2, 3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words; most tokens between white space are one already."""
    out: set[str] = set()
    for token in set((text or "").lower().split()):
        if token.isalpha():
            out.add(token)
        else:
            out.update(WORD.findall(token))
    return out


def _window(word: str) -> bytes:
    return f" {word} ".encode("utf-8", "surrogatepass")


class Model:
    """Plain data (bytes and numbers), so it ships with a task's closure; compressors are made where they are used."""

    def __init__(self, ordinary: bytes = b"", added: bytes = b"", base: float = 0.0, short: tuple[bytes, ...] = ()):
        self.ordinary, self.toxic = ordinary + CARRIER.encode(), ordinary + added + CARRIER.encode()
        # a mark of fewer than six bytes has no piece of its own and stands whole
        self.shared = b"|".join(sorted({re.escape(added[i : i + 6]) for i in range(len(added) - 5)} | {re.escape(w) for w in short}))
        self.beta = np.zeros(2 * len(LEVELS) + 2)
        self.beta[-1] = np.log((base + 1e-6) / (1 - base + 1e-6))

    def gains(self):
        """A function from a word to its window's gain."""
        if not self.shared:
            return lambda word: 0.0
        make = zstandard.ZstdCompressionParameters.from_level
        params = make(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3)
        two = []
        for content in (self.ordinary, self.toxic):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            two.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress)
        ordinary, toxic = two
        head, kept, shares = CARRIER.encode(), {}, re.compile(self.shared).search

        def gain(word: str) -> float:
            got = kept.get(word)
            if got is None:
                if len(kept) >= CACHE:
                    kept.clear()
                w = _window(word)
                got = kept[word] = len(ordinary(head + w)) - len(toxic(head + w)) if shares(w) else 0
            return got

        return gain

    def features(self, gains: list[float]) -> list[float]:
        found = [sum(g >= x for g in gains) for x in LEVELS]
        n = len(gains)
        return [*(float(np.log1p(x)) for x in found), *(min(1.0, 20 * x / (n + 10)) for x in found), float(np.log1p(n)) / 5, 1.0]

    def score(self, gains: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(gains), self.beta), -30, 30))))


def _weighed(forms: DataFrame, n: dict[int, int]) -> DataFrame:
    """form, c1, c0 (numbers of toxic and other texts that have it), weight of forms (doc_id, y, form); weight is null where it marks nothing."""
    counts = forms.distinct().groupBy("form").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("c0") + 0.5) / (n.get(0, 0) + 1))
    return counts.withColumn("weight", F.when((F.col("c1") >= LEAST_DOCS) & (odds > 1), odds * F.col("c1")))


def _picked(weighed: DataFrame) -> list[str]:
    """Of the marks whose weight is LEAST_SHARE of the best one's or more, the best MARK_WORDS, none the beginning of another."""
    best = weighed.agg(F.max("weight")).first()[0]
    if best is None:
        return []
    rows = weighed.where(F.col("weight") >= LEAST_SHARE * best).orderBy(F.desc("weight"), F.desc(F.length("form")), "form").limit(MOST_MARKS).collect()
    picked: list[str] = []
    for w in (r.form for r in rows):
        if not any(w.startswith(p) or p.startswith(w) for p in picked):
            picked.append(w)
    return picked[:MARK_WORDS]


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learned from at most `most` labelled rows outside the held-out fifth; without toxic rows, every score is 0.

    Words are counted in Spark; the marks, the commonest words and the sample's features are what reaches the driver.
    """

    def make():
        def rows(batch):
            for doc_id, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield doc_id, y, sorted(words(text.as_py()))

        return rows

    sample = table(map_rows(labelled_sample(docs, labels, "toxic", most).select("doc_id", "y", "text"), "doc_id long, y int, words array<string>", make), "toxic_sample")
    n = _sizes(sample)
    if not n.get(1):
        return Model()
    wordy: Column = F.explode("words").alias("form")
    whole = table(_weighed(sample.select("doc_id", "y", wordy), n).withColumn("form", F.concat(F.lit(" "), "form", F.lit(" "))), "toxic_words")
    marks = _picked(whole)
    common = [r.form for r in whole.where("weight IS NULL AND c0 > 0").orderBy(F.desc("c0"), "form").limit(ORDINARY_WORDS).collect()][::-1]
    rest = sample.where(~F.arrays_overlap("words", F.array(*[F.lit(w.strip()) for w in marks]))) if marks else sample
    long = rest.select("doc_id", "y", wordy).where(F.length("form") >= STARTS[0])
    cut = F.explode(F.sequence(F.lit(STARTS[0]), F.least(F.length("form"), F.lit(STARTS[-1])))).alias("k")
    begun = long.select("doc_id", "y", "form", cut).select("doc_id", "y", F.concat(F.lit(" "), F.expr("substring(form, 1, k)")).alias("form"))
    starts = _picked(table(_weighed(begun, _sizes(rest)), "toxic_starts"))
    # each mark stands behind the carrier's end, so that one match can run from the carrier into it
    forms = [w.encode("utf-8", "surrogatepass") for w in [*starts[::-1], *marks[::-1]]]
    added = b"".join(CARRIER[-8:].encode() + w for w in forms)
    model = Model("".join(common).encode("utf-8", "surrogatepass"), added, short=tuple(w for w in forms if len(w) < 6))

    def features():
        gain = model.gains()
        return lambda batch: ((model.features([gain(w) for w in kept]), y) for y, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

    got = map_rows(sample.select("y", "words"), "x array<double>, y int", features).collect()  # `most` rows at most
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    model.beta[:] = 0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ model.beta, -30, 30)))
        slope = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(x.shape[1])
        model.beta = model.beta + np.linalg.solve(slope, x.T @ (y - p) - 0.05 * model.beta)
    return model


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), windows (distinct ones that gain four bytes) for each row; null and empty texts have no window and still a score."""

    def make():
        gain = model.gains()

        def rows(batch):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = [gain(w) for w in words(text.as_py())]
                yield doc_id, model.score(got), sum(g >= LEVELS[2] for g in got)

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double, windows int", make)
