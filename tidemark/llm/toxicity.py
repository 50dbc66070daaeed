"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the table rows its whole form and its leading
bytes hash to. Filters of several widths run over the words, each filter's
largest value in a document counts, and a logistic layer makes the score.
Trained in numpy on a bounded sample, applied to whole texts inside tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import CHUNK_BYTES, arrow_schema, bytes_of, cut, texts_only
from tidemark.llm.hashing import byte_codes, lower, mix, prefix_sums, spans_of, word_bounds

#: Rows of the sample that is learnt from, in one task.
SAMPLE_ROWS = 6_000
#: Bytes of a row's text beyond which it isn't taken into the sample.
SAMPLE_BYTES = 20_000
TABLE_BITS = 16
EMBEDDING = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Leading bytes of a word that have a row of their own, besides the whole word.
PREFIXES = (3, 4, 5, 6, 7)
EPOCHS = 10
BATCH = 64


@dataclass
class Words:
    """Documents as numbered different words: `rows[word]` are its table rows."""

    rows: np.ndarray
    word: np.ndarray
    bounds: np.ndarray


def read_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+`, A to Z in lower case."""
    buf = lower(buf)
    starts, ends = word_bounds(buf, offsets)
    prefix = prefix_sums(byte_codes(buf))
    _, first, word = np.unique(spans_of(prefix, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    rows = np.zeros((len(first), 1 + len(PREFIXES)), np.int32)
    shift = np.uint64(64 - TABLE_BITS)
    for j, size in enumerate((None, *PREFIXES)):
        stop = e if size is None else np.minimum(e, s + size)
        hashed = mix(spans_of(prefix, s, stop) + np.uint64(j + 1)) >> shift
        # Row 0 is empty: for words that aren't longer than the leading part.
        rows[:, j] = 1 + hashed.astype(np.int64) if size is None else np.where(e - s > size, 1 + hashed.astype(np.int64), 0)
    return Words(rows, word.reshape(-1).astype(np.int32), np.searchsorted(starts, offsets))


@dataclass
class Classifier:
    """Table rows, filters (embedding, width place, filter), biases and output weights."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float

    @staticmethod
    def new(seed: int = 7) -> Classifier:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.05, ((1 << TABLE_BITS) + 1, EMBEDDING)).astype(np.float32)
        table[0] = 0
        filters = [rng.normal(0, (EMBEDDING * w) ** -0.5, (EMBEDDING, w, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Classifier(
            table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0,
        )

    def embed(self, rows: np.ndarray) -> np.ndarray:
        out = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            out = out + self.table[rows[:, j]]
        return out

    def pooled(self, text: Words, places: bool = False):
        """Largest value of each filter in each document, at least 0, and where it is.

        A place is -1 where no value is above 0: short, empty or plain texts.
        """
        docs, n = len(text.bounds) - 1, len(text.word)
        embedded = self.embed(text.rows)
        values, where = [], []
        for width, filters, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            out = np.zeros((docs, FILTERS), np.float32)
            at = np.full((docs, FILTERS), -1, np.int64)
            size = n - width + 1
            if size > 0:
                total = np.full((size, FILTERS), bias, np.float32)
                for j in range(width):
                    total += (embedded @ filters[:, j])[text.word[j : j + size]]
                stops = text.bounds[1:] - width + 1
                for i in np.flatnonzero(stops > text.bounds[:-1]):
                    part = total[text.bounds[i] : stops[i]]
                    if places:
                        best = part.argmax(0)
                        out[i] = part[best, np.arange(FILTERS)]
                        at[i] = best + text.bounds[i]
                    else:
                        part.max(0, out=out[i])
                at[out <= 0] = -1
                np.maximum(out, 0, out=out)
            values.append(out)
            where.append(at)
        return (np.concatenate(values, 1), np.concatenate(where, 1)) if places else np.concatenate(values, 1)

    def scores(self, text: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(text).astype(np.float64) @ self.weights + self.bias, -40, 40)))


def _steps(held: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
    """One Adagrad step; `held` sums the squares."""
    held += gradient * gradient
    return rate * gradient / np.sqrt(held + 1e-8)


def train(texts: Iterable[bytes], labels: np.ndarray, rate: float = 0.1, epochs: int = EPOCHS, seed: int = 7) -> Classifier:
    """Fit a classifier. The rarer label weighs more, by the root of the ratio."""
    texts, labels = list(texts), np.asarray(labels, np.float64)
    model, rng = Classifier.new(seed), np.random.default_rng(seed)
    batches = []
    order = rng.permutation(len(texts))
    for a in range(0, len(order), BATCH):
        mine = order[a : a + BATCH]
        offsets = np.r_[0, np.cumsum([len(texts[i]) for i in mine])]
        batches.append((read_words(np.frombuffer(b"".join(texts[i] for i in mine), np.uint8), offsets), labels[mine]))
    share = labels.mean() if len(labels) else 0.5
    if not 0 < share < 1:
        model.bias = 4.0 if share == 1 else -4.0
        model.weights[:] = 0
        return model
    weigh = np.sqrt((1 - share) / share)
    model.bias = float(np.log(share / (1 - share)))
    held = [np.zeros_like(model.table), [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.biases], np.zeros_like(model.weights), np.zeros(1)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            text, label = batches[b]
            pooled, where = model.pooled(text, places=True)
            score = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -40, 40)))
            error = ((score - label) * np.where(label > 0, weigh, 1) / len(label)).astype(np.float32)
            back = error[:, None] * model.weights[None, :]
            back[where < 0] = 0
            model.weights -= _steps(held[3], pooled.T @ error, rate)
            model.bias -= float(_steps(held[4], np.array([error.sum()]), rate)[0])
            rows, gradients = [], []
            for k, width in enumerate(WIDTHS):
                at, pull = where[:, k * FILTERS : (k + 1) * FILTERS], back[:, k * FILTERS : (k + 1) * FILTERS]
                doc, f = np.nonzero(pull)
                if not len(doc):
                    continue
                strength, filters = pull[doc, f], model.filters[k]
                change = np.zeros_like(filters)
                for j in range(width):
                    table_rows = text.rows[text.word[at[doc, f] + j]]
                    embedded = model.table[table_rows].sum(1)
                    np.add.at(change[:, j].T, f, strength[:, None] * embedded)
                    rows.append(table_rows.ravel())
                    gradients.append(np.repeat(strength[:, None] * filters[:, j, f].T, table_rows.shape[1], 0))
                model.filters[k] -= _steps(held[1][k], change, rate)
                model.biases[k] -= _steps(held[2][k], np.bincount(f, strength, FILTERS).astype(np.float32), rate)
            if rows:
                row, back_of = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(row), EMBEDDING), np.float32)
                np.add.at(total, back_of, np.concatenate(gradients))
                total[row == 0] = 0
                part = held[0][row]
                model.table[row] -= _steps(part, total, rate)
                held[0][row] = part
    return model


def grid(usual: float) -> np.ndarray:
    """The thresholds that are tried."""
    return np.unique(np.r_[usual, np.arange(5, 100, 5) / 100])


def calibrate(toxic: np.ndarray, rows: np.ndarray, usual: float = 0.7) -> float:
    """The threshold with the best F1; of equally good ones that nearest to the usual one.

    `toxic` and `rows` count toxic and all rows by how many thresholds of the
    grid their score reaches, from none to all.
    """
    if not 0 < toxic.sum() < rows.sum():
        return usual
    # Rows that reach a threshold: those of all higher steps.
    right, chosen = (np.cumsum(x[::-1])[::-1][1:] for x in (toxic, rows))
    f1 = 2 * right / np.maximum(1, chosen + toxic.sum())
    best = grid(usual)[f1 >= f1.max() - 1e-12]
    return float(best[np.argmin(np.abs(best - usual))])


@dataclass
class Toxicity:
    """A classifier and its thresholds by language; `usual` for all others.

    `learnt` are the ids of the rows that the classifier has learnt from.
    """

    model: Classifier
    thresholds: dict[str, float]
    usual: float = 0.7
    learnt: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _marked(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that count: 0 or 1, with an id, not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, usual: float = 0.7) -> Toxicity:
    """Learn from four fifths of at most `sample_rows` labelled rows that aren't held out.

    The sample is taken by a hash of the id; labels 0 and 1 count, others and
    rows without id or text don't. The rest of it is left to the thresholds.
    """
    marked = _marked(labels)
    spread = F.xxhash64("doc_id", F.lit("sample"))
    # The sample is chosen from ids and sizes; texts are only read for the chosen.
    rows = texts_only(docs).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    chosen = marked.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(spread).limit(sample_rows)
    sample = rows.join(chosen, "doc_id").withColumn("spread", spread).orderBy("spread", "text").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fit_sample(table))], pa.binary())], ["fitted"])

    # One task learns; the driver gets the classifier, whose size is fixed.
    found = sample.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(run, "fitted binary").collect()
    arrays, learnt = pickle.loads(found[0]["fitted"]) if found else _fit_sample(None)
    return Toxicity(Classifier(*arrays), {}, usual, learnt)


def _fit_sample(table: pa.Table | None) -> tuple[tuple, np.ndarray]:
    """The parts of a classifier, and the ids learnt from, from rows (doc_id, text, toxic)."""
    ids, texts, toxic = (table.column(c).to_pylist() if table is not None else [] for c in ("doc_id", "text", "toxic"))
    mine = np.arange(len(texts)) % 5 != 4
    model = train([t.encode() for t, m in zip(texts, mine, strict=True) if m], np.array(toxic, np.int64)[mine])
    return tuple(vars(model).values()), np.unique(np.array(ids, np.int64)[mine])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, usual: float = 0.7) -> Toxicity:
    """Learn, and set the thresholds by language.

    All labelled rows that aren't held out and whose id wasn't learnt from count
    for these, whole and of any length: where a language has 20 toxic ones, its
    own threshold, else the usual one.
    """
    fitted = learn(docs, labels, sample_rows, usual)
    sent = docs.sparkSession.sparkContext.broadcast((tuple(vars(fitted.model).values()), fitted.learnt))
    steps, ddl = grid(usual), "doc_id long, lang string, step int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, learnt = Classifier(*sent.value[0]), sent.value[1]
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), learnt)))
            step = np.searchsorted(steps, _scores(model, batch), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(step)], schema=schema)

    rows = texts_only(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    rows = rows.where((F.octet_length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Labels meet scores, so that no text moves.
    scored = rows.mapInArrow(run, ddl).join(_marked(labels), "doc_id")
    counts: dict[str, np.ndarray] = {}
    for r in scored.groupBy("lang", "step").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect():
        counts.setdefault(r["lang"], np.zeros((2, len(steps) + 1), np.int64))[:, r["step"]] = r["toxic"], r["n"]
    thresholds = {name: calibrate(*both, usual) for name, both in sorted(counts.items()) if both[0].sum() >= 20}
    return Toxicity(fitted.model, thresholds, usual, fitted.learnt)


def _scores(model: Classifier, batch: pa.RecordBatch) -> np.ndarray:
    buf, offsets = bytes_of(batch.column("text"))
    parts = [model.scores(read_words(b, o)) for _, b, o in cut(np.arange(batch.num_rows), buf, offsets, CHUNK_BYTES // 2)]
    return np.concatenate(parts) if parts else np.zeros(0)


RESULT = "doc_id long, score double"


def score(docs: DataFrame, fitted: Toxicity) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted (1 from 0.7 on).

    A row per input row. A null, empty or blank text has no words; its score is
    what the classifier gives without any, the lowest of all. Nothing but the
    text enters a score. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(fitted.model).values()))
    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch))], schema=schema)

    rows = texts_only(docs).mapInArrow(run, RESULT)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= fitted.usual).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, fitted: Toxicity) -> DataFrame:
    """The rows below the threshold of their language, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(fitted.model).values()))
    thresholds, usual = fitted.thresholds, fitted.usual
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(*sent.value)
        for batch in batches:
            own = [thresholds.get(x or "", usual) for x in batch.column("lang").to_pylist()]
            yield batch.filter(pa.array(_scores(model, batch) < np.array(own, np.float64)))

    return docs.mapInArrow(run, schema)
