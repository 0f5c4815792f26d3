"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words and pairs of words (A-Z lower-cased) and the single, double and triple n-grams of its
words' forms.  A word's form keeps its symbols and tells runs of lower-case letters (and other
letters beyond ASCII), upper-case letters and digits as one character each; a word equal to one of the two before it has a form of its own.
Each n-gram is hashed to one of 2**BITS places; a place's value is the square root of its share of the text's
n-grams, so every text has length one and a repeated n-gram counts less than in proportion.

Training is online (FTRL-proximal, a learning rate for each place, L1 and L2 terms): one task reads the
examples as a stream, in an order fixed by a hash of the id, and sends the weights that are not zero.  It
learns from at most ``SAMPLE`` labelled documents, those of the least hash (the one bound here, whatever the
table's size); everything else covers all rows.  A score is a sparse dot product of a text's n-grams with the weights, 2**BITS numbers
at most, which ride with the tasks.

Defined results: null text counts as empty, and an empty text has the score of the bias; texts are read whole; rows with no label
(null label or id) are not learned from; of several labels of an id the largest counts, of several texts of an id the least one
is learned from; without any example every score is 0.5; rows that repeat an id are scored each;
an empty table has an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import ship_by_value
from polarity.llm.shingles import hash_words, mix, utf8
from polarity.session import remove_path, table_path, write_table

ship_by_value(__name__)

BITS = 20
SAMPLE = 8000            # labelled documents that are learned from, at most
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 1e-4
WORD_GRAMS, FORM_GRAMS = 2, 3
_ODD = np.random.default_rng(23).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FORM = np.arange(256, dtype=np.uint8)
_FORM[97:123] = _FORM[128:] = 0x80       # lower case and beyond ASCII
_FORM[65:91] = 0x81
_FORM[48:58] = 0x82
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _forms(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of every word's form, in order."""
    form = _FORM[raw]
    stay = np.ones(len(raw), bool)
    stay[1:] = (form[1:] != form[:-1]) | (_SPACES[raw[1:]] != _SPACES[raw[:-1]])
    stay[bounds[:-1][bounds[:-1] < len(raw)]] = True
    return hash_words(form[stay], np.append(0, np.cumsum(stay))[bounds])[0]


def _grams(h: np.ndarray, text: np.ndarray, most: int, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of the n-grams of 1 to ``most`` tokens; none runs from one text to the next."""
    total = h * _ODD[salt]
    yield text, total
    for k in range(1, most):
        whole = text[k:] == text[:-k]
        total = (total[:-1] + h[k:] * _ODD[salt + k])
        yield text[k:][whole], mix(total + _ODD[salt + k])[whole]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, repeats included; number of n-grams of each text) of a column of texts."""
    raw, bounds = utf8(texts)
    h, start = hash_words(raw, bounds)
    text = np.searchsorted(bounds[:-1], start, "right") - 1
    form = _forms(raw, bounds)
    again = np.zeros(len(h), bool)
    for k in (1, 2):
        again[k:] |= (h[k:] == h[:-k]) & (text[k:] == text[:-k])
    form = np.where(again, mix(form + np.uint64(1)), form)
    parts = [*_grams(h, text, WORD_GRAMS, 0), *_grams(form, text, FORM_GRAMS, 8)]
    owner = np.concatenate([p[0] for p in parts])
    place = (mix(np.concatenate([p[1] for p in parts])) >> np.uint64(64 - BITS)).astype(np.int64)
    return owner, place, np.bincount(owner, minlength=len(texts))


def _counted(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, count = np.unique((owner << BITS) | place, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def examples(docs: DataFrame) -> DataFrame:
    """(id, y, place array<int>, value array<float>) of rows (id, y, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                owner, place, size = features(part.column(2))
                owner, place, count = _counted(owner, place)
                offsets = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                value = np.sqrt(count / size[owner]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                                                  pa.ListArray.from_arrays(offsets, pa.array(value))], names=["id", "y", "place", "value"])

    return docs.select("id", "y", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, y int, place array<int>, value array<float>")


class Learner:
    """FTRL-proximal: z and n of every place, the bias (without L1) last."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, place: np.ndarray, value: np.ndarray, y: int) -> None:
        at, x = np.append(place, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass(frozen=True)
class Model:
    place: np.ndarray          # of the weights that are not zero
    weight: np.ndarray
    bias: float
    examples: int = 0

    def scores(self, texts: pa.Array, dense: np.ndarray) -> np.ndarray:
        owner, place, size = features(texts)
        used = dense[place] != 0
        owner, place, count = _counted(owner[used], place[used])
        total = np.full(len(texts), self.bias)
        np.add.at(total, owner, dense[place] * np.sqrt(count / size[owner]))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.place] = self.weight
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Model:
    """The model of the labelled documents: ``labels`` (id, 0 or 1) of those that may be learned from."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = told.withColumn("order", order).orderBy("order", "id").limit(sample)
    # at most ``sample`` rows: small enough to be sent to every task
    some = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen.select("id", "y")), "id")
            .groupBy("id", "y").agg(F.min("text").alias("text")))
    known = write_table(examples(some), "ftrl-examples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, n = Learner(), 0
        for batch in batches:
            y, offsets = batch.column(0).to_pylist(), batch.column(1).offsets.to_numpy()
            place, value = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
            for i, label in enumerate(y):
                learner.learn(place[offsets[i]:offsets[i + 1]].astype(np.int64), value[offsets[i]:offsets[i + 1]].astype(np.float64), int(label > 0))
            n += len(y)
        w = learner.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary()),
                                          pa.array([float(w[-1])]), pa.array([n])], names=["place", "weight", "bias", "n"])

    stream = (known.withColumn("order", order).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
              .repartition(1).sortWithinPartitions("epoch", F.xxhash64("order", "epoch"), "id").select("y", "place", "value"))
    r = stream.mapInArrow(run, "place binary, weight binary, bias double, n bigint").collect()      # one model of bounded size
    remove_path(docs.sparkSession, table_path(known))
    if not r:
        return Model(np.empty(0, np.int32), np.empty(0), 0.0)
    return Model(np.frombuffer(r[0]["place"], np.int32), np.frombuffer(r[0]["weight"], np.float64), r[0]["bias"], r[0]["n"] // EPOCHS)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1), dense))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text (a null id: empty) divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
