"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of byte n-grams (n = 1 to 4) that both hold, presence and
not counts, divided by the geometric mean of the texts' own numbers. The Nystrom method maps a
text to its kernel with a fixed set of landmark texts, times the inverse root of the landmarks'
own kernel matrix; on those features one ridge regression per language (one versus rest, +-1
targets) is solved in closed form. Texts are scored in batches: presence matrix times landmark
matrix, times the weights. Only n-grams that at least two landmarks hold span the feature
space, of these the COLUMNS that most landmarks hold (of equally many the smaller key), fewer where
there are many landmarks, so that their matrix has CELLS cells at most.

The model is fitted on the driver from a bounded sample (``per_language`` rows of each language). The
distinct n-grams of these rows are staged, the landmarks' n-grams counted in Spark, and what the
driver sees of a row is one bit a column. So neither the model nor a presence matrix, of ROWS rows at
most, follows the length of texts or their number; the driver's share follows the number of
languages. Defined cases: null texts and texts without a letter are ``und`` with score 0, as is all
where no labelled row exists; very long texts are used whole; equal scores go to the alphabetically
first language; a null id is not held out; repeated rows are predicted each and learnt once; extra
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.sampling import first_of_each, held_out, once, per_class
from siltstone.llm.textbytes import flatten, lean, lower_ascii, slices, trim
from siltstone.runtime import small_batches, stage_table

ORDERS = (1, 2, 3, 4)
SLOT_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
#: Rows of a presence matrix, n-grams that span the feature space, and cells of the landmark matrix, at most.
ROWS, COLUMNS, CELLS = 64, 1 << 16, 8 << 20


def lower_latin(raw: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0 to U+00DE."""
    out = lower_ascii(raw)
    second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[second] += 32
    return out


def gram_keys(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the key of the n-gram at each byte, and whether it lies within its text."""
    raw = lower_latin(raw)
    sizes = np.diff(offsets)
    rest = np.repeat(offsets[1:], sizes) - np.arange(len(raw))
    wide = np.pad(raw, (0, 4)).astype(np.uint64)
    key = np.zeros(len(raw), np.uint64)
    for n in ORDERS:
        key = (key << np.uint64(8)) | wide[n - 1 : n - 1 + len(raw)]
        yield key | np.uint64(n << 40), rest >= n


def distinct_grams(raw: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> list[np.ndarray]:
    """The sorted n-gram keys of each text; long texts are taken in parts that overlap."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found = np.empty(0, np.uint64)
        for k in range(a, b, step):
            part = raw[k : min(b, k + step + max(ORDERS) - 1)]
            found = np.union1d(found, np.concatenate([keys[inside] for keys, inside in gram_keys(part, np.array([0, len(part)]))]))
        out.append(found)
    return out


def slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * MULTIPLIER) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Columns:
    """Finds the columns of n-gram keys: a table by slots, and a search for the keys of slots that several keys have."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        place = slots(keys)
        order = np.argsort(place, kind="stable")
        again = np.append(False, place[order][1:] == place[order][:-1])
        self.table = np.full(1 << SLOT_BITS, -1, np.int32)
        self.table[place[order[~again]]] = order[~again]
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[place[order[again]]] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` of those that have a column, and the columns."""
        place = slots(keys)
        column = self.table[place]
        at = np.flatnonzero(column >= 0)
        column = column[at]
        right = self.keys[column] == keys[at]
        other = at[~right]
        other = other[self.crowded[place[other]]]
        late = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
        good = self.keys[late] == keys[other]
        return np.concatenate([at[right], other[good]]), np.concatenate([column[right], late[good]])


@dataclass
class Model:
    languages: list[str]
    columns: Columns
    landmarks: np.ndarray  # columns x landmarks, scaled by 1 / sqrt(own number)
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return self.columns.keys

    def presence(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, width = len(offsets) - 1, len(self.keys)
        out = np.zeros(n * width, np.float32)
        base = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(offsets))
        for keys, inside in gram_keys(raw, offsets):
            some = np.flatnonzero(inside)
            at, column = self.columns.find(keys[some])
            out[base[some[at]] + column] = 1
        return out.reshape(n, width)

    def kernel(self, held: np.ndarray) -> np.ndarray:
        """Kernel values of presence rows with the landmarks."""
        return (held @ self.landmarks) / np.sqrt(np.maximum(1, held.sum(axis=1)))[:, None]

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Regression values (texts x languages)."""
        out = np.empty((len(offsets) - 1, len(self.languages)), np.float32)
        for k in range(0, len(out), ROWS):
            cut = offsets[k : k + ROWS + 1]
            out[k : k + ROWS] = self.kernel(self.presence(raw[cut[0] : cut[-1]], cut - cut[0])) @ self.weights + self.bias
        return out


def per_landmark(languages: int, landmarks: int) -> int:
    """Landmarks of each language."""
    return max(2, landmarks // max(1, languages))


def column_count(landmarks: int) -> int:
    return max(1, min(COLUMNS, CELLS // max(1, landmarks)))


def fit(texts: list[bytes], labels: list[str], landmarks: int = 128, ridge: float = 1e-3, least: int = 2) -> Model | None:
    """``fit_bits`` on whole texts, the first of each language being its landmarks."""
    grams = [distinct_grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    languages = sorted(set(labels))
    if not languages:
        return None
    share = per_landmark(len(languages), landmarks)
    chosen = [g for lang in languages for g in [g for g, x in zip(grams, labels, strict=True) if x == lang][:share]]
    keys, held_by = np.unique(np.concatenate(chosen), return_counts=True)
    keys, held_by = (x[held_by >= (least if len(chosen) > 8 else 1)] for x in (keys, held_by))
    keys = np.sort(keys[np.lexsort((keys, -held_by))[: column_count(len(chosen))]])
    return fit_bits(keys, [_bits(keys, g) for g in grams], labels, share, ridge)


def _bits(keys: np.ndarray, grams: np.ndarray) -> bytes:
    """Which of the sorted ``keys`` a text's sorted n-grams have."""
    return np.packbits(np.isin(keys, grams, assume_unique=True)).tobytes()


def fit_bits(keys: np.ndarray, bits: list[bytes], labels: list[str], share: int, ridge: float = 1e-3) -> Model | None:
    """The model from rows given by which of ``keys`` they hold; the first ``share`` of each language are its landmarks."""
    languages = sorted(set(labels))
    if not languages or not len(keys):
        return None
    by = {lang: [k for k, x in enumerate(labels) if x == lang] for lang in languages}
    chosen = [k for lang in languages for k in by[lang][:share]]

    def rows(which: list[int]) -> np.ndarray:
        packed = np.frombuffer(b"".join(bits[k] for k in which), np.uint8).reshape(len(which), -1)
        return np.unpackbits(packed, axis=1, count=len(keys)).astype(np.float32)

    model = Model(languages, Columns(keys), np.zeros((len(keys), len(chosen)), np.float32), np.zeros((0, 0)), np.zeros(0))
    for k in range(0, len(chosen), ROWS):
        part = rows(chosen[k : k + ROWS])
        model.landmarks[:, k : k + ROWS] = (part / np.sqrt(np.maximum(1, part.sum(axis=1)))[:, None]).T
    inner = (model.landmarks.T @ model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nystrom map: kernel row @ root
    kernel = np.concatenate([model.kernel(rows(list(range(k, min(len(bits), k + ROWS))))) for k in range(0, len(bits), ROWS)])
    features = kernel.astype(np.float64) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Languages count alike, whatever their share of the sample.
    weight = np.array([len(bits) / (len(languages) * len(by[x])) for x in labels])[:, None]
    mean = (features * weight).sum(0) / weight.sum()
    middle = (target * weight).sum(0) / weight.sum()
    centred = features - mean
    solved = np.linalg.solve(centred.T @ (centred * weight) + ridge * len(bits) * np.eye(centred.shape[1]), centred.T @ ((target - middle) * weight))
    model.weights = (root @ solved).astype(np.float32)
    model.bias = (middle - mean @ solved).astype(np.float32)
    return model


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in batch.column("grams"):
            keys = np.frombuffer(held.as_buffer(), "<u8").astype(np.int64)
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)])], ["key"])


def _marked(keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_bits(keys, np.frombuffer(g.as_buffer(), "<u8")) for g in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(held, pa.binary())], ["lang", "h", "bits"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    seen: set[int] = set()
    for batch in batches:
        for part in slices(first_of_each(batch, "h", seen), "text", 256 << 10):
            held = [g.astype("<u8").tobytes() for g in distinct_grams(*flatten(part.column("text")))]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(held, pa.binary())], ["lang", "h", "grams"])
    trim()


def train(docs: DataFrame, per_language: int = 250, landmarks: int = 128) -> Model | None:
    """Fit on about ``per_language`` rows of each language with a non-null lang that are not held out."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = known.select("lang", "text", F.xxhash64("doc_id", "text", "lang", F.lit(7)).alias("h"))
    # Equal rows, however many, are one row of the sample.
    chosen = stage_table(once(per_class(rows, "lang", "h", per_language).mapInArrow(_grams, "lang string, h long, grams binary"), "h"), "grams")
    share = per_landmark(chosen.select("lang").distinct().count(), landmarks)
    first = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= share)
    n = first.count()
    counted = first.select("grams").mapInArrow(_exploded, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= (2 if n > 8 else 1))
    keys = np.array(sorted(r["key"] for r in counted.orderBy(F.desc("n"), "key").limit(column_count(n)).collect()), np.uint64)
    got = sorted(chosen.mapInArrow(_marked(keys), "lang string, h long, bits binary").collect(), key=lambda r: (r["h"], r["lang"]))
    return fit_bits(keys, [bytes(r["bits"]) for r in got], [r["lang"] for r in got], share)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])[offsets]
    out = np.diff(seen) > 0
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 256 << 10):
            yield part.filter(pa.array(has_letter(*flatten(part.column("text")))))
    trim()


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds a letter."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_lettered, docs.schema)


def _predictor(shared, keep: list[int]):
    """Appends the predictions to the columns at ``keep``."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        model: Model | None = shared.value
        for batch in batches:
            for part in slices(batch, "text", 256 << 10):
                raw, offsets = flatten(part.column("text"))
                language, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                lettered = has_letter(raw, offsets)
                if model is not None and lettered.any():
                    values = model.scores(*flatten(part.column("text").filter(pa.array(lettered))))
                    best = values.argmax(axis=1)
                    language[lettered] = np.array(model.languages, object)[best]
                    score[lettered] = np.clip((values.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)
                names = [part.schema.names[k] for k in keep]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(language, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])
        trim()

    return predict


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows of ``docs`` with lang_pred and score, which replace columns of these names."""
    small_batches(docs.sparkSession)
    keep = [k for k, c in enumerate(docs.columns) if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema.fields[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model), keep), schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    return identify(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
