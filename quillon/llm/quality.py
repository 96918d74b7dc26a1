"""Operator 7: a compression classifier for text quality.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is cut into
blocks, all of which are compressed with both. The difference of the two sizes over their sum, with the
compressed share of the text, goes through a logistic curve that is fitted on labelled texts the
dictionaries have not seen. The sample holds both classes in equal numbers; the curve's level is then moved
by the odds of all training labels, which makes the score a probability.

The model is fitted on a bounded sample: at most ``sample`` labelled documents of each class, in the
order of a hash of their ids, and of these at most half of ``sample_bytes`` for each class. Scores cover all
documents and whole texts.

Defined results: null and empty texts have no blocks and get the smoothed share of good labels; labels that
contradict each other or are null don't count; of rows that repeat a labelled id, the smallest text is learned;
without labels, or with one class only, every score is the smoothed share of good labels; an empty table
gives no rows; other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, held_out, written
from .workers import claim, lean


@dataclass
class Model:
    """Two dictionaries, and the curve's weights over scaled features; ``prior`` alone if there are no dictionaries."""

    good: bytes | None
    bad: bytes | None
    raw: bool
    weights: list[float]
    centre: list[float]
    scale: list[float]
    prior: float
    block: int
    level: int


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        if model.good is not None:
            import zstandard as zs

            kind = zs.DICT_TYPE_RAWCONTENT if model.raw else zs.DICT_TYPE_FULLDICT

            def press(content: bytes):
                d = zs.ZstdCompressionDict(content, dict_type=kind)
                d.precompute_compress(level=model.level)
                return zs.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

            self.good, self.bad = press(model.good), press(model.bad)

    def features(self, text: str | None) -> list[float]:
        """Normalised size difference and compressed share."""
        data, g, b = (text or "").encode(), 0, 0
        for i in range(0, len(data), self.m.block):
            piece = data[i: i + self.m.block]
            g += len(self.good(piece))
            b += len(self.bad(piece))
        return [(b - g) / (b + g), (b + g) / (2 * len(data))] if data else [0.0, 0.0]

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (_expand(features) - self.m.centre) / self.m.scale
        return _curve(np.c_[np.ones(len(x)), x] @ np.array(self.m.weights))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.m.good is None:
            return np.full(len(texts), self.m.prior)
        out = self.scores(np.array([self.features(t) for t in texts]).reshape(-1, 2))
        out[[not t for t in texts]] = self.m.prior
        return out


def _expand(f: np.ndarray) -> np.ndarray:
    d, r = f[:, 0], f[:, 1]
    return np.c_[d, r, d * d, d * r, r * r]


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _penalised_loss(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: np.ndarray) -> float:
    return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum())


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, bool]:
    """Logistic regression with a ridge on all weights but the first; and whether it has settled.

    Newton's steps are halved until the penalised loss falls far enough, so it never rises, and the
    ridge keeps the smallest loss at finite weights even where the classes can be told apart without error.
    """
    x = np.c_[np.ones(len(x)), x]
    keep = np.full(x.shape[1], float(ridge))
    keep[0] = 1e-3  # the first weight is the level of the curve; it is finite in one-class samples too
    w = np.zeros(x.shape[1])
    z = x @ w
    loss = _penalised_loss(z, y, w, keep)
    for _ in range(steps):
        p = _curve(z)
        slope = x.T @ (p - y) + keep * w
        if np.abs(slope).max() < tolerance * max(1, len(y)):
            return w, True
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-12)[:, None]).T @ x + np.diag(keep), -slope)
        gain, size = float(slope @ step), 1.0
        while size > 1e-10:
            tried = w + size * step
            z2 = x @ tried
            new = _penalised_loss(z2, y, tried, keep)
            if new <= loss + 1e-4 * size * gain:
                break
            size /= 2
        else:
            return w, False
        w, z, loss = tried, z2, new
    return w, False


def fit(texts: list[str | None], labels: list[int], *, counts: tuple[int, int] | None = None, dict_bytes: int = 256 << 10,
        block: int = 512, level: int = 3) -> Model:
    """Two thirds of each class's texts, in their order, make the dictionaries; every third fits the curve.

    ``counts`` are the numbers of bad and good labels that the texts were drawn from; by default those of the texts.
    """
    import zstandard as zs

    y = np.array(labels, dtype=float)
    bad_n, good_n = counts or (int((y == 0).sum()), int((y == 1).sum()))
    prior = (good_n + 1) / (bad_n + good_n + 2)
    rank = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    for_curve = rank % 3 == 0
    parts = [[t.encode() for t, v, c in zip(texts, labels, for_curve, strict=True) if t and v == k and not c] for k in (1, 0)]
    if not all(parts):
        return Model(None, None, True, [], [], [], prior, block, level)
    cut = [[x[i: i + block] for x in p for i in range(0, len(x), block)] for p in parts]
    try:
        good, bad = (zs.train_dictionary(dict_bytes, c, level=level).as_bytes() for c in cut)
        raw = False
    except zs.ZstdError:  # too few texts to choose from: their contents are the dictionaries
        good, bad = (b"".join(c)[:dict_bytes] for c in cut)
        raw = True
    model = Model(good, bad, raw, [], [0.0] * 5, [1.0] * 5, prior, block, level)
    held = [i for i in range(len(y)) if for_curve[i]] or list(range(len(y)))
    s = Scorer(model)
    x = _expand(np.array([s.features(texts[i]) for i in held]))
    model.centre, model.scale = x.mean(0).tolist(), np.maximum(x.std(0), 1e-9).tolist()
    weights, settled = _fit_curve((x - model.centre) / model.scale, y[held])
    if not settled:  # the difference alone
        short, settled = _fit_curve(((x - model.centre) / model.scale)[:, :1], y[held])
        weights = np.append(short, np.zeros(4))
        if not settled:
            raise RuntimeError("the curve of the quality score did not settle")
    # From the odds of the sample to those of all training labels.
    sampled = ((y[held] == 1).sum() + 1) / ((y[held] == 0).sum() + 1)
    weights[0] += np.log((good_n + 1) / (bad_n + 1)) - np.log(sampled)
    model.weights = weights.tolist()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int,
                    sample_bytes: int) -> tuple[list, list, tuple[int, int]]:
    """Texts and labels of training documents, good and bad in turn, and the numbers of bad and good labels."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("lid")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2")
    known = written(known.select("lid", F.col("y").cast("int").alias("y")), "labels")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = [known.where(F.col("y") == k).orderBy(F.xxhash64("lid"), "lid").limit(sample) for k in (0, 1)]
    chosen = ids[0].unionByName(ids[1])  # at most twice ``sample`` rows
    rows = docs.select(F.col(id_col).alias("lid"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "lid")
    # Written, so that the documents are read once.
    rows = written(rows.groupBy("lid", "y").agg(F.min("text").alias("text")), "labelled-texts", known)
    # One class after the other, so that the size bound cuts both alike.
    parts: dict[int, list] = {0: [], 1: []}
    for k in (0, 1):
        size = 0
        for r in rows.where(F.col("y") == k).select("text").orderBy(F.xxhash64("lid"), "lid").toLocalIterator():
            size += len((r.text or "").encode())
            if size > sample_bytes // 2:
                break
            parts[k].append(r.text)
    discard(rows)
    turn = sorted((i, k, t) for k, p in parts.items() for i, t in enumerate(p) if t is not None)
    return [t for _, _, t in turn], [k for _, k, _ in turn], (totals.get(0, 0), totals.get(1, 0))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = 2000, sample_bytes: int = 24 << 20) -> Model:
    texts, y, counts = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample, sample_bytes=sample_bytes)
    return fit(texts, y, counts=counts)


_SCORERS: dict[bytes, Scorer] = {}


def _scorer(blob: bytes) -> Scorer:
    """One scorer for each worker process and model."""
    claim("scorer", _SCORERS.clear)
    if blob not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[blob] = Scorer(pickle.loads(blob))
    return _SCORERS[blob]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``doc_id, score``, or ``columns`` of the documents and the score."""
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(pickle.dumps(model))  # two dictionaries of a fixed size
    keep = [docs[c] for c in columns] if columns is not None else [docs[id_col].alias("doc_id")]
    src = docs.select(*keep, docs[text_col].cast("string").alias("_score_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scorer(blob.value)
        for b in batches:
            got = pa.array(s.score(b.column(b.num_columns - 1).to_pylist()), type=pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], names=schema.names)

    return src.mapInArrow(lean(run, "scorer"), schema)


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Documents with at least this score, with all their columns."""
    scored = score(docs, model, text_col=text_col, columns=docs.columns)
    return scored.where(F.col("score") >= least).drop("score") if "score" not in docs.columns else _keep_named(docs, model, text_col, least)


def _keep_named(docs: DataFrame, model: Model, text_col: str, least: float) -> DataFrame:
    """As keep_good, for tables that have a column ``score`` of their own."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = keep_good(plain, model, text_col=f"c{docs.columns.index(text_col)}", least=least)
    return kept.toDF(*docs.columns)
