"""Language identification with string kernels.

Kernel: the blended spectrum of presence bits, k(x, y) = number of code point n-grams (n = 2, 3, 4)
that both lower-cased texts contain, normalised by sqrt(k(x, x) k(y, y)). N-grams are hashed to
``DIM`` presence bits, so a text of any length is one bit row and nothing is cut off.
Model: Nyström features over ``landmarks`` texts, one-versus-rest kernel ridge regression on them.
A batch is scored as P @ L.T (kernel to the landmarks), normalised, times one small matrix.

Fitting takes at most ``max_rows`` labelled rows in all, an equal share for each language, picked
by hash: the bound of the model, documented here; prediction covers every row. The fitting rows
reach the driver as bit rows of DIM / 8 bytes, never as texts.

Defined results: a null text or one without a letter gives ``und`` with score 0; without any
labelled row every prediction is ``und``; repeated rows get equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 14
ORDERS = (2, 3, 4)
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presence(texts: list[str | None]) -> np.ndarray:
    """Bit rows (0/1, uint8) of the hashed n-grams of each text."""
    rows = np.zeros((len(texts), DIM), np.uint8)
    for row, text in zip(rows, texts):
        if not text:
            continue
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
        code = points * _MULTIPLIERS[0]
        for n in range(2, ORDERS[-1] + 1):
            if len(points) < n:
                break
            code = (code[:-1] ^ (code[:-1] >> 15)) * _MULTIPLIERS[n - 2 & 3] + points[n - 1 :] * _MULTIPLIERS[n - 1] + np.uint32(n)
            mixed = code ^ (code >> 16)
            row[(mixed * np.uint32(0x7FEB352D)) >> np.uint32(18)] = 1
    return rows


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray  # landmarks x languages

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return _kernel(bits, np.unpackbits(self.landmarks, axis=1)) @ self.weights


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float32), y.astype(np.float32)
    norm = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / norm


def fit_rows(bits: np.ndarray, langs: list[str], *, landmarks: int = 128, ridge: float = 1e-3, seed: int = 7) -> Model:
    names = sorted(set(langs))
    y = np.array([[float(a == b) for b in names] for a in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(langs))
    share = -(-landmarks // len(names))
    picked = np.concatenate([[i for i in order if langs[i] == name][:share] for name in names]).astype(int)
    base = bits[picked]
    values, vectors = np.linalg.eigh(_kernel(base, base).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: kernel to the landmarks -> features
    features = _kernel(bits, base).astype(np.float64) @ root
    counts = y.sum(0)
    weight = (y / counts).sum(1)  # each language weighs the same
    gram = features.T @ (features * weight[:, None]) + ridge * len(names) * np.eye(root.shape[1])
    solved = np.linalg.solve(gram, features.T @ (y * weight[:, None]))
    return Model(names, np.packbits(base, axis=1), (root @ solved).astype(np.float32))


def _bits(df: DataFrame) -> DataFrame:
    """(lang, text, draw) -> lang, bits, draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                packed = np.packbits(presence(part.column(1).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), part.column(2)], names=["lang", "bits", "draw"])

    return df.mapInArrow(run, "lang string, bits binary, draw double")


def fit(labelled: DataFrame, key: Column, *, text_col: str = "text", lang_col: str = "lang", max_rows: int = 3000, landmarks: int = 128) -> Model:
    """Fit on at most ``max_rows`` rows of ``labelled``; ``key`` orders the draw and is no input of the model.

    One narrow pass counts the languages, a second reads the texts of the drawn rows only.
    Of more than ``max_rows`` languages the most frequent are learned.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()}
    if not counts:
        return Model([], np.zeros((1, DIM // 8), np.uint8), np.zeros((1, 0), np.float32))
    share = max(1, max_rows // len(counts))
    draw = F.pmod(F.xxhash64(key.cast("string"), F.col(text_col)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    lim = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.5 * share / n))]), F.col(lang_col))
    drawn = usable.where(F.col(lang_col).isin(list(counts))).where(draw < lim)
    # Ordered before it is cut: repeated rows are drawn together and may exceed the share, and the model must not hang on the order of tasks.
    rows = _bits(drawn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))).orderBy("draw", "lang", "bits").limit(2 * max_rows).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    rng, kept = np.random.default_rng(11), []
    for lang in sorted(counts):
        own = [r for r in rows if r["lang"] == lang]
        kept += [own[i] for i in rng.permutation(len(own))[:share]]
    if not kept:
        return Model([], np.zeros((1, DIM // 8), np.uint8), np.zeros((1, 0), np.float32))
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in kept), np.uint8).reshape(len(kept), -1), axis=1)
    return fit_rows(bits, [r["lang"] for r in kept], landmarks=landmarks)


def predict(df: DataFrame, model: Model, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` (0 to 1) for every row."""
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("rename lang_pred and score first")
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.landmarks, model.weights))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        base = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        scale = np.sqrt(np.maximum(base.sum(1), 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(len(keep)).to_pylist()
                bits = presence(texts).astype(np.float32)
                kernel = (bits @ base.T) / (np.sqrt(np.maximum(bits.sum(1), 1))[:, None] * scale[None, :])
                scores = kernel @ model.weights
                known = [bool(model.langs) and bool(t) and _LETTER.search(t) is not None for t in texts]
                best = scores.argmax(1) if model.langs else np.zeros(len(texts), int)
                langs = [model.langs[b] if k else UNDETERMINED for b, k in zip(best, known)]
                top = [float(min(1.0, max(0.0, scores[i, b]))) if known[i] else 0.0 for i, b in enumerate(best)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(langs, pa.string()), pa.array(top, pa.float64())], names=[*keep, "lang_pred", "score"])

    return df.select(*keep, F.col(text_col).alias("text__")).mapInArrow(run, schema)


def held_out_flag(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3; a null id is held out, so never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def documents_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the documents not held out."""
    flagged = docs.select("doc_id", "text", "lang", held_out_flag().alias("held_out"))
    model = fit(flagged.where(~F.col("held_out")), F.col("doc_id"))
    return predict(flagged, model, ["doc_id", "held_out"])
