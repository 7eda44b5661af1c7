"""Language identification by a convolutional network over bytes, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, kept, unsigned_crc32

UNKNOWN = "und"
#: Bytes of a window; embedding size; filters per width.
WINDOW, EMBED = 128, 8
FILTERS = {2: 8, 3: 12, 4: 12}
WIDEST = max(FILTERS)
#: The training sample: at most so many documents in all, and windows of each.
DOCUMENTS, WINDOWS = 2400, 12
EPOCHS, BATCH, RATE = 5, 64, 0.01


def has_letter(text: object) -> bool:
    return isinstance(text, str) and any(c.isalpha() for c in text)


def windows(data: bytes) -> np.ndarray:
    """A text's bytes in windows of fixed length, the last one padded with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class Network:
    """Embedding, filters of several widths, their maxima over a window, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = sum(FILTERS.values())
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = np.zeros((WIDEST * EMBED, n), np.float32)
        self.used = np.zeros_like(self.filters)  # narrow filters see the first bytes only
        at = 0
        for width, count in FILTERS.items():
            self.used[: width * EMBED, at : at + count] = 1
            at += count
        self.filters = (rng.normal(0, 0.2, self.filters.shape) * self.used).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, classes)).astype(np.float32)
        self.shift = np.zeros(classes, np.float32)

    def embedded(self, codes: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(codes), WINDOW + WIDEST - 1), np.uint8)
        padded[:, :WINDOW] = codes
        return self.embed[padded]

    @staticmethod
    def seen(x: np.ndarray, t: int) -> np.ndarray:
        """The bytes that filters see at place ``t``, one row per window, without a copy."""
        return np.lib.stride_tricks.as_strided(x[:, t], (len(x), WIDEST * EMBED), (x.strides[0], x.strides[2]))

    def maxima(self, codes: np.ndarray) -> np.ndarray:
        x = self.embedded(codes)
        best = self.seen(x, 0) @ self.filters
        for t in range(1, WINDOW):
            np.maximum(best, self.seen(x, t) @ self.filters, out=best)
        return best

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of the classes per window."""
        hidden = np.maximum(self.maxima(codes) + self.bias, 0)
        return softmax(hidden @ self.out + self.shift)

    def train(self, codes: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
        """Cross-entropy by Adam; gradients reach only each filter's maximal place."""
        names = ["embed", "filters", "bias", "out", "shift"]
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        rng, step = np.random.default_rng(seed), 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(codes))
            for begin in range(0, len(order), BATCH):
                pick = order[begin : begin + BATCH]
                padded = np.zeros((len(pick), WINDOW + WIDEST - 1), np.uint8)
                padded[:, :WINDOW] = codes[pick]
                x = self.embed[padded]
                all_ = np.stack([self.seen(x, t) @ self.filters for t in range(WINDOW)])
                place = all_.argmax(0)
                hidden = np.take_along_axis(all_, place[None], 0)[0] + self.bias
                active = np.maximum(hidden, 0)
                p = softmax(active @ self.out + self.shift)
                p[np.arange(len(pick)), labels[pick]] -= 1
                p /= len(pick)
                back = (p @ self.out.T) * (hidden > 0)
                rows = np.arange(len(pick))[:, None, None]
                span = place[:, :, None] + np.arange(WIDEST)
                views = x[rows, span].reshape(len(pick), place.shape[1], -1)  # window, filter, bytes seen
                grads = {
                    "out": active.T @ p,
                    "shift": p.sum(0),
                    "bias": back.sum(0),
                    "filters": np.einsum("bf,bfe->ef", back, views) * self.used,
                }
                into = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
                embed = np.zeros_like(self.embed)
                np.add.at(embed, padded[rows, span].reshape(-1), into)
                embed[0] = 0
                grads["embed"] = embed
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    size = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                    getattr(self, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / size


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def learnable() -> Column:
    """Rows that the network may learn from: remainder of the id's CRC other than 2."""
    return F.pmod(unsigned_crc32(F.col("doc_id")), F.lit(4)) != 2


def sample(docs: DataFrame, seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and their labels from a bounded sample of labelled rows.

    Of each language the documents with the smallest seeded hashes are taken, so
    many that all languages together have at most ``DOCUMENTS`` (but three
    each); of a document, at most ``WINDOWS`` windows spread over its text.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & learnable() & F.col("text").rlike(r"\p{L}"))
    counts = kept(labelled.groupBy("lang").count())
    languages = sorted(r[0] for r in counts.collect())
    each = max(3, DOCUMENTS // max(1, len(languages)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    ids = labelled.select("lang", "doc_id").withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= each)
    # At most DOCUMENTS ids, so only they are dealt by language and no text is.
    few = F.broadcast(kept(ids.select("lang", "doc_id").distinct()))
    chosen = labelled.join(few, labelled["doc_id"].eqNullSafe(few["doc_id"]) & (labelled["lang"] == few["lang"]), "left_semi")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, doc_id, text in zip(batch["lang"], batch["doc_id"], batch["text"]):
                w = windows(lowered(text))
                for i in np.unique(np.linspace(0, len(w) - 1, WINDOWS).astype(int)):
                    rows.append((lang, doc_id, int(i), w[i].tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "doc_id", "i", "w"])

    found = chosen.select("lang", F.col("doc_id").cast("string"), "text").mapInPandas(cut, "lang string, doc_id string, i int, w binary")
    got = sorted((r.lang, r.doc_id, r.i, bytes(r.w)) for r in found.collect())
    index = {lang: k for k, lang in enumerate(languages)}
    codes = np.frombuffer(b"".join(g[3] for g in got), np.uint8).reshape(-1, WINDOW)
    return languages, codes, np.array([index[g[0]] for g in got], np.int64)


#: Windows that pass the network at once.
AT_ONCE = 512


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (doc_id, text, lang).

    Every byte of every text passes the network; a text's prediction is the
    class with the highest mean probability over its windows, which is the
    score. Null texts and texts without a letter are ``und`` with score 0, and
    so is everything if no row can be learned from. Ties go to the first
    language in code-point order. ``lang``, ``source`` and ids are no inputs of
    a prediction; repeated rows get equal ones; other columns are ignored.
    """
    languages, codes, labels = sample(docs)
    network = Network(max(1, len(languages)))
    if len(codes):
        network.train(codes, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            wanted = [i for i, t in enumerate(texts) if languages and has_letter(t)]
            data = [lowered(texts[i]) for i in wanted]
            for start, end in blocks([len(d) for d in data]):
                parts = [windows(d) for d in data[start:end]]
                sizes = np.array([len(p) for p in parts])
                both = np.concatenate(parts)
                p = np.concatenate([network.predict(both[i : i + AT_ONCE]) for i in range(0, len(both), AT_ONCE)])
                # A window counts by its bytes.
                weight = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(q))) for d, q in zip(data[start:end], parts)])
                total = np.add.reduceat(p * weight[:, None], np.cumsum(sizes) - sizes, axis=0)
                mean = total / np.array([len(d) for d in data[start:end]])[:, None]
                for i, row in zip(wanted[start:end], mean):
                    names[i], scores[i] = languages[int(row.argmax())], min(1.0, float(row.max()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores})

    held = (~learnable()).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held, "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
