"""Language identification by a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of WINDOW bytes. Every byte has an embedding; filters of several widths slide over a window,
each keeps its largest response, and a softmax layer turns those into probabilities. A text's probabilities are the
mean over all its windows, by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMS = 12
SAMPLE = 1200  # labelled rows a language, about: the bound of the training sample
PIECES = 3  # pieces of a row that training takes
PIECE_CHARS = 300
LANGS = 1000  # languages that are learned at most, those with most rows: labels may be dirty
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x DIMS
    convs: list[np.ndarray]  # width x DIMS x FILTERS
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[int], langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> Model:
    """Fit by Adam on random windows of the texts, of random lengths so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    n, k = len(langs), len(WIDTHS) * FILTERS
    params = [rng.normal(0, 0.3, (256, DIMS))]
    params += [rng.normal(0, (2 / (w * DIMS)) ** 0.5, (w, DIMS, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, (1 / k) ** 0.5, (k, n)), np.zeros(n)]
    params = [p.astype(np.float32) for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    y_all, m, step = np.array(labels), len(WIDTHS), 0
    weight = 1 / np.maximum(np.bincount(y_all, minlength=n), 1)
    weight = weight / weight[y_all].mean()
    for _ in range(epochs if len(texts) else 0):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.zeros((len(pick), WINDOW), np.intp)
            for r, i in enumerate(pick):
                size = min(len(texts[i]), int(rng.integers(16, WINDOW + 1)))
                start = int(rng.integers(0, len(texts[i]) - size + 1))
                x[r, :size] = np.frombuffer(texts[i], np.uint8, size, start)
            e = params[0][x]
            e[x == 0] = 0
            tops, wins = [], []
            for c, w in enumerate(WIDTHS):
                cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], 2)
                z = cols @ params[1 + c].reshape(w * DIMS, FILTERS) + params[1 + m + c]
                win = z.argmax(1)
                wins.append(win)
                tops.append(np.take_along_axis(z, win[:, None, :], 1)[:, 0])
            top = np.concatenate(tops, 1)
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ params[-2] + params[-1])
            y = y_all[pick]
            d = p.copy()
            d[np.arange(len(pick)), y] -= 1
            d *= weight[y][:, None] / len(pick)
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = hidden.T @ d, d.sum(0)
            back = (d @ params[-2].T) * (top > 0)
            rows = np.arange(len(pick))[:, None]
            for c, w in enumerate(WIDTHS):
                g, win = back[:, c * FILTERS : (c + 1) * FILTERS], wins[c]
                grads[1 + m + c] = g.sum(0)
                for j in range(w):
                    there = e[rows, win + j]  # batch x filters x dims
                    grads[1 + c][j] = np.einsum("bf,bfd->df", g, there)
                    np.add.at(grads[0], x[rows, win + j], g[:, :, None] * params[1 + c][j].T[None])
            grads[0][0] = 0
            step += 1
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    params[0][0] = 0
    return Model(langs, params[0], params[1 : 1 + m], params[1 + m : 1 + 2 * m], params[-2], params[-1])


class Scorer:
    """Responses by lookup: a filter's response is a sum over its bytes, so those of byte pairs are tabled."""

    def __init__(self, model: Model) -> None:
        self.model = model
        single = [[model.embed @ c[j] for j in range(len(c))] for c in model.convs]
        self.tables = []
        for s in single:
            pairs = [(j, (s[j][:, None, :] + s[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32)) for j in range(0, len(s) - 1, 2)]
            last = [(len(s) - 1, s[-1].astype(np.float32))] if len(s) % 2 else []
            self.tables.append((len(s), pairs, last))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows: rows of WINDOW bytes, 0 beyond a text's end."""
        out = np.empty((len(x), len(self.model.langs)), np.float32)
        for at in range(0, len(x), 256):
            part = x[at : at + 256].astype(np.intp)
            pair = part[:, :-1] * 256 + part[:, 1:]
            tops = []
            for (w, pairs, last), bias in zip(self.tables, self.model.bias, strict=True):
                size = WINDOW - w + 1
                z = np.take(pairs[0][1], pair[:, :size], axis=0)
                for j, t in pairs[1:]:
                    z += np.take(t, pair[:, j : j + size], axis=0)
                for j, t in last:
                    z += np.take(t, part[:, j : j + size], axis=0)
                tops.append(z.max(1) + bias)
            out[at : at + 256] = _softmax(np.maximum(np.concatenate(tops, 1), 0) @ self.model.dense + self.model.dense_bias)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability of each text; "und" and 0 for one without a letter."""
        data = [t.encode() if t and _LETTER.search(t) else b"" for t in texts]
        many = np.array([-(-len(d) // WINDOW) for d in data])
        owner = np.repeat(np.arange(len(data)), many)
        x = np.zeros((len(owner), WINDOW), np.uint8)
        flat = x.reshape(-1)
        start = (np.cumsum(many) - many) * WINDOW
        for d, s in zip(data, start, strict=True):
            flat[s : s + len(d)] = np.frombuffer(d, np.uint8)
        total = np.zeros((len(data), len(self.model.langs)))
        if len(x):
            size = np.minimum(WINDOW, np.array([len(d) for d in data])[owner] - (np.arange(len(owner)) - (np.cumsum(many) - many)[owner]) * WINDOW)
            np.add.at(total, owner, self.windows(x) * size[:, None])
        total /= np.maximum(total.sum(1, keepdims=True), 1e-30)
        best = total.argmax(1)
        seen = many > 0
        return [self.model.langs[b] if s else "und" for b, s in zip(best, seen, strict=True)], [float(total[i, b]) if s else 0.0 for i, (b, s) in enumerate(zip(best, seen, strict=True))]


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, rows: int = SAMPLE) -> tuple[list[bytes], list[int], list[str]]:
    """Pieces of about `rows` documents of each language, chosen by hash; the sample is bounded by rows, LANGS and PIECES * PIECE_CHARS."""
    able = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in able.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGS).collect()}
    if not counts:
        return [], [], []
    key = F.xxhash64(id_col, text_col, F.lit("sample"))
    share = F.coalesce(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, rows / n))])[F.col(lang_col)], F.lit(0.0))
    able = able.where(F.pmod(key, F.lit(1_000_003)) < share * 1_000_003)
    room = F.greatest(F.length(text_col) - PIECE_CHARS, F.lit(0)) + 1
    pieces = F.array(*[F.substr(F.col(text_col), (F.pmod(F.xxhash64(key, F.lit(i)), room) + 1).cast("int"), F.lit(PIECE_CHARS)) for i in range(PIECES)])
    got = able.select(F.col(lang_col).alias("lang"), key.alias("key"), F.explode(F.array_distinct(pieces)).alias("piece")).collect()
    got.sort(key=lambda r: (r["key"], r["piece"]))
    langs = sorted(counts)
    index = {k: i for i, k in enumerate(langs)}
    kept = [(r["piece"].encode(), index[r["lang"]]) for r in got if r["piece"]]
    return [k[0] for k in kept], [k[1] for k in kept], langs


def _predict(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                lang, score = scorer.texts([None if t is None else t for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "held_out": part["held_out"].array, "lang_pred": lang, "score": score})

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from text and language of documents with crc32(id as text) mod 4 other than 2 (a null id counts as the text
    ""); those with 2 are held out. A text that is null or has no letter is "und" with score 0, and so is every text
    where there is nothing to learn from. All windows of a text count, however long it is. Repeated rows each have
    their row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    texts, labels, langs = sample(data.where("not held_out"), "text", "lang", "doc_id", rows)
    rows_out = data.select("doc_id", "text", "held_out")
    if not langs:
        return rows_out.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows_out.mapInPandas(_predict(train(texts, labels, langs)), "doc_id long, held_out boolean, lang_pred string, score double")
