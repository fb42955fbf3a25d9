"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import per_text, with_answer
from driftline.llm.folds import HELD_OUT, drawn, fold

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Bounds of the training sample: documents over all languages, windows of each document.
SAMPLE_DOCS = 4_000
SAMPLE_WINDOWS = 3
STEPS, BATCH, RATE = 500, 64, 0.01
UNDETERMINED = "und"
_SPACE = 32
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Network:
    """Byte embedding, filters of several widths, max over places, softmax."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        n = len(WIDTHS) * FILTERS
        return cls(languages, rng.normal(0, 0.5, (256, EMBED)).astype(f32),
                   [rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS)).astype(f32)
                    for k in WIDTHS], [np.zeros(FILTERS, f32) for _ in WIDTHS],
                   rng.normal(0, n ** -0.5, (n, len(languages))).astype(f32),
                   np.zeros(len(languages), f32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.dense, self.offset]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Pooled features of byte windows, the places of the maxima, the patches of each width."""
        x = self.embed[windows]
        features, places, patches = [], [], []
        for k, weight, bias in zip(WIDTHS, self.filters, self.biases):
            n = windows.shape[1] - k + 1
            patch = np.concatenate([x[:, j:j + n] for j in range(k)], axis=2)
            out = patch @ weight
            at = out.argmax(axis=1)
            features.append(np.take_along_axis(out, at[:, None], 1)[:, 0] + bias)
            places.append(at)
            patches.append(patch)
        return np.maximum(np.concatenate(features, axis=1), 0), places, patches

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of windows: all widths in one product, zero weights where a filter is narrower."""
        widest = max(WIDTHS)
        weight = np.zeros((widest * EMBED, len(WIDTHS) * FILTERS), np.float32)
        for i, (k, w) in enumerate(zip(WIDTHS, self.filters)):
            weight[:k * EMBED, i * FILTERS:(i + 1) * FILTERS] = w
        bias = np.concatenate(self.biases)
        x = self.embed[np.pad(windows, ((0, 0), (0, widest - 1)), constant_values=_SPACE)]
        n = windows.shape[1]
        patch = np.concatenate([x[:, j:j + n] for j in range(widest)], axis=2)
        pooled = np.maximum((patch.reshape(-1, patch.shape[2]) @ weight)
                            .reshape(len(windows), n, -1).max(axis=1) + bias, 0)
        return softmax(pooled @ self.dense + self.offset)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        pooled, places, patches = self.pooled(windows)
        wrong = softmax(pooled @ self.dense + self.offset)
        wrong[np.arange(len(labels)), labels] -= 1
        wrong /= len(labels)
        back = (wrong @ self.dense.T) * (pooled > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_biases = [], []
        rows = np.arange(len(windows))[:, None]
        for i, (k, weight) in enumerate(zip(WIDTHS, self.filters)):
            part = back[:, i * FILTERS:(i + 1) * FILTERS]
            best = patches[i][rows, places[i]]  # window, filter, patch
            d_filters.append(np.einsum("nf,nfp->pf", part, best))
            d_biases.append(part.sum(axis=0))
            d_patch = part[:, :, None] * weight.T[None]
            for j in range(k):
                np.add.at(d_embed, windows[rows, places[i] + j],
                          d_patch[:, :, j * EMBED:(j + 1) * EMBED])
        return [d_embed, *d_filters, *d_biases, pooled.T @ wrong, wrong.sum(axis=0)]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS,
          seed: int = 7) -> Network:
    """Adam over batches drawn evenly from the languages."""
    net, rng = Network.start(languages, seed), np.random.default_rng(seed)
    groups = [np.flatnonzero(labels == i) for i in range(len(languages))]
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        which = rng.integers(0, len(languages), BATCH)
        rows = np.array([rng.choice(groups[i]) for i in which])
        rate = RATE * (1 - step / (steps + 1))
        for p, a, b, g in zip(params, m, v, net.gradients(windows[rows], labels[rows])):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
                  ).astype(np.float32)
    return net


def padded(pieces: list[bytes]) -> np.ndarray:
    out = np.full((len(pieces), WINDOW), _SPACE, np.uint8)
    for row, piece in zip(out, pieces):
        row[:len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def sample_windows(docs: DataFrame, id_column: str, text_column: str, lang_column: str,
                   sample_docs: int, held_out: int | None) -> tuple[list[bytes], list[str]]:
    """Windows and labels of a bounded sample: at most ``sample_docs`` documents in all.

    Labelled rows outside the held-out fold, as many of each language as far as they go,
    drawn by a hash of the id; windows lie evenly over the whole text.
    """
    labelled = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    if held_out is not None:
        labelled = labelled.where(fold(id_column) != held_out)
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_column).count().collect()}
    if not counts:
        return [], []
    each = max(1, sample_docs // len(counts))
    data = F.col(text_column).cast("binary")
    last = F.greatest(F.octet_length(text_column) - WINDOW, F.lit(0))
    spread = [F.substring(data, (last * i / max(SAMPLE_WINDOWS - 1, 1)).cast("int") + 1, F.lit(WINDOW))
              for i in range(SAMPLE_WINDOWS)]
    rate = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (
        F.lit(k), F.lit(min(1.0, 1.2 * each / n)))]), F.col(lang_column))
    rows = (labelled.where(drawn(id_column, rate))
            .select(F.col(lang_column).alias("lang"), F.xxhash64(id_column, text_column).alias("h"),
                    F.array_distinct(F.array(*spread)).alias("windows"))
            .orderBy("h").limit(2 * sample_docs).collect())
    used: dict[str, int] = {}
    windows, labels = [], []
    for row in rows:
        if used.get(row["lang"], 0) >= each:
            continue
        used[row["lang"]] = used.get(row["lang"], 0) + 1
        for window in row["windows"]:
            if window:
                windows.append(bytes(window))
                labels.append(row["lang"])
    return windows, labels


def noise_windows(windows: list[bytes], count: int, seed: int = 7) -> list[bytes]:
    """Windows that are no language: the bytes of known ones in any order, and any ASCII."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(count):
        known = np.frombuffer(windows[int(rng.integers(len(windows)))], np.uint8)
        out.append((rng.permutation(known) if i % 2 else
                    rng.integers(0x20, 0x7F, len(known), np.uint8)).tobytes())
    return out


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        lang_column: str = "lang", sample_docs: int = SAMPLE_DOCS,
        held_out: int | None = HELD_OUT, noise: bool = False) -> Network | None:
    """A network for the languages of the labelled rows; None without any.

    With ``noise`` it also learns what is no language, and calls it ``und``.
    """
    windows, labels = sample_windows(docs, id_column, text_column, lang_column, sample_docs, held_out)
    if not windows:
        return None
    if noise:
        made = noise_windows(windows, max(1, len(windows) // len(set(labels))))
        windows, labels = windows + made, labels + [UNDETERMINED] * len(made)
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    return train(padded(windows), np.array([number[x] for x in labels]), languages)


def has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER.search(data)) or any(c.isalpha() for c in data.decode("utf-8", "replace"))


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All of the text as windows that overlap by the widest filter less one; their lengths."""
    step = WINDOW - max(WIDTHS) + 1
    count = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded_text = np.full((count - 1) * step + WINDOW, _SPACE, np.uint8)
    padded_text[:len(data)] = np.frombuffer(data, np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(padded_text, WINDOW)[::step]
    lengths = np.minimum(len(data) - step * np.arange(count), WINDOW).astype(np.float32)
    return windows, lengths


def classify(net: Network, data: bytes, most: int = 64) -> tuple[str, float]:
    """The language with the largest mean probability over the text's bytes, and that mean."""
    windows, lengths = windows_of(data)
    total = np.zeros(len(net.languages))
    for at in range(0, len(windows), most):
        total += lengths[at:at + most] @ net.probabilities(windows[at:at + most])
    total /= lengths.sum()
    best = int(total.argmax())
    return net.languages[best], float(min(1.0, total[best]))


def _classifier(docs: DataFrame, net: Network | None):
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def prepare():
        model = shared.value

        def of(data):
            if model is None or data is None or not has_letter(data):
                return UNDETERMINED, 0.0
            return classify(model, data)

        return of

    return prepare


def annotate(docs: DataFrame, net: Network | None, column: str,
             text_column: str = "text") -> DataFrame:
    """``docs`` with a struct column: lang_pred and score of the text, as in :func:`predict`."""
    return with_answer(docs, column, text_column, _classifier(docs, net),
                       {"lang_pred": "string", "score": "double"})


def predict(docs: DataFrame, net: Network | None, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """id, lang_pred, score of every row; ``und`` and 0 for texts without a letter.

    The whole text is read in windows of 256 bytes; nothing but the text is looked at.
    Short texts share batches of windows with their neighbours.
    """
    return per_text(docs, id_column, text_column, _classifier(docs, net),
                    {"lang_pred": "string", "score": "double"}, keep_null=True)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             lang_column: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    The network learns from text and language of labelled rows outside the held-out fold
    (crc32 of the id as text, mod 4, is 2), at most SAMPLE_DOCS of them; the prediction
    sees the text only. Null texts and texts without a letter give ``und`` with score 0,
    and so does every row of a table without labels. Repeated rows repeat their result; an
    empty table gives no rows; other columns are not looked at.
    """
    found = predict(docs, fit(docs, id_column, text_column, lang_column), id_column, text_column)
    return found.select(id_column, (fold(id_column) == HELD_OUT).alias("held_out"),
                        "lang_pred", "score")
