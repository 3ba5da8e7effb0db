"""Language identification by interpolated Kneser-Ney models of characters.

For every language n-grams of one to four letters are counted on a bounded sample and
smoothed with an absolute discount; orders below the highest use the number of distinct
letters before an n-gram. The models stand side by side in sorted arrays of n-gram hashes
with one column of log probabilities a language. A text goes to the language with the lowest
cross-entropy a letter; it is rejected as foreign if even that exceeds what calibration texts
of the language reach, and the score is the softmax of the cross-entropies at a temperature
fitted on the calibration texts.

Letters are folded to lower case, everything else is one space. The model is fitted on at
most `per_language` texts of each language (the smallest hashes, each text once, a fifth of
them for calibration); all texts are scored as a whole. A null text or one without letters is
`und` with score 0, and so is every text if no text with a language was given. Rows with a
null language are not learned from. Repeated rows give repeated rows, other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.llm.frame import map_arrow, remainder, settled
from tenantlake.llm.textkit import chunks, mixed, sums_by_text

ORDER = 4
DISCOUNT = 0.75
FLOOR = 1e-4
CHUNK = 1 << 20

_NO_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    return " " + _NO_LETTERS.sub(" ", text.lower()).strip() + " "


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each text starts."""
    lengths = [len(t) for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that starts at each position."""
    n = max(0, len(points) - order + 1)
    out = np.full(n, order, np.uint64)
    for k in range(order):
        out = mixed(out + points[k:k + n].astype(np.uint64))
    return out


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked hashes in sorted ones, and which are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _grams(points: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Distinct n-grams within texts as rows of code points, with their counts last."""
    hashes = gram_hashes(points, order)
    room = np.repeat(starts[1:], np.diff(starts))[:len(hashes)]
    inside = np.flatnonzero(np.arange(len(hashes)) + order <= room)
    _, first, counts = np.unique(hashes[inside], return_index=True, return_counts=True)
    at = inside[first]
    return np.stack([*(points[at + k] for k in range(order)), counts], axis=1).astype(np.int64)


def _smoothed(points: np.ndarray, starts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each order: the n-grams, their discounted share in their context, and the log of
    the mass each context leaves to the lower order."""
    out: list[dict[str, np.ndarray]] = []
    higher = None
    for order in range(ORDER, 0, -1):
        grams = _grams(points, starts, order)
        counts = grams[:, -1].astype(float)
        if higher is not None and len(higher):
            kinds, n_before = np.unique(gram_rows(higher[:, 1:-1]), return_counts=True)
            at, found = _find(kinds, gram_rows(grams[:, :-1]))
            counts = np.where(found, n_before[at], 1).astype(float)
        context = gram_rows(grams[:, :order - 1]) if order > 1 else np.zeros(len(grams), "u8")
        keys, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, counts, minlength=len(keys))
        kinds_after = np.bincount(inverse, minlength=len(keys))
        out.append({"grams": grams[:, :-1], "keys": gram_rows(grams[:, :-1]),
                    "share": np.maximum(counts - DISCOUNT, 0) / total[inverse],
                    "contexts": keys, "left": DISCOUNT * kinds_after / total})
        higher = grams
    return out[::-1]


def gram_rows(rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), rows.shape[1], np.uint64)
    for k in range(rows.shape[1]):
        out = mixed(out + rows[:, k].astype(np.uint64))
    return out


@dataclass
class Models:
    """keys[n], logs[n]: n-grams of order n + 1 seen in any language and their log
    probabilities by language; contexts[n], left[n]: the log mass left by contexts."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    most: np.ndarray | None = None
    sharpness: float = 1.0

    def log_probabilities(self, rows: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last letter of each row given those before."""
        if order == 0:
            return np.full((len(rows), len(self.languages)), np.log(FLOOR))
        at, found = _find(self.keys[order - 1], gram_rows(rows))
        out = self.logs[order - 1][at] if len(self.keys[order - 1]) else np.zeros(
            (len(rows), len(self.languages)))
        missing = np.flatnonzero(~found)
        if len(missing):
            context = (gram_rows(rows[missing, :-1]) if order > 1
                       else np.zeros(len(missing), np.uint64))
            spot, seen = _find(self.contexts[order - 1], context)
            left = np.where(seen[:, None], self.left[order - 1][spot], 0.0)
            out[missing] = left + self.log_probabilities(rows[missing, 1:], order - 1)
        return out

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Nats a letter, a row for each text and a column for each language."""
        points, starts = letters_of(texts)
        padded = np.concatenate((np.full(ORDER - 1, 0x20, np.uint32), points))
        hashes = gram_hashes(padded, ORDER)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rows = np.stack([padded[first + k] for k in range(ORDER)], axis=1)
        values = self.log_probabilities(rows)
        lengths = np.maximum(1, np.diff(starts))
        return -np.stack([sums_by_text(values[inverse, i], starts) / lengths
                          for i in range(len(self.languages))], axis=1)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and rejection of every text."""
        nats = self.cross_entropies(texts)
        best = nats.argmin(axis=1)
        lowest = nats[np.arange(len(best)), best]
        weight = np.exp(-self.sharpness * (nats - lowest[:, None]))
        return best, 1 / weight.sum(axis=1), lowest > self.most[best]


def fit(samples: dict[str, list[str]]) -> Models:
    """Models of normalised texts by language; every fifth text is for calibration."""
    models = Models(sorted(samples))
    held = {x: t[::5] if len(t) >= 5 else t for x, t in samples.items()}
    kept = {x: [u for i, u in enumerate(t) if len(t) < 5 or i % 5] for x, t in samples.items()}
    parts = [_smoothed(*letters_of(kept[x])) for x in models.languages]
    for order in range(1, ORDER + 1):
        own = [p[order - 1] for p in parts]
        keys, first = np.unique(np.concatenate([p["keys"] for p in own]), return_index=True)
        grams = np.concatenate([p["grams"] for p in own])[first]
        contexts = np.unique(np.concatenate([p["contexts"] for p in own]))
        left = np.ones((len(contexts), len(own)))
        share = np.zeros((len(keys), len(own)))
        for i, p in enumerate(own):
            left[_find(contexts, p["contexts"])[0], i] = p["left"]
            share[_find(keys, p["keys"])[0], i] = p["share"]
        context = gram_rows(grams[:, :-1]) if order > 1 else np.zeros(len(keys), np.uint64)
        lower = np.exp(models.log_probabilities(grams[:, 1:], order - 1))
        models.logs.append(np.log(share + left[_find(contexts, context)[0]] * lower))
        models.keys.append(keys)
        models.contexts.append(contexts)
        models.left.append(np.log(left))
    _calibrate(models, held)
    return models


def _calibrate(models: Models, held: dict[str, list[str]], quantile: float = 0.995) -> None:
    nats = {x: models.cross_entropies(held[x]) for x in models.languages}
    models.most = np.array([np.quantile(nats[x][:, i], quantile) * 1.05
                            for i, x in enumerate(models.languages)])
    own = np.concatenate([np.full(len(nats[x]), i) for i, x in enumerate(models.languages)])
    values = np.concatenate([nats[x] for x in models.languages])
    grid = 2.0 ** np.arange(0, 8)

    def loss(k: float) -> float:
        weight = -k * (values - values.min(axis=1, keepdims=True))
        return float((np.log(np.exp(weight).sum(axis=1)) - weight[range(len(own)), own]).mean())

    models.sharpness = float(min(grid, key=loss))


def sample(docs: DataFrame, per_language: int) -> dict[str, list[str]]:
    """At most `per_language` distinct texts of each language, by the smallest hashes."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                         & (remainder("doc_id", 3) != 1))
    keyed = usable.select(F.col("lang").cast("string").alias("lang"), "text",
                          F.xxhash64("text").alias("key"))
    ranked = keyed.select("lang", "key").withColumn("place", F.dense_rank().over(
        Window.partitionBy("lang").orderBy("key")))
    # Written, so its size is known: the texts stay where they are while it is small.
    chosen = settled(ranked.filter(F.col("place") <= per_language).select("lang", "key")
                     .distinct(), "sample")
    rows = (keyed.join(chosen, ["lang", "key"]).dropDuplicates(["lang", "key"])
            .select("lang", "key", "text").toArrow().sort_by([("lang", "ascending"),
                                                             ("key", "ascending")]))
    out: dict[str, list[str]] = {}
    for lang, text in zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True):
        if any(c.isalpha() for c in text):
            out.setdefault(lang, []).append(normalised(text))
    return out


def languages(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score and `foreign` of every document."""
    texts = sample(docs, per_language)
    model = docs.sparkSession.sparkContext.broadcast(vars(fit(texts)) if texts else None)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(**model.value) if model.value else None
        for batch in batches:
            for part, _ in chunks(batch, most=CHUNK):
                texts = [t.as_py() or "" for t in part.column("text")]
                clean = [normalised(t) for t in texts]
                known = [any(c.isalpha() for c in t) for t in texts]
                language, score, foreign = ["und"] * len(texts), [0.0] * len(texts), \
                    [True] * len(texts)
                if models is not None:
                    best, values, far = models.predict(clean)
                    for i in np.flatnonzero(known):
                        language[i] = models.languages[best[i]]
                        score[i], foreign[i] = float(values[i]), bool(far[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"),
                     pa.array(language, pa.string()), pa.array(score, pa.float64()),
                     pa.array(foreign, pa.bool_())],
                    names=["doc_id", "held_out", "lang_pred", "score", "foreign"])

    keyed = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return map_arrow(keyed, identify, "doc_id bigint, held_out boolean, lang_pred string, "
                     "score double, foreign boolean")
