"""Quality by co-training: two views of a document teach each other and are then combined.

One view is the text (statistics of its characters, words and lines, and the presence of telling words and word
beginnings); the other is what the page's record says without its text (source, language, length). Each view has a
logistic model trained in numpy. Per round, each view scores all unlabelled documents, and some of those that it is sure
of, drawn by hash, teach the other view. Held-out labelled documents calibrate each view and fit the weights of their
sum.

The rows that a model is fitted on are bounded by parameters: `labelled` labelled documents, and `told` documents that a
view passes on in a round, both drawn by hash over all rows. Features of all documents are computed once and staged;
rounds read these alone, without a shuffle. Scoring is one pass over all documents and whole texts.

A document is good if its label says quality 1 and none of the `against` columns (toxic) is set. Defined results: null
and empty texts are scored like any other, null metadata is a value of its own; rows are scored one by one, equal rows
alike; labels that contradict each other count as bad; null labels and labels of unknown documents are unused; without
labels of both kinds every document is kept with the share of good labels (1 if there are none); an empty table gives
no rows; extra columns stay."""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed

_STATISTICS = 12
_KEEP = bytes(b for b in range(256) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b in b" \t\r\n"))
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SIGNS = string.punctuation + "«»„“”¿¡…–—"


def statistics(text: str) -> list[float]:
    """Shares and lengths that tell prose from tables, shouting, symbols and loops; the same at any text length."""
    raw = text.encode("utf-8", "replace")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, w, m = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    signs = n - len(raw.translate(None, _KEEP))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        signs / n,
        (n - len(raw.translate(None, _UPPER))) / n,
        (n - len(raw.translate(None, _DIGIT))) / n,
        raw.count(b"|") / w,
        (raw.count(b"!") + raw.count(b"?")) / w,
        raw.count(b".") / w,
        len(set(words)) / w,
        len(set(words)) / w**0.8,
        same / w,
        len(set(lines)) / m,
        sum(map(len, words)) / w,
        w / m,
    ]


def terms(text: str) -> set[str]:
    """The different words, cleared of signs at their edges, and the first five letters of longer ones."""
    words = {x.strip(_SIGNS) for x in set(text.lower().split())}
    return words | {f"^{x[:5]}" for x in words if len(x) > 5}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and, last, the bias: accelerated full-batch descent on the mean loss with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = weight / weight.sum()
    rate = 1 / (0.25 * float(((x * x).sum(1) * weight).sum()) + penalty)
    w = v = np.zeros(x.shape[1])
    for step in range(steps):
        gradient = x.T @ ((_sigmoid(x @ v) - y) * weight) + penalty * np.append(v[:-1], 0)
        last, w = w, v - rate * 4 * gradient if step > 20 else v - rate * gradient
        v = w + step / (step + 3) * (w - last)
    return w


@dataclass
class Bins:
    """Numbers as one-hot quantile bins, whose edges come from the sample."""

    edges: list[np.ndarray]

    @classmethod
    def of(cls, values: np.ndarray, bins: int) -> "Bins":
        return cls([np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in values.T])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return np.hstack([np.eye(len(e) + 1, dtype=np.float32)[np.searchsorted(e, column, side="right")] for e, column in zip(self.edges, values.T, strict=True)])


#: Held-out labels that a view must be sure of before it teaches.
BORNE_OUT = 5


@dataclass
class Views:
    """Both views' features. All sizes are fixed: `vocabulary` terms, `slots` hashed metadata values."""

    vocabulary: list[str]
    text_bins: Bins
    length_bins: Bins
    slots: int = 256
    index: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.index = {t: i for i, t in enumerate(self.vocabulary)}

    def text(self, texts: list[str]) -> np.ndarray:
        present = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        known = self.index.keys()
        for row, t in zip(present, texts, strict=True):
            row[[self.index[x] for x in terms(t) & known]] = 1
        return np.hstack([self.text_bins(np.array([statistics(t) for t in texts]).reshape(-1, _STATISTICS)), present])

    def metadata(self, columns: list[list], lengths: list) -> np.ndarray:
        out = np.zeros((len(lengths), self.slots), np.float32)
        rows = np.arange(len(lengths))
        values = [[f"{k}={v}" for v in column] for k, column in enumerate(columns)]
        for column in [*values, *([" ".join(x) for x in zip(*values, strict=True)] for _ in [0] if len(values) > 1)]:
            out[rows, [zlib.crc32(v.encode()) % self.slots for v in column]] = 1
        return np.hstack([self.length_bins(_lengths(lengths)), out])


def _lengths(values: list) -> np.ndarray:
    return np.log1p(np.maximum(0, np.nan_to_num(np.array([0 if v is None else v for v in values], np.float64)))).reshape(-1, 1)


@dataclass
class CoTrained:
    """The fitted views and their combination."""

    views: Views | None
    models: list[np.ndarray]
    scales: list[tuple[float, float]]
    joint: np.ndarray
    base: float = 1.0
    rounds: list[dict] = field(default_factory=list)

    def logits(self, features: list[np.ndarray]) -> list[np.ndarray]:
        raw = [x @ m[:-1] + m[-1] for x, m in zip(features, self.models, strict=True)]
        return [a * r + b for r, (a, b) in zip(raw, self.scales, strict=True)]

    def score(self, texts: list[str], columns: list[list], lengths: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good: by the text, by the metadata, by both."""
        if self.views is None:
            same = np.full(len(texts), self.base)
            return same, same, same
        logits = self.logits([self.views.text(texts), self.views.metadata(columns, lengths)])
        both = self.joint[0] * logits[0] + self.joint[1] * logits[1] + self.joint[2]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(both)


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate logits; targets are drawn in a little, so that separable data stay finite."""
    if y.min() == y.max():
        return 1.0, 0.0
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1e-6, float(logit.std()))
    a, b = fit_logistic((logit / scale)[:, None], target, np.ones(len(y)), 1e-6, 500)
    return max(0.0, float(a / scale)), float(b)


def co_train(views: Views, features: list[np.ndarray], y: np.ndarray, held: np.ndarray, rounds: int, pick) -> CoTrained:
    """features, y: labelled rows, of which `held` calibrates. pick(logits, rate, turn): for each view, the rows that it
    is sure of as features of the other view, and what it says of them; logits: weights of each view, calibrated."""
    train = ~held
    extra = [[(f[:0], y[:0])] for f in features]
    rate, log = float(y[train].mean()), []

    def fit(k: int) -> np.ndarray:
        x, target = (np.concatenate(z) for z in zip(*extra[k], strict=True))
        weight = np.concatenate([np.ones(train.sum()), np.full(len(target), 0.5)])
        return fit_logistic(np.vstack([features[k][train], x]), np.concatenate([y[train], target]), weight)

    models = [fit(k) for k in (0, 1)]
    for turn in range(rounds):
        logits = []
        for k in (0, 1):
            a, b = _platt(features[k][held] @ models[k][:-1] + models[k][-1], y[held])
            logits.append(np.append(models[k][:-1] * a, models[k][-1] * a + b))
        told = pick(logits, rate, turn)
        for k in (0, 1):
            extra[1 - k].append(told[k])
        log.append({"text_told": len(told[0][1]), "metadata_told": len(told[1][1])})
        models = [fit(k) for k in (0, 1)]
    out = CoTrained(views, models, [(1.0, 0.0)] * 2, np.array([1.0, 1.0, 0.0]), rate, log)
    out.scales = [_platt(x, y[held]) for x in out.logits([f[held] for f in features])]
    joined = np.array(out.logits([f[held] for f in features])).T
    spread = np.maximum(1e-6, joined.std(0))
    good, bad = y[held].sum(), held.sum() - y[held].sum()
    target = np.where(y[held] > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    w = fit_logistic(joined / spread, target, np.ones(held.sum()), 1e-4, 500)
    out.joint = np.array([*np.maximum(0, w[:2] / spread), w[2]])
    return out


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    labelled: int = 6000,
    told: int = 1500,
    vocabulary: int = 1024,
    rounds: int = 3,
    sure: float = 0.97,
    against: tuple[str, ...] = ("toxic",),
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("source", "lang"),
    length_col: str = "n_chars",
) -> CoTrained:
    """Fits on `labelled` labelled documents, drawn by the hash of their ids, and `told` more for each view and round,
    drawn by hash from all unlabelled documents that the other view is `sure` of, as many good and bad ones as the
    labels' rates give. A view teaches good or bad documents only where held-out labels bear its sureness out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    good = F.col("quality") == 1
    for column in against:
        good = good & ~F.coalesce(F.col(column) != 0, F.lit(False))
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), good.cast("int").alias("good"))
    known = known.groupBy("label_id").agg(F.min("good").alias("good"))
    # Ids of the sample: `labelled` at most, so they may be broadcast, and no text moves to find them.
    ids = docs.select(F.col(id_col).alias("label_id")).where("label_id is not null").distinct()
    by_hash = F.xxhash64(F.col("label_id"), F.lit("quality"))
    chosen = scratch.stage(known.join(ids, "label_id").orderBy(by_hash, "label_id").limit(labelled), "labelled")
    metas = [f"meta{k}" for k in range(len(meta_cols))]
    plain = [F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).cast("string").alias(m) for c, m in zip(meta_cols, metas, strict=True)], F.col(length_col).cast("double").alias("length")]
    sample = docs.join(F.broadcast(chosen), docs[id_col] == chosen["label_id"]).select("label_id", "good", *plain)
    sample = scratch.stage(sample.groupBy("label_id").agg(F.min(F.struct("text", *metas, "length", "good")).alias("s")).select("label_id", "s.*"), "sample")

    kinds = {r["good"]: r["count"] for r in sample.groupBy("good").count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        base = 1.0 if not kinds.get(0) else 0.0
        return CoTrained(None, [], [], np.zeros(3), base)

    # The terms whose presence differs most between good and bad documents, counted where the documents are.
    split = F.pandas_udf(lambda texts: texts.map(lambda t: sorted(terms(t))), "array<string>")
    counts = sample.select("good", F.explode(split("text")).alias("term")).groupBy("term").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    lift = F.abs(F.ln((F.col("g") + 1.0) / (kinds[1] + 2.0)) - F.ln((F.col("b") + 1.0) / (kinds[0] + 2.0))) * F.sqrt(F.col("g") + F.col("b"))
    telling = counts.where((F.col("g") + F.col("b") >= 8) & (F.length("term") > 1)).withColumn("lift", lift).orderBy(F.desc("lift"), "term").limit(vocabulary)
    chosen_terms = [r["term"] for r in telling.select("term").collect()]

    def numbers(batches):
        for part in batches:
            yield pd.DataFrame({"s": [statistics(t) for t in part["text"]], "length": part["length"].fillna(0)})

    numbered = sample.select("text", "length").mapInPandas(numbers, "s array<double>, length double").toPandas()
    views = Views(chosen_terms, Bins.of(np.array(numbered["s"].tolist()), 8), Bins.of(_lengths(numbered["length"].tolist()), 8))
    widths = [views.text([""]).shape[1], views.metadata([[""]] * len(metas), [0]).shape[1]]
    sent = spark.sparkContext.broadcast(views)  # sizes are fixed by parameters

    def featured(batches):
        for part in batches:
            for a in range(0, len(part), 512):
                cut = part.iloc[a : a + 512]
                x = sent.value.text(cut["text"].tolist()), sent.value.metadata([cut[c].tolist() for c in metas], cut["length"].fillna(0).tolist())
                yield pd.DataFrame({"id": cut["label_id"], "good": cut["good"]} | {c: [np.flatnonzero(r).astype("<u2").tobytes() for r in m] for c, m in zip("xm", x, strict=True)})

    shape = "id long, good double, x binary, m binary"
    rows = sample.mapInPandas(freed(featured), shape).toPandas().sort_values("id", ignore_index=True)
    dense = [_dense(rows[c], width) for c, width in zip("xm", widths, strict=True)]
    y = rows["good"].to_numpy(np.float64)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["id"]])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 2 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return CoTrained(None, [], [], np.zeros(3), float(y.mean()))

    # All documents without a label, as features; a row's number is fixed once it is written.
    every = docs.select(F.col(id_col).cast("long").alias("label_id"), F.lit(None).cast("double").alias("good"), *plain)
    every = scratch.stage(every.mapInPandas(freed(featured), shape).select("id", "x", "m", F.monotonically_increasing_id().alias("row")), "features")
    # Drawn by what a row holds, not by its number: reruns agree, however the rows are dealt.
    free = every.join(known, every["id"] == known["label_id"], "left_anti").withColumn("lot", F.xxhash64("id", "x", "m"))

    def borne_out(p: np.ndarray, label: float) -> bool:
        """Whether held-out labels agree with a view where it is sure: else it does not teach that side."""
        told = (p if label else 1 - p) >= sure
        return told.sum() >= BORNE_OUT and bool((y[held][told] == label).mean() >= sure)

    def pick(logits: list[np.ndarray], rate: float, turn: int) -> list[tuple[np.ndarray, np.ndarray]]:
        def score(batches):
            for part in batches:
                z = [_sparse_logits(part[c], w) for c, w in zip("xm", logits, strict=True)]
                yield pd.DataFrame({"row": part["row"], "lot": part["lot"], "p0": _sigmoid(z[0]), "p1": _sigmoid(z[1])})

        scored = scratch.stage(free.select("x", "m", "row", "lot").mapInPandas(freed(score), "row long, lot long, p0 double, p1 double").where(F.greatest("p0", "p1", 1 - F.col("p0"), 1 - F.col("p1")) >= sure), f"round{turn}")
        out = []
        for k, other in ((0, 1), (1, 0)):
            draws, own = [], _sigmoid(dense[k][held] @ logits[k][:-1] + logits[k][-1])
            for label, p, part in ((1.0, F.col(f"p{k}"), rate), (0.0, 1 - F.col(f"p{k}"), 1 - rate)):
                drawn = scored.where(p >= sure if borne_out(own, label) else F.lit(False)).orderBy(F.xxhash64("lot", F.lit(turn), F.lit(k)), "lot", "row").limit(max(1, round(told * part)))
                draws.append(drawn.select("row", F.lit(label).alias("label")))
            taught = every.join(F.broadcast(draws[0].unionByName(draws[1])), "row").select("row", "label", "xm"[other]).toPandas().sort_values("row")
            out.append((_dense(taught["xm"[other]], widths[other]), taught["label"].to_numpy(np.float64)))
        return out

    return co_train(views, dense, y, held, rounds, pick)


def _dense(packed, width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.float32)
    for r, at in zip(out, packed, strict=True):
        r[np.frombuffer(at, "<u2")] = 1
    return out


def _sparse_logits(packed, w: np.ndarray) -> np.ndarray:
    """w (weights and, last, the bias) applied to rows of packed places."""
    count = np.array([len(x) // 2 for x in packed], np.int64)
    at = np.frombuffer(b"".join(packed), "<u2")
    return np.bincount(np.repeat(np.arange(len(count)), count), w[at], len(count)) + w[-1]


def score_quality(docs: DataFrame, model: CoTrained, text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), length_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """The columns of docs and text_score, metadata_score, score, kept, which take the place of columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # sizes are fixed by parameters

    @F.pandas_udf("text_score double, metadata_score double, score double")
    def scored(text: pd.Series, length: pd.Series, *metas: pd.Series) -> pd.DataFrame:
        parts = []
        for a in range(0, len(text), 512):
            cut = slice(a, a + 512)
            texts = ["" if t is None else t for t in text[cut]]
            parts.append(np.array(sent.value.score(texts, [m[cut].tolist() for m in metas], length[cut].fillna(0).tolist())))
        both = np.hstack(parts) if parts else np.zeros((3, 0))
        return pd.DataFrame(dict(zip(("text_score", "metadata_score", "score"), both, strict=True)))

    q = scored(F.col(text_col), F.col(length_col).cast("double"), *[F.col(c).cast("string") for c in meta_cols])
    scores = ("text_score", "metadata_score", "score")
    rest = [c for c in docs.columns if c not in (*scores, "kept")]
    out = docs.select(F.struct(*rest).alias("row"), q.alias("quality"))
    return out.select("row.*", *[F.col(f"quality.{c}").alias(c) for c in scores], (F.col("quality.score") >= threshold).alias("kept"))
