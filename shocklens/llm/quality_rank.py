"""Quality scores learned from preference pairs (Bradley-Terry).

A document has a strength w.x over measures of its text. The chance that a
labelled good document beats a labelled poor one is the logistic of the
difference of their strengths; w minimises that loss over pairs in which every
labelled document stands. The threshold is a quantile of the strengths of all
labelled documents, and the score is the logistic of the distance to it, moved
so that it equals ``cut`` there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shocklens.session import saved

#: Preference pairs of a fit on a sample that the caller asks for.
PAIRS = 60_000
#: Labelled rows of a share of the whole fit, the most pairs to a row, Newton steps, and steps of the threshold's scale.
SHARE, ROUNDS, STEPS, BINS = 8_192, 8, 25, 65_536
CUT = 0.3
_LONG = re.compile(rb"\S{25,}")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"


def features(text: str | None) -> list[float]:
    """Measures of a text's form; finite for every text, also null and empty ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    letters = share(_UPPER) + share(_LOWER)
    # A bounded number of characters to a window, all windows of the text.
    windows = [raw[i : i + 65536] for i in range(0, len(raw), 65536)]
    packed = sum(len(zlib.compress(x, 1)) for x in windows) / size
    return [
        np.log1p(len(words)), np.log1p(len(raw) / n), len(counts) / n, len(counts) / n**0.8, pairs,
        max(counts.values(), default=0) / n, share(_UPPER) / max(letters, 1e-9) if letters else 0.0,
        share(_DIGITS), share(_MARKS), share(_SYMBOLS), share(b"!"), share(b"|"), share(b".,;:?"),
        len(lines) / n, len(set(lines)) / max(1, len(lines)), sum(c for w, c in counts.items() if len(w) <= 3) / n,
        len(_LONG.findall(raw)) / n, packed, letters,
    ]


def expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised measures and their squares, without outliers' pull."""
    z = np.clip((x - mean) / spread, -4, 4)
    return np.hstack([z, z * z])


def fit(good: np.ndarray, poor: np.ndarray, share_good: float, pairs: int = PAIRS, seed: int = 7, ridge: float = 1e-3) -> dict:
    """Weights by Newton steps on the logistic loss of feature differences, and the threshold."""
    both = np.vstack([good, poor])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 1e-9
    a, b = expand(good, mean, spread), expand(poor, mean, spread)
    rng = np.random.default_rng(seed)
    diff = a[rng.integers(len(a), size=pairs)] - b[rng.integers(len(b), size=pairs)]
    w = np.zeros(diff.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * pairs * np.eye(len(w)), diff.T @ (1 - p) - ridge * pairs * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strength = np.r_[a @ w, b @ w]
    weight = np.r_[np.full(len(a), share_good / len(a)), np.full(len(b), (1 - share_good) / len(b))]
    # The quantile of the strengths with the fewest labels on the wrong side, by the classes' shares.
    order = np.argsort(strength)
    gain = np.cumsum(np.where(order < len(a), -weight[order], weight[order]))
    k = int(np.argmax(gain))
    cut = (strength[order[k]] + strength[order[min(k + 1, len(order) - 1)]]) / 2
    return {"w": w, "mean": mean, "spread": spread, "cut": cut, "scale": max(1e-9, float(strength.std()) / 2), "quantile": (k + 1) / len(order)}


def strengths(x: np.ndarray, model: dict) -> np.ndarray:
    # Summed row by row, so that a score does not depend on the rows beside it.
    return (expand(x, model["mean"], model["spread"]) * model["w"]).sum(axis=1)


def scores(x: np.ndarray, model: dict, at: float = CUT) -> np.ndarray:
    """0 to 1; at the threshold it equals ``at``."""
    return 1 / (1 + np.exp(-np.clip((strengths(x, model) - model["cut"]) / model["scale"] + np.log(at / (1 - at)), -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, _label) of the rows to learn from; ids with both labels are left out."""
    known = labels.where(~held_out("doc_id") & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.min("quality").alias("_label"), F.max("quality").alias("_most")).where("_label = _most").select("doc_id", "_label")


def _label_shares(usable: DataFrame) -> float:
    n = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get(1, 0) / max(1, sum(n.values()))


def measured(text: str) -> F.Column:
    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array((features(t.as_py()) for t in texts), pa.list_(pa.float64()))

    return measure(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(features of good, features of poor, share of good) from at most ``per_class`` rows of each class.

    The ids of smallest hash are taken, in that order, so the sample and the
    fit do not depend on how the tables are laid out. Of texts that repeat an
    id the smallest string counts.
    """
    usable = usable_labels(labels)
    place = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [usable.where(F.col("_label") == q).orderBy(place, "doc_id").limit(per_class) for q in (0, 1)]
    # At most 2 * per_class ids are broadcast, and as many feature rows come back.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = picked.select("_label", "doc_id", place.alias("place"), measured("text").alias("x")).collect()
    rows.sort(key=lambda r: (r.place, r.doc_id))
    width = len(features(""))
    good, poor = (np.array([r.x for r in rows if r["_label"] == q]).reshape(-1, width) for q in (1, 0))
    return good, poor, _label_shares(usable)


def _matched(good: int, poor: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (good, poor) of a share: all, or ``ROUNDS`` for each row of the larger class, spread over the other."""
    n = max(good, poor)
    if min(good, poor) <= ROUNDS:
        return np.repeat(np.arange(good), poor), np.tile(np.arange(poor), good)
    at = np.tile(np.arange(n), ROUNDS)
    turn = at + np.repeat(np.arange(ROUNDS), n) * (min(good, poor) // ROUNDS)
    return (at, turn % poor) if good >= poor else (turn % good, at)


def fit_whole(labelled: DataFrame, share_good: float) -> dict | None:
    """The fit on all rows of ``labelled`` (doc_id, _label, x); none without both classes.

    Rows are dealt by the hash of their id to shares of some ``SHARE`` rows and
    paired within them, so every row stands in pairs. Each Newton step is one
    pass over the shares, of which sums come back. Sums are added in the
    shares' order: the fit does not depend on how the tables are laid out. The
    threshold is found on a scale of ``BINS`` steps between the least and the
    greatest strength, in which all rows are counted.
    """
    width = len(features(""))
    shares = max(1, -(-labelled.count() // SHARE))
    place = F.xxhash64(F.col("doc_id").cast("string"))

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("id").to_pylist(), table.column("place").to_numpy()))
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)[order]
        label = table.column("_label").to_numpy()[order]
        return pa.table({"share": table.column("share").slice(0, 1), "good": pa.array([x[label == 1].tobytes()], pa.binary()), "poor": pa.array([x[label == 0].tobytes()], pa.binary())})

    dealt = labelled.select(F.pmod(place, F.lit(shares)).alias("share"), place.alias("place"), F.col("doc_id").cast("string").alias("id"), F.col("_label").cast("int").alias("_label"), "x")
    blocks = saved(dealt.groupBy("share").applyInArrow(pack, "share long, good binary, poor binary"))

    def sides(batches):
        for b in batches:
            for share, *both in zip(*(b.column(c).to_pylist() for c in ("share", "good", "poor")), strict=True):
                yield share, *(np.frombuffer(x).reshape(-1, width) for x in both)

    def total(of) -> np.ndarray:
        def run(batches):
            for share, good, poor in sides(batches):
                yield pa.RecordBatch.from_pydict({"share": pa.array([share], pa.int64()), "v": pa.array([np.asarray(of(good, poor), float).tobytes()], pa.binary())})

        rows = sorted(blocks.mapInArrow(run, "share long, v binary").collect(), key=lambda r: r.share)
        return np.sum([np.frombuffer(r.v) for r in rows], axis=0)

    n_good, n_poor, *sums = total(lambda g, p: np.r_[len(g), len(p), g.sum(axis=0) + p.sum(axis=0)]) if labelled.take(1) else (0, 0)
    if not n_good or not n_poor:
        return None
    n, mean = n_good + n_poor, np.array(sums) / (n_good + n_poor)
    spread = np.sqrt(total(lambda g, p: ((g - mean) ** 2).sum(axis=0) + ((p - mean) ** 2).sum(axis=0)) / n) + 1e-9
    w, k = np.zeros(2 * width), 2 * width

    def slopes(g: np.ndarray, p: np.ndarray) -> np.ndarray:
        i, j = _matched(len(g), len(p))
        diff = expand(g, mean, spread)[i] - expand(p, mean, spread)[j]
        q = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        return np.r_[len(diff), diff.T @ (1 - q), ((diff * (q * (1 - q))[:, None]).T @ diff).ravel()]

    for _ in range(STEPS):
        pairs, *rest = total(slopes)
        if not pairs:
            return None
        step = np.linalg.solve(np.reshape(rest[k:], (k, k)) + 1e-3 * pairs * np.eye(k), np.array(rest[:k]) - 1e-3 * pairs * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model = {"w": w, "mean": mean, "spread": spread}
    summed, squared = total(lambda g, p: np.r_[strengths(g, model).sum() + strengths(p, model).sum(), (strengths(g, model) ** 2).sum() + (strengths(p, model) ** 2).sum()])
    # Measures are clipped at four deviations, so strengths are bounded by the weights.
    most = float(np.abs(w[:width]).sum() * 4 + np.abs(w[width:]).sum() * 16) + 1e-9

    def counted(batches):
        for _, good, poor in sides(batches):
            bins = [np.clip(((strengths(x, model) + most) / (2 * most) * BINS).astype(np.int64), 0, BINS - 1) for x in (good, poor)]
            held = np.unique(np.r_[bins[0], bins[1]])
            yield pa.RecordBatch.from_pydict({"bin": pa.array(held)} | {c: pa.array(np.bincount(np.searchsorted(held, x), minlength=len(held)).astype(np.int64)) for c, x in zip(("good", "poor"), bins, strict=True)})

    bins = sorted(blocks.mapInArrow(counted, "bin long, good long, poor long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("poor").alias("poor")).collect(), key=lambda r: r.bin)
    gain = np.cumsum([(1 - share_good) * r.poor / n_poor - share_good * r.good / n_good for r in bins])
    best = int(np.argmax(gain))
    # Between the best step and the next that holds rows.
    edge = (bins[best].bin + bins[min(best + 1, len(bins) - 1)].bin + 1) / 2
    below = sum(r.good + r.poor for r in bins[: best + 1])
    deviation = float(np.sqrt(max(0.0, squared / n - (summed / n) ** 2)))
    return model | {"cut": edge / BINS * 2 * most - most, "scale": max(1e-9, deviation / 2), "quantile": below / n}


def rank_quality(docs: DataFrame, labels: DataFrame, per_class: int | None = None, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns only from rows of ``labels`` (doc_id, quality 0/1) that are not held
    out and whose text is given, from all of them unless ``per_class`` asks for
    a sample; other label values, null ids and ids with contradicting labels
    are ignored. Of texts that repeat an id the smallest measures count. With
    no pair of a good and a poor row all scores are 0.5. Null and empty texts
    are scored like any other. Null ids are not held out. Texts are measured
    once, into the shared folder.
    """
    rows = saved(docs.select("doc_id", held_out("doc_id").alias("held_out"), measured("text").alias("x")))
    if per_class is None:
        usable = saved(usable_labels(labels))
        model = fit_whole(saved(rows.select("doc_id", "x").join(usable, "doc_id").groupBy("doc_id", "_label").agg(F.min("x").alias("x"))), _label_shares(usable))
    else:
        good, poor, share = labelled_sample(docs, labels, per_class)
        model = fit(good, poor, share) if len(good) and len(poor) else None
    width = len(features(""))

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        if model is None or not len(x):
            return pa.array([0.5] * len(x), pa.float64())
        return pa.array(scores(x.flatten().to_numpy().reshape(-1, width), model, cut))

    judged = rows.select("doc_id", "held_out", score("x").alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= cut).cast("int"))
