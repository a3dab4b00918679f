"""Models: the convolution network over bins in numpy, and scorers of trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ionweave import constants as K
from ionweave.functions.spectrum import bin_count
from ionweave.operators import trees


def metrics(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """``r2, mse`` of predictions, by groups: sums that are combined before the shuffle, so a large group is no burden."""
    e, y = (F.col(truth) - F.col(predicted)) ** 2, F.col(truth)
    spread = F.var_pop(y) * F.count(y)
    return rows.groupBy(*(by or [])).agg((1 - F.try_divide(F.sum(e), spread)).alias("r2"), F.avg(e).alias("mse"))


class Scorer:
    """A tree ensemble over feature columns; the score is the negated prediction. See ``trees`` for how it is grown."""

    def __init__(self, ensemble: trees.Ensemble):
        self.ensemble = ensemble

    @classmethod
    def train(cls, rows: DataFrame, features: list[str], target: str, kind: str = "forest", count: int | None = None, depth: int | None = None, seed: int = 13):
        """A boosted ensemble (``kind="boosted"``, 400 trees to depth 10) or a forest (180 trees of any depth)."""
        if kind == "boosted":
            growth = trees.Growth(depth=depth or 10, rate=0.1, lambda_=1.0, share=0.9, features=round(0.2 * len(features)), seed=seed)
            return cls(trees.boost(rows, features, target, count or 400, growth))
        growth = trees.Growth(depth=depth, least_split=100, least_leaf=80, share=None, features=90, by_node=True, boosted=False, seed=seed)
        return cls(trees.forest(rows, features, target, count or 180, growth))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.ensemble.predict(rows, "prediction").withColumn("score", -F.col("prediction")).drop("prediction")

    def save(self, path: str) -> None:
        session = SparkSession.getActiveSession()
        session.createDataFrame([(self.ensemble.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str):
        return cls(trees.Ensemble.from_json(SparkSession.getActiveSession().read.text(path, wholetext=True).first()[0]))


def binned(mz: np.ndarray, weight: np.ndarray, n: int = K.MAX_BIN, drop_last: bool = True) -> np.ndarray:
    """Summed weights by bin (``mz`` in widths of a bin); the highest occupied bin is left out if ``drop_last``."""
    keep = mz >= 0
    at = np.minimum(mz[keep].astype(np.int64), n + 1)
    sums = np.bincount(at, weight[keep], minlength=1)
    return np.pad(sums[: -1 if drop_last else None][:n], (0, n))[:n]


def scaled_log(x: np.ndarray, eps: float = 0.05) -> np.ndarray:
    """Logarithms, stretched over 0..1; zeros if all are alike."""
    y = np.log(x + eps)
    return (y - y.min()) / (np.ptp(y) or 1.0)


TRANSFORMS = {None: lambda x: x, "sqrt": np.sqrt, "log": scaled_log}


def channels(y_bins, b_bins, mz, intensities, mzs, ints, precursor_mz, more_bins=(), transform: str | None = None, precursor_range: bool = False, differences: bool = False, resolution: float = 1.0) -> np.ndarray:
    """The network's input, (channels, bins): occupied y and b bins, predicted and measured intensities.

    ``more_bins`` are the occupied bins of ions of further charges, a channel each, after those of y and b.
    Predicted intensities are summed by bin as they are; measured ones without peaks at the
    precursor's m/z and relative to the highest. ``precursor_range`` adds a channel that is 1
    from the first to the last occupied bin, ``differences`` two of how the intensities differ.
    """
    occupied = (y_bins, b_bins, *(more_bins or ()))
    n = bin_count(resolution)
    profiles = np.zeros((len(occupied), n))
    for row, bins in zip(profiles, occupied, strict=True):
        row[np.asarray(bins, int)] = 1
    mz, intensities, mzs, ints = (np.asarray(x if x is not None else [], float) for x in (mz, intensities, mzs, ints))
    possible = (mz > -1) & (intensities > -1)
    far = np.abs(mzs - precursor_mz) > K.PPM * 1e-6 * precursor_mz
    mzs, ints = mzs[far], ints[far]
    top = ints.max(initial=0.0)
    shape = TRANSFORMS[transform]
    theory, measured = shape(binned(mz[possible] / resolution, intensities[possible], n)), shape(binned(mzs / resolution, ints / (top or 1.0), n))
    out = [*profiles]
    if precursor_range:
        at = np.flatnonzero(profiles.any(axis=0))
        out.append(((np.arange(n) >= at[0]) & (np.arange(n) <= at[-1])).astype(float) if len(at) else np.zeros(n))
    if differences:
        away = np.abs(theory - measured)
        out += [away, away / ((theory + measured) / 2 + 1e-5)]
    return np.array([*out, theory, measured], np.float32)


def _patches(x: np.ndarray, g: int) -> np.ndarray:
    """What a 3 x 3 window over rows of ``g`` bins sees, zeros outside: (batch, channels * 9, places)."""
    batch, c, n = x.shape
    rows = n // g + 1
    framed = np.zeros((batch, c, rows + 2, g + 2), x.dtype)
    framed[:, :, 1:-1, 1:-1] = np.pad(x, ((0, 0), (0, 0), (0, rows * g - n))).reshape(batch, c, rows, g)
    parts = [framed[:, :, i : i + rows, j : j + g] for i in range(3) for j in range(3)]
    return np.stack(parts, axis=2).reshape(batch, c * 9, rows * g)


def _spread(d: np.ndarray, c: int, g: int, n: int) -> np.ndarray:
    """The transpose of ``_patches``: each place gets the sum of what its windows have for it."""
    batch, rows = len(d), n // g + 1
    framed = np.zeros((batch, c, rows + 2, g + 2), d.dtype)
    parts = d.reshape(batch, c, 9, rows, g)
    for k in range(9):
        framed[:, :, k // 3 : k // 3 + rows, k % 3 : k % 3 + g] += parts[:, :, k]
    return framed[:, :, 1:-1, 1:-1].reshape(batch, c, -1)[:, :, :n]


@dataclass
class Network:
    """Residue-gapped convolutions: for each residue bin the axis is folded to that width, so that
    bins one residue apart are neighbours.

    A start layer and residual layers have a ReLU, then a scale and shift (a batch normalisation
    that is folded up); the end layer is linear. Its two outputs are mixed with the last two
    input channels, predicted with y and measured with b, by two steps of two groups each.
    Weights are a dict of arrays, from ``.npz``.
    """

    weights: dict[str, np.ndarray]
    widths: tuple[int, ...]
    layers: int

    @classmethod
    def random(cls, channels: int = 4, width: int = 24, convs: int = 14, seed: int = 0, resolution: float = 1.0):
        rng = np.random.default_rng(seed)
        widths = tuple(K.residue_bins(resolution))
        w = {}
        for name, (i, o) in {"start": (channels, width), **{f"mid{k}": (width, width) for k in range(convs)}, "end": (width, 2)}.items():
            for g in widths:
                w[f"{name}.{g}.w"] = rng.normal(0, (9 * i * len(widths)) ** -0.5, (o, i, 3, 3)).astype(np.float32)
                w[f"{name}.{g}.b"] = np.zeros(o, np.float32)
            if name != "end":
                w[f"{name}.scale"], w[f"{name}.shift"] = np.ones(o, np.float32), np.zeros(o, np.float32)
        w["mix1.w"], w["mix1.b"] = rng.normal(0, 0.7, (2, 2, 2)).astype(np.float32), np.zeros(4, np.float32)
        w["mix2.w"], w["mix2.b"] = rng.normal(0, 0.7, (2, 2)).astype(np.float32), np.zeros(2, np.float32)
        return cls(w, widths, convs)

    @classmethod
    def load(cls, path: str):
        with np.load(path) as f:
            w = dict(f)
        widths = tuple(sorted({int(k.split(".")[1]) for k in w if k.startswith("start.") and k.endswith(".w")}))
        return cls(w, widths, sum(k.startswith("mid") and k.endswith(".scale") for k in w))

    def save(self, path: str) -> None:
        np.savez(path, **self.weights)

    def _sums(self, name: str, x: np.ndarray) -> np.ndarray:
        """The convolutions of a layer over all widths, added up."""
        n, out = x.shape[2], 0.0
        for g in self.widths:
            w = self.weights[f"{name}.{g}.w"]
            out = out + (w.reshape(len(w), -1) @ _patches(x, g))[:, :, :n] + self.weights[f"{name}.{g}.b"][:, None]
        return out

    def _layer(self, name: str, sums: np.ndarray) -> np.ndarray:
        return np.maximum(sums, 0) * self.weights[f"{name}.scale"][:, None] + self.weights[f"{name}.shift"][:, None]

    def _mixed(self, x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (predicted, y) and (measured, b), (batch, 2, 2, bins); what the first step makes of them; logits."""
        w = self.weights
        pairs = np.stack([np.stack([x[:, -2 + k], end[:, k]], axis=1) for k in (0, 1)], axis=1)
        first = np.einsum("koi,bkin->bkon", w["mix1.w"], pairs) + w["mix1.b"].reshape(1, 2, 2, 1)
        return pairs, first, np.einsum("ki,bkin->bkn", w["mix2.w"], first) + w["mix2.b"][:, None]

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Logits (batch, 2, bins) of y and b from ``channels``, (batch, channels, bins)."""
        h = self._layer("start", self._sums("start", x))
        for k in range(self.layers):
            h = h + self._layer(f"mid{k}", self._sums(f"mid{k}", h))
        return self._mixed(x, self._sums("end", h))[2]

    def gradients(self, x: np.ndarray, truth: np.ndarray, weight: np.ndarray, gamma: float | None = 2.0) -> tuple[float, dict[str, np.ndarray]]:
        """The summed focal loss of a batch and its gradient by every weight."""
        w, out = self.weights, {}
        inputs, sums = [x], [self._sums("start", x)]
        h = self._layer("start", sums[0])
        for k in range(self.layers):
            inputs.append(h)
            sums.append(self._sums(f"mid{k}", h))
            h = h + self._layer(f"mid{k}", sums[-1])
        pairs, first, logits = self._mixed(x, self._sums("end", h))
        loss, d = focal(logits, truth, weight, gamma)
        out["mix2.w"], out["mix2.b"] = np.einsum("bkn,bkin->ki", d, first), d.sum(axis=(0, 2))
        d1 = w["mix2.w"][None, :, :, None] * d[:, :, None]
        out["mix1.w"], out["mix1.b"] = np.einsum("bkon,bkin->koi", d1, pairs), d1.sum(axis=(0, 3)).reshape(-1)
        d = np.einsum("koi,bkon->bkin", w["mix1.w"], d1)[:, :, 1]
        d = self._back("end", h, d, out)
        for k in range(self.layers - 1, -1, -1):
            d = d + self._back(f"mid{k}", inputs[k + 1], self._unlayer(f"mid{k}", sums[k + 1], d, out), out)
        self._back("start", x, self._unlayer("start", sums[0], d, out), out)
        return loss, out

    def _unlayer(self, name: str, sums: np.ndarray, d: np.ndarray, out: dict) -> np.ndarray:
        out[f"{name}.scale"], out[f"{name}.shift"] = (d * np.maximum(sums, 0)).sum(axis=(0, 2)), d.sum(axis=(0, 2))
        return d * self.weights[f"{name}.scale"][:, None] * (sums > 0)

    def _back(self, name: str, x: np.ndarray, d: np.ndarray, out: dict) -> np.ndarray:
        n, total = x.shape[2], 0.0
        for g in self.widths:
            w = self.weights[f"{name}.{g}.w"]
            far = np.pad(d, ((0, 0), (0, 0), (0, (n // g + 1) * g - n)))
            out[f"{name}.{g}.w"] = np.einsum("bop,bip->oi", far, _patches(x, g)).reshape(w.shape)
            out[f"{name}.{g}.b"] = d.sum(axis=(0, 2))
            total = total + _spread(w.reshape(len(w), -1).T @ far, x.shape[1], g, n)
        return total


class Prepared:
    """A network that is ready for many spectra of ``n`` bins.

    A folded axis puts places i + a * g + b side by side (a, b: -1, 0, 1), so all widths of a layer are one
    convolution along the axis, but for the first and the last place of each row, which have no neighbour on
    one side. That convolution is a product of spectra, for each frequency a matrix; what it has too much
    at the rows' ends is taken off again.
    """

    def __init__(self, network: Network, n: int):
        self.network, self.n, g = network, n, max(network.widths)
        self.size = next(k for k in range(n + g + 1, 2 * (n + g + 1)) if _smooth(k))  # nothing comes round
        places, rows = np.arange(n), np.arange(-1, 2)[:, None]
        self.ends = []  # width, side, the rows' first or last places, and what the window has beyond them
        for g in network.widths:
            for side in (0, 2):
                own = places[places % g == (0 if side == 0 else g - 1)]
                seen = own + rows * g + side - 1
                self.ends.append((g, side, own, np.where((seen < 0) | (seen >= n), n, seen)))
        self.spectra, self.beyond, self.bias = {}, {}, {}
        for name in ("start", *(f"mid{k}" for k in range(network.layers)), "end"):
            own = {g: network.weights[f"{name}.{g}.w"] for g in network.widths}
            o, i = own[g].shape[:2]
            kernel = np.zeros((o, i, self.size), np.float32)
            for g, w in own.items():
                for a in range(3):
                    for b in range(3):
                        kernel[:, :, -((a - 1) * g + b - 1) % self.size] += w[:, :, a, b]
            self.spectra[name] = np.ascontiguousarray(np.fft.rfft(kernel, axis=2).transpose(2, 0, 1))
            self.beyond[name] = [w.reshape(o, -1) for w in (own[g][:, :, :, side] for g, side, _, _ in self.ends)]
            self.bias[name] = sum(network.weights[f"{name}.{g}.b"] for g in network.widths)[:, None]

    def _sums(self, name: str, x: np.ndarray) -> np.ndarray:
        seen = np.ascontiguousarray(np.fft.rfft(x, self.size, axis=2).transpose(2, 1, 0))
        made = np.ascontiguousarray((self.spectra[name] @ seen).transpose(2, 1, 0))
        out = np.fft.irfft(made, self.size, axis=2)[:, :, : self.n] + self.bias[name]
        framed = np.concatenate([x, np.zeros((*x.shape[:2], 1), x.dtype)], axis=2).transpose(1, 0, 2)
        for w, (_, _, own, at) in zip(self.beyond[name], self.ends, strict=True):
            if len(own):
                near = np.take(framed, at, axis=2).transpose(0, 2, 1, 3).reshape(w.shape[1], -1)
                out[:, :, own] -= (w @ near).reshape(len(w), len(x), len(own)).transpose(1, 0, 2)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        """The logits of ``Network.forward``."""
        net = self.network
        h = net._layer("start", self._sums("start", x))
        for k in range(net.layers):
            h = h + net._layer(f"mid{k}", self._sums(f"mid{k}", h))
        return net._mixed(x, self._sums("end", h))[2]


def _smooth(k: int) -> bool:
    """Whether a transform of this length is a fast one."""
    for p in (2, 3, 5):
        while k % p == 0:
            k //= p
    return k == 1


def focal(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray | float = 1.0, gamma: float | None = 2.0) -> tuple[float, np.ndarray]:
    """The sum of (1 - pt) ** gamma times the weighted cross-entropy, and its gradient by the logits.

    Without a gamma the plain cross-entropy, in which occupied cells alone are weighted.
    """
    p = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
    pt = np.clip(np.where(truth > 0, p, 1 - p), 1e-12, 1)
    scale = np.broadcast_to(weight, logits.shape) * np.ones_like(logits)
    if gamma is None:
        scale, gamma = np.where(truth > 0, scale, 1.0), 0.0
    loss = (1 - pt) ** gamma * scale * -np.log(pt)
    by_pt = scale * (gamma * (1 - pt) ** max(gamma - 1, 0) * np.log(pt) - (1 - pt) ** gamma / pt)
    return float(loss.sum()), by_pt * np.where(truth > 0, 1, -1) * p * (1 - p)


def focal_loss(logits: np.ndarray, truth: np.ndarray, weight: float = 1.0) -> float:
    """The mean of the focal loss."""
    return focal(logits, truth, weight)[0] / max(1, logits.size)


INPUTS = ("y_bins", "b_bins", "mz", "intensities", "mzs", "ints", "precursor_mz")
#: Spectra that go through the network together, when it learns and when it is prepared.
BATCH, MANY = 8, 32


def _with_columns(rows: DataFrame, new: str, make) -> DataFrame:
    """``rows`` with columns that ``make`` gives for each spectrum's row, in one Arrow pass; all other columns stay."""
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(new)
    kinds = to_arrow_schema(added)

    def run(batches):
        apply = make()
        for batch in batches:
            columns = list(zip(*apply(batch), strict=True)) or [()] * len(kinds)
            arrays = [*batch.columns, *(pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *kinds.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def _names(columns: list[str]) -> list[str]:
    """INPUTS, and the bins of further charges where there are any."""
    return [*INPUTS, *(c for c in ("more_bins",) if c in columns)]


def _inputs(batch: pa.RecordBatch, at: list[int], **options) -> np.ndarray:
    columns = [batch.column(c).to_pylist() for c in _names(batch.schema.names)]
    return np.array([channels(*(c[i] for c in columns), **options) for i in at], np.float32)


def reclassify(rows: DataFrame, network: Network, threshold: float = 0.35, least_change: float = 0.3, **options) -> DataFrame:
    """``rows`` (with INPUTS) and sparse probabilities of each, in seven ragged arrays.

    A row without a predicted spectrum (``mz`` is null) or a precursor's m/z gets nulls. ``options`` are those of ``channels``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def make():
        network = Prepared(shared.value, bin_count(options.get("resolution", 1.0)))

        def apply(batch):
            found = [(None,) * 7] * len(batch)
            good = np.flatnonzero(np.all([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("mz", "precursor_mz")], axis=0)).tolist()
            for a in range(0, len(good), MANY):
                x = _inputs(batch.take(good[a : a + MANY]), range(len(good[a : a + MANY])), **options)
                for i, own, p in zip(good[a:], x[:, :2], 1 / (1 + np.exp(-network.forward(x))), strict=False):
                    change = np.where(own > 0, 1 - p, p)
                    y, b = (np.flatnonzero(q > threshold) for q in p)
                    found[i] = p[0][y], y, p[1][b], b, change[0][change[0] > least_change], np.flatnonzero(own[0]), np.flatnonzero(own[1])
            return found

        return apply

    ddl = "y_probs array<float>, y_mz array<int>, b_probs array<float>, b_mz array<int>, y_changes array<float>, y_mz_inputs array<int>, b_mz_inputs array<int>"
    return _with_columns(rows, ddl, make)


def reclassify_with_truth(rows: DataFrame, network: Network, **options) -> DataFrame:
    """``rows`` (with INPUTS, ``y_true, b_true``) and, for y and for b, each bin's probability, input, target, change probability and whether it changes."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    names = [f"{ion}_{c}" for ion in "yb" for c in ("outputs", "inputs", "targets", "changes", "changed")]

    def make():
        def apply(batch):
            truth = [batch.column(c).to_pylist() for c in ("y_true", "b_true")]
            for a in range(0, len(batch), BATCH):
                at = list(range(a, min(a + BATCH, len(batch))))
                x = _inputs(batch, at, **options)
                for i, own, p in zip(at, x[:, :2], 1 / (1 + np.exp(-shared.value.forward(x))), strict=True):
                    row = []
                    for k in (0, 1):
                        target = targets(truth[k][i], x.shape[2])
                        row += [p[k], own[k], target, np.where(own[k] > 0, 1 - p[k], p[k]), (own[k] != target).astype(np.float32)]
                    yield row

        return apply

    return _with_columns(rows, ", ".join(f"{n} array<float>" for n in names), make)


def targets(bins, n: int = K.MAX_BIN) -> np.ndarray:
    out = np.zeros(n, np.float32)
    out[np.asarray(bins, int)] = 1
    return out


def class_weights(rows: DataFrame, bins: int = K.MAX_BIN) -> dict[str, float]:
    """Cells over occupied cells of each true channel (``y_true, b_true``), which weigh the loss; one pass, two numbers."""
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.size("y_true")).alias("y"), F.sum(F.size("b_true")).alias("b")).first()
    return {k: sums["n"] * bins / sums[k] if sums[k] else 1.0 for k in ("y", "b")}


def train_network(rows: DataFrame, valid: DataFrame, network: Network, epochs: int = 30, steps: int = 10, rate: float = 4e-5, patience: int = 2, save: str | None = None, seed: int = 13, normalise: bool = False, dropout: float = 0.0, gamma: float | None = 2.0, **options) -> Network:
    """The network with the least loss on ``valid`` while it learns from ``rows`` (both with INPUTS, ``y_true, b_true``).

    An epoch goes through the rows in ``steps`` parts, chosen by a hash of the row and the
    epoch. Every task adds up the gradients of its spectra; they are summed by weight, and the
    driver, which holds the weights alone, makes one Adam step. The rate falls to a tenth when
    ``patience`` epochs have brought nothing; the best weights are saved as they are found.

    With ``normalise`` layers are normalised by the statistics of each part (``normalised``), and the
    network that is returned has the running ones folded in; ``dropout`` works with it only.
    The loss is the focal one with ``gamma``, or, if that is None, the weighted cross-entropy (see ``focal``).
    """
    session, bins = rows.sparkSession, bin_count(options.get("resolution", 1.0))
    weight = np.array([list(class_weights(rows, bins).values())], np.float32)[:, :, None]

    def gather(part: DataFrame, net: Network, learn: bool) -> tuple[float, int, dict]:
        shared = session.sparkContext.broadcast(net)

        def run(batches):
            loss, n, sums = 0.0, 0, {}
            for batch in batches:
                truth = [batch.column(c).to_pylist() for c in ("y_true", "b_true")]
                for a in range(0, len(batch), BATCH):
                    at = list(range(a, min(a + BATCH, len(batch))))
                    x, y = _inputs(batch, at, **options), np.array([[targets(t[i], bins) for t in truth] for i in at])
                    if learn:
                        more, found = shared.value.gradients(x, y, weight, gamma)
                        sums = {k: sums.get(k, 0) + v for k, v in found.items()}
                    else:
                        more = focal(shared.value.forward(x), y, weight, gamma)[0]
                    loss, n = loss + more, n + len(at)
            sums[""] = np.array([loss, n])
            arrays = [pa.array(list(sums)), pa.array([np.asarray(v, np.float64).tobytes() for v in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["name", "sums"])

        def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v, np.float64) for v in table.column("sums").to_pylist())
            return pa.table({"name": [key[0].as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

        parts = part.select(*_names(part.columns), "y_true", "b_true").mapInArrow(run, "name string, sums binary")
        got = {r.name: np.frombuffer(r.sums, np.float64) for r in parts.groupBy("name").applyInArrow(add, "name string, sums binary").collect()}
        shared.unpersist()
        loss, n = got.pop("", np.zeros(2))
        return float(loss), int(n), got

    work = Network({k: v.astype(np.float32).copy() for k, v in network.weights.items()}, network.widths, network.layers)
    if dropout and not normalise:
        raise ValueError("dropout needs normalise")
    held = None
    if normalise:
        from ionweave.operators.normalised import Batch, State

        held = State.of(work)
        work = held.network()

    def inputs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        truth = [batch.column(c).to_pylist() for c in ("y_true", "b_true")]
        return _inputs(batch, range(len(batch)), **options), np.array([[targets(t[i], bins) for t in truth] for i in range(len(batch))])

    best, least, waited, step = work, np.inf, 0, 0
    moment, second = ({k: np.zeros(v.shape) for k, v in work.weights.items()} for _ in range(2))
    for epoch in range(epochs):
        for k in range(steps):
            part = rows.where(F.pmod(F.xxhash64("mzs", "ints", "precursor_mz", F.lit(seed), F.lit(epoch)), F.lit(steps)) == k)
            if held:
                numbered = part.select(*_names(part.columns), "y_true", "b_true", F.shiftrightunsigned(F.xxhash64(*INPUTS), 24).alias("row"))
                whole = Batch(numbered, inputs, held, weight, dropout, (seed, epoch, k), BATCH, gamma)
                _, n, found = whole.gradients()
            else:
                _, n, found = gather(part, work, True)
            if not n:
                continue
            step += 1
            new = {}
            for name, w in (held or work).weights.items():
                g = found[name].reshape(w.shape) / (n * 2 * bins)
                moment[name] += 0.1 * (g - moment[name])
                second[name] += 0.001 * (g * g - second[name])
                new[name] = (w - rate * (moment[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if held:
                held.weights = {k: v.astype(np.float64) for k, v in new.items()}
                held.learn(whole.found)
            work = held.network() if held else Network(new, work.widths, work.layers)
        loss, n, _ = gather(valid, work, False)
        if n and loss / n < least:
            best, least, waited = work, loss / n, 0
            if save:
                best.save(save)
        elif (waited := waited + 1) > patience:
            rate, waited = rate / 10, 0
    return best
