"""Training of the network with batch normalisation over a whole batch, however many tasks hold it.

A layer is: convolutions, dropout, ReLU, normalisation by the batch's means and variances, scale and
shift. Statistics of a layer need every row of the batch at that layer, and so do its gradients on
the way back, so a layer is one pass over the batch either way. In a pass every task merges the
means and squares of its rows (counts, means and squared deviations of two parts give those of both),
the driver merges what the tasks say, some numbers a channel, and the next pass uses them. Rows keep
the sums of the layers done so far; what lies between them is arithmetic. Passes are kept on the
executors' disks and follow from each other, so a lost one is made again. Dropout masks are drawn
from a row's number, the step, the layer and the place alone: any pass and any retry draws the same.

For inference the running statistics are folded into scale and shift, see ``State.network``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.operators.model import Network, focal
from ionweave.operators.trees import uniform

EPS, MOMENTUM = 1e-5, 0.1


@dataclass
class State:
    """Weights in training: ``.scale`` and ``.shift`` are those of the normalisation; running means and variances by layer."""

    weights: dict[str, np.ndarray]
    widths: tuple[int, ...]
    layers: int
    running: dict[str, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, network: Network) -> State:
        names = ["start", *(f"mid{k}" for k in range(network.layers))]
        running = {n: (np.zeros(len(network.weights[f"{n}.scale"])), np.ones(len(network.weights[f"{n}.scale"]))) for n in names}
        return cls({k: v.astype(np.float64) for k, v in network.weights.items()}, network.widths, network.layers, running)

    @property
    def names(self) -> list[str]:
        return list(self.running)

    def network(self) -> Network:
        """The network for inference: running statistics become part of scale and shift."""
        w = dict(self.weights)
        for name, (mean, var) in self.running.items():
            w[f"{name}.scale"] = self.weights[f"{name}.scale"] / np.sqrt(var + EPS)
            w[f"{name}.shift"] = self.weights[f"{name}.shift"] - mean * w[f"{name}.scale"]
        return Network({k: v.astype(np.float32) for k, v in w.items()}, self.widths, self.layers)

    def learn(self, found: dict[str, tuple[float, np.ndarray, np.ndarray]]) -> None:
        """Move the running statistics towards a batch's; variances as of a sample."""
        for name, (n, mean, squares) in found.items():
            old_mean, old_var = self.running[name]
            self.running[name] = old_mean + MOMENTUM * (mean - old_mean), old_var + MOMENTUM * (squares / max(n - 1, 1) - old_var)


def merged(a: tuple, b: tuple) -> tuple:
    """Count, means and sums of squared deviations of two parts together."""
    n = a[0] + b[0]
    if not n:
        return a
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + step**2 * (a[0] * b[0] / n)


def part(values: np.ndarray) -> tuple:
    """Count, means and squared deviations of (batch, channels, bins), by channel."""
    mean = values.mean(axis=(0, 2))
    return float(values.shape[0] * values.shape[2]), mean, ((values - mean[:, None]) ** 2).sum(axis=(0, 2))


class Pass:
    """What a task does with some rows: layers from their sums, and gradients back through them."""

    def __init__(self, state: State, found: dict, dropout: float, seed: tuple[int, ...]):
        self.state, self.found, self.dropout, self.seed = state, found, dropout, seed
        self.net = Network(state.weights, state.widths, state.layers)

    def mask(self, rows: np.ndarray, layer: int, shape: tuple[int, int]) -> np.ndarray | float:
        if not self.dropout:
            return 1.0
        size = shape[0] * shape[1]
        places = rows.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64)
        return (uniform(places, *self.seed, layer) >= self.dropout).reshape(len(rows), *shape) / (1 - self.dropout)

    def active(self, rows: np.ndarray, layer: int, sums: np.ndarray) -> np.ndarray:
        """What the normalisation of a layer gets."""
        return np.maximum(sums * self.mask(rows, layer, sums.shape[1:]), 0)

    def unit(self, layer: int, active: np.ndarray) -> np.ndarray:
        n, mean, squares = self.found[self.state.names[layer]]
        return (active - mean[:, None]) / np.sqrt(squares / n + EPS)[:, None]

    def output(self, rows: np.ndarray, layer: int, sums: np.ndarray) -> np.ndarray:
        name = self.state.names[layer]
        unit = self.unit(layer, self.active(rows, layer, sums))
        return unit * self.state.weights[f"{name}.scale"][:, None] + self.state.weights[f"{name}.shift"][:, None]

    def hidden(self, rows: np.ndarray, stack: list[np.ndarray]) -> np.ndarray:
        """What the layer after those of ``stack`` gets."""
        h = self.output(rows, 0, stack[0])
        for layer, sums in enumerate(stack[1:], 1):
            h = h + self.output(rows, layer, sums)
        return h

    def share(self, rows: np.ndarray, layer: int, sums: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """The gradients of a layer's scale and shift."""
        name, unit = self.state.names[layer], self.unit(layer, self.active(rows, layer, sums))
        return {f"{name}.scale": (d * unit).sum(axis=(0, 2)), f"{name}.shift": d.sum(axis=(0, 2))}

    def through(self, rows: np.ndarray, layer: int, sums: np.ndarray, d: np.ndarray, totals: dict[str, np.ndarray]) -> np.ndarray:
        """The gradient by a layer's sums; ``totals`` are those of scale and shift over the whole batch."""
        name = self.state.names[layer]
        n, _, squares = self.found[name]
        mask = self.mask(rows, layer, sums.shape[1:])
        unit = self.unit(layer, np.maximum(sums * mask, 0))
        scale = self.state.weights[f"{name}.scale"] / np.sqrt(squares / n + EPS)
        inner = d - (totals[f"{name}.shift"] / n)[:, None] - unit * (totals[f"{name}.scale"] / n)[:, None]
        return scale[:, None] * inner * (sums * mask > 0) * mask


_KIND = "row long, x binary, truth binary, stack array<binary>, d binary, name string, sums binary"
_SCHEMA = pa.schema([("row", pa.int64()), ("x", pa.binary()), ("truth", pa.binary()), ("stack", pa.list_(pa.binary())), ("d", pa.binary()), ("name", pa.string()), ("sums", pa.binary())])


def _out(rows: list[dict], sums: dict) -> Iterator[pa.RecordBatch]:
    """Rows one by one, which are large, and a task's sums at the end."""
    for r in rows:
        yield pa.RecordBatch.from_pylist([r], _SCHEMA)
    if sums:
        yield pa.RecordBatch.from_pylist([{"name": k, "sums": np.asarray(v, np.float64).tobytes()} for k, v in sums.items()], _SCHEMA)


class Batch:
    """A batch's passes. ``start`` makes the rows' inputs: (batch, channels, bins) and what is true, (batch, 2, bins)."""

    def __init__(self, rows: DataFrame, inputs: Callable, state: State, weight: np.ndarray, dropout: float, seed: tuple[int, ...], group: int = 8, gamma: float | None = 2.0):
        self.rows, self.inputs, self.state, self.weight, self.dropout, self.seed, self.group, self.gamma = rows, inputs, state, weight, dropout, seed, group, gamma
        self.spark, self.held, self.found = rows.sparkSession, [], {}

    def _pass(self, df: DataFrame, work: Callable, first: bool = False) -> dict[str, np.ndarray]:
        """A pass over the rows so far: the next rows are kept, the tasks' sums are put together."""
        shared = self.spark.sparkContext.broadcast((self.state, dict(self.found)))
        dropout, seed, inputs, group = self.dropout, self.seed, self.inputs, self.group

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = Pass(*shared.value, dropout, seed), {}

            def add(more: dict) -> None:
                for k, v in more.items():
                    if k.startswith("?"):  # statistics
                        sums[k] = np.concatenate([np.atleast_1d(c) for c in merged(_split(sums[k]), v)]) if k in sums else np.concatenate([np.atleast_1d(c) for c in v])
                    else:
                        sums[k] = sums.get(k, 0) + np.asarray(v, np.float64)

            for batch in batches:
                for a in range(0, batch.num_rows, group):
                    some = batch.slice(a, group)
                    number = some.column("row").to_numpy()
                    if first:
                        x, truth = inputs(some)
                        stack, d = [], None
                    else:
                        read = lambda name: np.stack([np.frombuffer(b) for b in some.column(name).to_pylist()])
                        n = own.state.weights["mix2.b"].shape[0]
                        truth = read("truth").reshape(len(number), n, -1)
                        bins = truth.shape[2]
                        x = read("x").reshape(len(number), -1, bins)
                        stack = [np.stack([np.frombuffer(b, np.float32) for b in layer]).astype(float).reshape(len(number), -1, bins) for layer in zip(*some.column("stack").to_pylist())]
                        d = read("d").reshape(len(number), -1, bins) if some.column("d").null_count == 0 else None
                    stack, d = work(own, add, number, x, truth, stack, d)
                    yield from _out([
                        {"row": int(r), "x": x[i].astype(float).tobytes(), "truth": truth[i].astype(float).tobytes(), "stack": [s[i].astype(np.float32).tobytes() for s in stack], "d": None if d is None else d[i].tobytes()}
                        for i, r in enumerate(number)
                    ], {})
            yield from _out([], sums)

        made = df.mapInArrow(run, _KIND).persist(StorageLevel.DISK_ONLY)
        self.held.append(made)
        totals: dict = {}
        for r in made.where("name IS NOT NULL").select("name", "sums").toLocalIterator():  # some arrays of the weights' size, a task at a time
            v = np.frombuffer(r["sums"])
            if r["name"].startswith("?"):
                totals[r["name"]] = merged(totals[r["name"]], _split(v)) if r["name"] in totals else _split(v)
            else:
                totals[r["name"]] = totals.get(r["name"], 0) + v
        for old in self.held[:-2]:  # those that the kept ones no longer need, unless a task is lost
            old.unpersist()
        self.held = self.held[-2:]
        self.next = made.where("name IS NULL").drop("name", "sums")
        return totals

    def gradients(self) -> tuple[float, int, dict[str, np.ndarray]]:
        """The loss, the number of rows, and the gradients by every weight; ``found`` holds the statistics of each layer."""
        state, weight, gamma, layers = self.state, self.weight, self.gamma, self.state.layers
        names = state.names

        def forward(layer: int) -> Callable:
            def work(own, add, number, x, truth, stack, d):
                sums = own.net._sums("start", x) if layer == 0 else own.net._sums(names[layer], own.hidden(number, stack))
                sums = sums.astype(np.float32).astype(float)  # as they are kept
                add({f"?{names[layer]}": part(own.active(number, layer, sums))})
                return [*stack, sums], None

            return work

        def head(own, add, number, x, truth, stack, d):
            h, out = own.hidden(number, stack), {}
            pairs, first, logits = own.net._mixed(x, own.net._sums("end", h))
            loss, d = focal(logits, truth, weight, gamma)
            out["mix2.w"], out["mix2.b"] = np.einsum("bkn,bkin->ki", d, first), d.sum(axis=(0, 2))
            d1 = own.state.weights["mix2.w"][None, :, :, None] * d[:, :, None]
            out["mix1.w"], out["mix1.b"] = np.einsum("bkon,bkin->koi", d1, pairs), d1.sum(axis=(0, 3)).reshape(-1)
            d = own.net._back("end", h, np.einsum("koi,bkon->bkin", own.state.weights["mix1.w"], d1)[:, :, 1], out)
            add({k: np.ravel(v) for k, v in out.items()} | {"": np.array([loss, len(number)])} | own.share(number, layers, stack[-1], d))
            return stack, d

        def back(layer: int, totals: dict) -> Callable:
            def work(own, add, number, x, truth, stack, d):
                inner, out = own.through(number, layer, stack[-1], d, totals), {}
                into = x if layer == 0 else own.hidden(number, stack[:-1])
                d = d + own.net._back(names[layer], into, inner, out) if layer else own.net._back("start", x, inner, out)
                add({k: np.ravel(v) for k, v in out.items()})
                if layer:
                    add(own.share(number, layer - 1, stack[-2], d))
                return stack[:-1], d

            return work

        self.next = self.rows
        for layer in range(layers + 1):
            stats = self._pass(self.next, forward(layer), layer == 0)
            if not stats:
                return 0.0, 0, {}
            self.found[names[layer]] = stats[f"?{names[layer]}"]
        totals = self._pass(self.next, head)
        loss, n = totals.pop("")
        for layer in range(layers, -1, -1):
            totals |= self._pass(self.next, back(layer, totals))
        for old in self.held:
            old.unpersist()
        return float(loss), int(n), {k: v.reshape(state.weights[k].shape) for k, v in totals.items()}


def _split(v: np.ndarray) -> tuple:
    c = (len(v) - 1) // 2
    return float(v[0]), v[1 : 1 + c], v[1 + c :]
