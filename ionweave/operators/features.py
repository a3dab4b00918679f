"""The feature vector of PSMs in one Arrow pass: matching, similarity, counting.

The native twins of each part are in ``relational``; this form needs no shuffle, because a
row holds its whole spectrum.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ionweave import constants as K

_TOKENS = re.compile(K.TOKEN).findall
_SLOT = np.arange(K.SLOTS) % 6
MASKS = {"all": np.ones(K.SLOTS, bool), "b": _SLOT > 2, "y": _SLOT <= 2}


def match(tmz: np.ndarray, emz: np.ndarray, eint: np.ndarray, ppm: float = K.PPM) -> tuple[np.ndarray, np.ndarray]:
    """The nearest peak of each slot, the first of equals, or zeros beyond the tolerance.

    Peaks are sorted once; the neighbours of each slot's place in the order are compared, and the
    first peak, in input order, at the least distance is taken.
    """
    zero = np.zeros(len(tmz))
    if not len(emz):
        return zero, zero.copy()
    order = np.argsort(emz, kind="stable")
    low = emz[order]
    at = np.searchsorted(low, tmz, "left")
    left = np.searchsorted(low, low[np.clip(at - 1, 0, len(low) - 1)], "left")  # first of equal m/z
    right = np.clip(at, 0, len(low) - 1)
    dl, dr = np.abs(tmz - low[left]), np.abs(tmz - low[right])
    pick = np.where((dl < dr) | (dl == dr) & (order[left] < order[right]), left, right)
    away = np.minimum(dl, dr)
    ok = (1e6 * away <= ppm * tmz) & (tmz > 0)
    chosen = order[pick]
    return np.where(ok, emz[chosen], 0.0), np.where(ok, eint[chosen], 0.0)


def slots_of(peptide: str | None, charge: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a peptide's ladder and their m/z, from one running sum; none if it has an unknown residue."""
    masses = [K.RESIDUES.get(t, np.nan) for t in _TOKENS(peptide or "")]
    n, z = min(len(masses), K.MAX_LENGTH) - 1, np.arange(1, min(charge or 0, 3) + 1)
    if n < 1 or not len(z) or np.isnan(masses).any():
        return np.empty(0, np.int32), np.empty(0)
    sums = np.concatenate([[0.0], np.cumsum(masses)])
    fragments = np.stack([sums[-1] - sums[-2 : -n - 2 : -1] + K.WATER, sums[1 : n + 1]], axis=1)
    mz = (fragments[:, :, None] + z * K.PROTON) / z
    slot = 6 * np.arange(n)[:, None, None] + np.array([0, 3])[:, None] + (z - 1)
    return slot.reshape(-1).astype(np.int32), mz.reshape(-1)


@lru_cache(1 << 14)
def known_slots(peptide: str | None, charge: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``slots_of``, remembered; not to be written to."""
    return slots_of(peptide, charge)


def matched_slots(psms: DataFrame, keep: list[str], ppm: float = K.PPM) -> DataFrame:
    """``keep, slot, tmz, tint, emz, eint``: each slot of each PSM's ladder with the nearest of its peaks, or zeros.

    ``psms`` has ``peptide, charge, mzs, ints`` and ``tints``, a predicted intensity for each of
    the 174 slots. A row holds its whole spectrum, so nothing is shuffled: one Arrow pass makes the ladders and
    matches them. ``relational.nearest_peaks`` does the same where peaks are rows.
    """
    fields = [T.StructField("slot", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("tmz", "tint", "emz", "eint"))]

    def run(batches):
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(a, ROWS)
                made = [known_slots(p, c) for p, c in zip(*(part.column(n).to_pylist() for n in ("peptide", "charge")), strict=True)]
                slot, tmz = (np.concatenate([np.empty(0, t), *(m[k] for m in made)]) for k, t in ((0, np.int32), (1, float)))
                row = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
                tint, known = ragged(part.column("tints"))
                own = np.append(tint, 0.0)[np.where(known[row] > 0, (np.cumsum(known) - known)[row] + slot, len(tint))]
                columns = [slot, tmz, own, *matches(row, tmz, *_peaks(part), ppm)]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in keep), *map(pa.array, columns)], names=[*keep, "slot", "tmz", "tint", "emz", "eint"])

    schema = T.StructType([*(psms.schema[k] for k in keep), *fields])
    return psms.select(*dict.fromkeys([*keep, "peptide", "charge", "mzs", "ints", "tints"])).mapInArrow(run, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / (n or 1.0)


def _ratio(a: float, b: float) -> float:
    return a / b if b > 0 else 0.0


def _pearson(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 3 or any(v.std() <= 1e-12 * np.abs(v).max() for v in (x, y)):  # constant but for rounding
        return 0.0
    return float(np.corrcoef(x, y)[0, 1])


def _ranks(x: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[back]


def similarity(obs: np.ndarray, pred: np.ndarray) -> list[float]:
    """Spectral angles, correlations, cosines, residual statistics and rank correlations, in the order of the features."""
    shown = pred > 0
    both = (shown & (obs > 0)).any()
    uo, up = _unit(obs), _unit(pred)
    mo = _unit(np.where(shown, obs, 0))
    mp = _unit(np.where(shown, pred, 0))
    angles = [1 - 2 * np.arccos(min(1.0, float((mo * mp)[m].sum()) * both)) / np.pi for m in MASKS.values()]
    per: dict[str, list] = {k: [] for k in ("pearson", "cos", "spearman", "stats")}
    for log in (False, True):
        for mask in MASKS.values():
            keep = mask & shown
            o, p, a, b = obs[keep], pred[keep], uo[keep], up[keep]
            if log:
                per["pearson"].append(_pearson(np.log2(o + 1e-7), np.log2(p + 1e-7)))
                if len(a) and (a > 0).all():
                    la, lb = np.log2(a), np.log2(b)
                    per["cos"].append(_ratio(float(la @ lb), float(np.linalg.norm(la) * np.linalg.norm(lb))))
                else:
                    per["cos"].append(0.0)
                a, b = np.log2(a + 1e-7), np.log2(b + 1e-7)
            else:
                per["pearson"].append(_pearson(o, p))
                per["cos"].append(_ratio(float(a @ b), float(np.linalg.norm(a) * np.linalg.norm(b))))
            per["spearman"].append(_pearson(_ranks(o), _ranks(p)))
            if len(a):
                r = np.abs(a - b.mean())
                q = np.quantile(r, [0.75, 0.5, 0.25])
                per["stats"].append([r.mean(), r.std(), *q, r.min(), r.max(), np.mean((a - b) ** 2), a @ b])
            else:
                per["stats"].append([0.0] * 9)
    return [*angles, *per["pearson"], *per["cos"], *np.array(per["stats"]).T.reshape(-1), *per["spearman"]]


def counting(tmz: np.ndarray, tint: np.ndarray, eint: np.ndarray) -> list[float]:
    t, e, possible = tint > 0, eint > 0, (tmz > 0).sum()
    out = []
    for hit in (t & e, (tmz > 0) & ~t & e, t & ~e, e):
        num = [float((hit & m).sum()) for m in MASKS.values()]
        out += num + [_ratio(n * f, possible) for n, f in zip(num, (1, 2, 2), strict=True)]
        if hit is not e and len(out) < 27:
            out += [_ratio(n, (t & m).sum()) for n, m in zip(num, MASKS.values(), strict=True)]
    return out


def vector(tmz, tint, emz, eint, changes, floor: float = 0.02, ppm: float = K.PPM) -> list[float]:
    """All features of one PSM; arrays of 174 slots, -1 or 0 where there is none."""
    tmz, tint = (np.clip(np.asarray(x, float), 0, None) for x in (tmz, tint))
    tint = np.where(tint < floor, 0.0, tint)
    _, obs = match(tmz, np.asarray(emz, float), np.asarray(eint, float), ppm)
    changes = np.asarray(changes if changes is not None else [], float)
    return [*(float((changes > t).sum()) for t in K.CHANGE_THRESHOLDS), *similarity(obs, tint), *counting(tmz, tint, obs)]


#: Rows whose features are made together.
ROWS = 1024


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of arrays, one after the other, and how many each row has; null has none."""
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), sizes


def _slots(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Arrays of 174 slots as rows; -1 for those that are empty."""
    if ((sizes != 0) & (sizes != K.SLOTS)).any():
        raise ValueError(f"an array has not {K.SLOTS} slots")
    out = np.full((len(sizes), K.SLOTS), -1.0)
    out[sizes > 0] = values.reshape(-1, K.SLOTS)
    return out


def _peaks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """m/z and intensities of all rows' peaks and how many each has; a peak without an intensity has none that is a number."""
    (emz, sizes), (eint, same) = (ragged(batch.column(c)) for c in ("mzs", "ints"))
    if (sizes != same).any():
        own, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(emz)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside, held = place < same[own], np.full(len(emz), np.nan)
        held[inside] = eint[((np.cumsum(same) - same)[own] + place)[inside]]
        eint = held
    return emz, eint, sizes


def matches(row: np.ndarray, tmz: np.ndarray, emz: np.ndarray, eint: np.ndarray, sizes: np.ndarray, ppm: float = K.PPM) -> tuple[np.ndarray, np.ndarray]:
    """``match`` for the slots of many rows (their ``row`` ascending): m/z and intensity of each slot's peak, or zeros.

    The peaks of the rows follow each other. Only their order and places are found row by row.
    """
    ends, bounds = np.cumsum(sizes), np.searchsorted(row, np.arange(len(sizes) + 1), "left")
    found, intensity = np.zeros(len(tmz)), np.zeros(len(tmz))
    if not len(emz):
        return found, intensity
    order, at, begin = np.empty(len(emz), np.int64), np.zeros(len(tmz), np.int64), ends - sizes
    for a, b, c, d in zip(begin.tolist(), ends.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        if a < b:
            own = emz[a:b]
            sort = own.argsort(kind="stable")
            order[a:b] = sort + a
            at[c:d] = own[sort].searchsorted(tmz[c:d]) + a
    low, places = emz[order], np.arange(len(emz))
    new = np.concatenate([[True], low[1:] != low[:-1]])
    new[begin[sizes > 0]] = True
    first = np.maximum.accumulate(np.where(new, places, 0))  # of equal m/z
    some = sizes[row] > 0
    row, at, tmz = row[some], at[some], tmz[some]
    left, right = first[np.maximum(at - 1, begin[row])], np.minimum(at, ends[row] - 1)
    dl, dr = np.abs(tmz - low[left]), np.abs(tmz - low[right])
    pick = order[np.where((dl < dr) | (dl == dr) & (order[left] < order[right]), left, right)]
    ok = (1e6 * np.minimum(dl, dr) <= ppm * tmz) & (tmz > 0)
    found[some], intensity[some] = np.where(ok, emz[pick], 0.0), np.where(ok, eint[pick], 0.0)
    return found, intensity


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(x: np.ndarray) -> np.ndarray:
    n = _norms(x)
    return x / np.where(n == 0, 1.0, n)


def _ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


class _Case:
    """The kept slots of many rows, moved to the left, so that a row's values are its first ``n``."""

    def __init__(self, keep: np.ndarray):
        self.at, self.n = np.nonzero(keep), keep.sum(axis=1)
        self.to = self.at[0], (np.cumsum(keep, axis=1) - 1)[self.at]
        self.valid = np.arange(max(1, int(self.n.max(initial=0)))) < self.n[:, None]
        self.many = np.maximum(self.n, 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.valid.shape)
        out[self.to] = x[self.at]
        return out

    def mean(self, x: np.ndarray) -> np.ndarray:
        return x.sum(axis=1) / self.many

    def away(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.valid, x - self.mean(x)[:, None], 0.0)

    def pearson(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok, sums = self.n > 2, []
        for v in (x, y):
            d = self.away(v)
            sums.append((d, (d * d).sum(axis=1)))
            ok &= np.sqrt(sums[-1][1] / self.many) > 1e-12 * np.abs(v).max(axis=1)  # constant but for rounding
        (dx, sx), (dy, sy) = sums
        r = np.divide((dx * dy).sum(axis=1), np.sqrt(sx) * np.sqrt(sy), out=np.zeros(len(ok)), where=ok)
        return np.clip(r, -1, 1)

    def cosine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _ratios((a * b).sum(axis=1), (_norms(a) * _norms(b))[:, 0])

    def ranks(self, x: np.ndarray) -> np.ndarray:
        sort = np.argsort(np.where(self.valid, x, np.inf), axis=1, kind="stable")
        low = np.take_along_axis(x, sort, axis=1)
        places, new = np.arange(x.shape[1]), np.ones(x.shape, bool)
        new[:, 1:] = (low[:, 1:] != low[:, :-1]) | (places[1:] == self.n[:, None])
        first = np.maximum.accumulate(np.where(new, places, 0), axis=1)
        last = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], axis=1)
        end = np.minimum.accumulate(np.where(last, places, x.shape[1])[:, ::-1], axis=1)[:, ::-1]
        out = np.empty(x.shape)
        np.put_along_axis(out, sort, (first + end) / 2 + 1, axis=1)
        return np.where(self.valid, out, 0.0)

    def stats(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        r = np.where(self.valid, np.abs(a - self.mean(b)[:, None]), 0.0)
        low = np.sort(np.where(self.valid, r, np.inf), axis=1)
        low[low == np.inf] = 0.0
        rows, quantiles = np.arange(len(r)), []
        for q in (0.75, 0.5, 0.25):
            at = q * (self.many - 1)
            down, up = low[rows, np.floor(at).astype(int)], low[rows, np.ceil(at).astype(int)]
            quantiles.append(np.where(down == up, down, down + (up - down) * (at - np.floor(at))))
        spread = self.away(r)
        found = [self.mean(r), np.sqrt(self.mean(spread * spread)), *quantiles, low[:, 0], r.max(axis=1), self.mean((a - b) ** 2), (a * b).sum(axis=1)]
        return [np.where(self.n > 0, f, 0.0) for f in found]


def similarities(obs: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """``similarity`` of many rows (rows, slots), a row each."""
    odd = ~(np.isfinite(obs) & np.isfinite(pred)).all(axis=1)
    if odd.any():  # numbers that are not: one by one
        out = np.empty((len(obs), 3 + 18 + 54))
        out[~odd] = similarities(obs[~odd], pred[~odd])
        for i in np.flatnonzero(odd):
            out[i] = similarity(obs[i], pred[i])
        return out
    shown = pred > 0
    both = (shown & (obs > 0)).any(axis=1)
    uo, up = _units(obs), _units(pred)
    products = _units(np.where(shown, obs, 0)) * _units(np.where(shown, pred, 0))
    angles = [1 - 2 * np.arccos(np.minimum(1.0, products[:, m].sum(axis=1) * both)) / np.pi for m in MASKS.values()]
    pearson, cos, stats, spearman = [[], []], [[], []], [[], []], []
    for mask in MASKS.values():
        case = _Case(shown & mask)
        o, p, a, b = (case.of(x) for x in (obs, pred, uo, up))
        log = lambda x, add=1e-7: np.where(case.valid, np.log2(np.where(case.valid, x + add, 1.0)), 0.0)  # noqa: B023, E731
        pearson[0].append(case.pearson(o, p))
        pearson[1].append(case.pearson(log(o), log(p)))
        cos[0].append(case.cosine(a, b))
        whole = (case.n > 0) & ((a > 0) | ~case.valid).all(axis=1)
        cos[1].append(np.where(whole, case.cosine(log(np.where(whole[:, None], a, 1.0), 0.0), log(b, 0.0)), 0.0))
        spearman.append(case.pearson(case.ranks(o), case.ranks(p)))
        stats[0].append(case.stats(a, b))
        stats[1].append(case.stats(log(a), log(b)))
    per_stat = [x[k] for k in range(len(K.STATS)) for x in (*stats[0], *stats[1])]
    return np.column_stack([*angles, *pearson[0], *pearson[1], *cos[0], *cos[1], *per_stat, *spearman, *spearman])


def countings(tmz: np.ndarray, tint: np.ndarray, eint: np.ndarray) -> np.ndarray:
    """``counting`` of many rows (rows, slots), a row each."""
    masks = np.column_stack(list(MASKS.values())).astype(float)
    t, e, real = tint > 0, eint > 0, tmz > 0
    possible, predicted, out = real.sum(axis=1, keepdims=True), t @ masks, []
    for hit in (t & e, real & ~t & e, t & ~e, e):
        num = hit @ masks
        out += [num, _ratios(num * np.array([1.0, 2.0, 2.0]), possible)]
        if hit is not e:
            out.append(_ratios(num, predicted))
    return np.hstack(out)


def vectors(batch: pa.RecordBatch, floor: float = 0.02, ppm: float = K.PPM) -> np.ndarray:
    """``vector`` of the rows of a batch (``mz, intensities, mzs, ints, y_changes``), a row each."""
    tmz, tint = (np.clip(_slots(*ragged(batch.column(c))), 0, None) for c in ("mz", "intensities"))
    tint = np.where(tint < floor, 0.0, tint)
    changes, counts = ragged(batch.column("y_changes"))
    row, slot = np.nonzero(tmz > 0)
    obs = np.zeros(tmz.shape)
    obs[row, slot] = matches(row, tmz[row, slot], *_peaks(batch), ppm)[1]
    own = np.repeat(np.arange(len(counts)), counts)
    over = [np.bincount(own[changes > t], minlength=len(counts)).astype(float) for t in K.CHANGE_THRESHOLDS]
    return np.column_stack([*over, similarities(obs, tint), countings(tmz, tint, obs)])


def features(psms: DataFrame, ppm: float = K.PPM, keep: list[str] | None = None) -> DataFrame:
    """``psms``, or its columns ``keep``, with the feature columns of each (``mz, intensities, mzs, ints, y_changes``), in one Arrow pass.

    A row without a predicted spectrum has features of zeros and the like, as an empty one would.
    """
    kept = psms.columns if keep is None else keep

    def run(batches):
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(a, ROWS)
                x = vectors(part, ppm=ppm) if part.num_rows else np.empty((0, len(K.FEATURES)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=[*kept, *K.FEATURES])

    asked = psms if keep is None else psms.select(*dict.fromkeys([*keep, "mz", "intensities", "mzs", "ints", "y_changes"]))
    return asked.mapInArrow(run, T.StructType([*(psms.schema[c] for c in kept), *(T.StructField(f, T.DoubleType()) for f in K.FEATURES)]))
