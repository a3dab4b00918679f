"""The expressions under names for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ionweave import constants as K
from ionweave.operators import features, graph

_TOKENS = f"regexp_extract_all(replace(peptide, ' ', ''), r'({K.TOKEN})', 1)"
_MASSES = "map(" + ", ".join(f"'{r}', {m!r}D" for r, m in K.RESIDUES.items()) + ")"


class Fragments:
    """A table function: ``slot, mz`` of a peptide's ladder; no rows if it has an unknown residue."""

    def eval(self, peptide: str, charge: int):
        import itertools
        import re

        found = re.findall(K.TOKEN, peptide or "")
        if not all(t in K.RESIDUES for t in found):
            return
        sums = list(itertools.accumulate((K.RESIDUES[t] for t in found), initial=0.0))
        for p in range(1, min(len(found), K.MAX_LENGTH)):
            for ion, m in ((0, sums[-1] - sums[-1 - p] + K.WATER), (3, sums[p])):
                for z in range(1, min(charge or 0, 3) + 1):
                    yield (p - 1) * 6 + ion + z - 1, (m + z * K.PROTON) / z


class NearestPeaks:
    """A table function: ``slot, tmz, emz, eint``, each slot of a peptide's ladder with the nearest of some peaks, or zeros."""

    def eval(self, peptide: str, charge: int, mzs: list, ints: list, ppm: float):
        slots, tmz = features.slots_of(peptide, charge)
        pairs = [(m, i) for m, i in zip(mzs or [], ints or []) if m is not None and i is not None]
        peaks = np.array(pairs, float).reshape(-1, 2)
        emz, eint = features.match(tmz, peaks[:, 0], peaks[:, 1], ppm)
        yield from zip(slots.tolist(), tmz.tolist(), emz.tolist(), eint.tolist())


class GraphWalks:
    """A table function: ``path, peptide, score`` of random walks from the lowest bin that leads to the highest one, drawn from ``scan``."""

    def eval(self, scan: str, bins: list, p: list, paths: int):
        known = sorted({int(b): float(x) for b, x in zip(bins or [], p or []) if b is not None and x is not None}.items())
        if not known:
            return
        own, weights = graph.with_ends(np.array([b for b, _ in known]), np.array([x for _, x in known]), None, None)
        kept, edges = graph.transitions(own, weights, list(K.residue_bins()))
        if len(kept) and kept[0] == own[0]:
            found, names = graph.spelled_walks(kept, edges, paths, scan)
            for k, (walk, name) in enumerate(zip(found, names)):
                if walk:  # it has come to the highest bin
                    yield k, name, graph.path_score(walk, kept, edges)


def register(spark: SparkSession) -> None:
    """Make functions known to a session's SQL.

    ``peptide_tokens``, ``peptide_mass``, and the table functions ``fragments``, ``nearest_peaks`` and
    ``graph_walks``, which LATERAL joins apply to each row; their rows go through Arrow.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION peptide_tokens(peptide STRING) RETURNS ARRAY<STRING> RETURN {_TOKENS}")
    total = f"aggregate(transform({_TOKENS}, t -> element_at({_MASSES}, t)), 0D, (a, x) -> a + x) + {K.WATER!r}D"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION peptide_mass(peptide STRING) RETURNS DOUBLE RETURN {total}")
    spark.udtf.register("fragments", F.udtf(Fragments, returnType="slot int, mz double", useArrow=True))
    spark.udtf.register("nearest_peaks", F.udtf(NearestPeaks, returnType="slot int, tmz double, emz double, eint double", useArrow=True))
    spark.udtf.register("graph_walks", F.udtf(GraphWalks, returnType="path int, peptide string, score double", useArrow=True))
