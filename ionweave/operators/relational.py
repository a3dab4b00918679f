"""Relational operators: matching, counting, similarity, binning, selection, graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionweave import constants as K
from ionweave.functions.peptide import let


def log_slices(slots: DataFrame, peaks: DataFrame, ppm: float) -> tuple[DataFrame, DataFrame]:
    """Both with a column ``_slice`` such that a slot and each peak within ``ppm`` of it share one.

    A band of some ppm is equally wide everywhere in log m/z. Slices are as wide as a band, so that
    a slot asks for two of them at most and a peak lies in one.
    """
    part = ppm * 1e-6
    if not 0 <= part < 1:
        raise ValueError("a tolerance must be 0 ppm at least and under 1,000,000")
    width, slack = max(math.log1p(part) - math.log1p(-part), 1e-9), 1e-12
    place = lambda log: F.floor(log / width)
    at = F.when(F.col("tmz") > 0, F.ln("tmz"))
    asked = F.sequence(place(at + (math.log1p(-part) - slack)), place(at + (math.log1p(part) + slack)))
    nowhere = F.array(F.lit(None).cast("long"))  # stays, and meets no peak
    asked = slots.withColumn("_slice", F.explode(F.coalesce(asked, nowhere)))
    return asked, peaks.where("mz > 0 AND mz < DOUBLE('Infinity')").withColumn("_slice", place(F.ln("mz")))


def band_join(slots: DataFrame, peaks: DataFrame, ppm: float) -> DataFrame:
    """Each slot with every peak (``_scan, pos, mz, intensity``) of its scan within ``ppm``, or with none, once a slice.

    An equi-join by scan and slice: a scan's peaks are spread over its slices, so that however many
    a scan has, no task pairs its slots with all of them.
    """
    asked, held = log_slices(slots, peaks, ppm)
    held = held.select(F.col("scan").alias("_scan"), "pos", "mz", "intensity", F.col("_slice").alias("_held"))
    same = (F.col("scan") == F.col("_scan")) & (F.col("_slice") == F.col("_held"))
    return asked.join(held, same & (1e6 * F.abs(F.col("tmz") - F.col("mz")) <= ppm * F.col("tmz")), "left").drop("_held")


def nearest_peaks(slots: DataFrame, peaks: DataFrame, keys: list[str], ppm: float = K.PPM) -> DataFrame:
    """For each slot (``scan, *keys, slot, tmz, tint``) the nearest peak (``scan, pos, mz, intensity``).

    Of equally near peaks the first by ``pos`` counts; a slot whose nearest peak is over ``ppm``
    away, or that has none, gets zeros. Slots and peaks meet in ``band_join``; the nearest is a
    grouped minimum, which is combined before its shuffle. Repeated slots are counted first and
    come back as often; slots with a null scan or m/z have no peak.
    """
    own = ["scan", *keys, "slot", "tmz", "tint"]
    met = band_join(slots.groupBy(*own).agg(F.count("*").alias("_n")), peaks, ppm)
    away = F.abs(F.col("tmz") - F.col("mz")).alias("away")
    nearest = F.min(F.when(F.col("mz").isNotNull(), F.struct(away, "pos", "mz", "intensity"))).alias("p")
    best = met.groupBy(*own, "_n").agg(nearest)
    best = best.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    found = [F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).alias(n) for c, n in (("mz", "emz"), ("intensity", "eint"))]
    return best.select(*own, *found)


def counting_features(common: DataFrame, keys: list[str]) -> DataFrame:
    """The 33 counting features over slots (``slot, tmz, tint, emz, eint``), grouped by ``keys``."""
    ions = {"": F.lit(True), "_b": F.col("slot") % 6 > 2, "_y": F.col("slot") % 6 <= 2}
    t, e = F.col("tint") > 0, F.col("eint") > 0
    possible = F.col("tmz") > 0
    groups = {"theo": t, "exp_theo": t & e, "exp_notTheo": possible & ~t & e, "notExp_theo": t & ~e, "exp": e}
    sums = [F.count_if(p & i).cast("double").alias(f"num_{g}{k}") for g, p in groups.items() for k, i in ions.items()]
    counted = common.groupBy(*keys).agg(F.count_if(possible).cast("double").alias("possible"), *sums)
    out = list(map(F.col, keys))
    for g in ("exp_theo", "exp_notTheo", "notExp_theo", "exp"):
        out += [F.col(f"num_{g}{k}") for k in ions]
        out += [
            F.coalesce(F.try_divide(F.col(f"num_{g}{k}") * (2 if k else 1), "possible"), F.lit(0.0)).alias(f"rel_{g}{k}") for k in ions
        ]
        if g != "exp":
            out += [F.coalesce(F.try_divide(f"num_{g}{k}", f"num_theo{k}"), F.lit(0.0)).alias(f"rel2theo_{g}{k}") for k in ions]
    return counted.select(*out)


def ion_cases(pairs: DataFrame, key: str) -> DataFrame:
    """``key, slot, case, raw_obs, raw_pred, obs, pred`` for each slot of pairs of arrays (``observed, predicted``).

    ``obs`` and ``pred`` are divided by their norms over all slots; only slots with a prediction stay.
    """
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda a: let(norm(a), lambda n: F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))
    zipped = F.arrays_zip(
        F.col("observed").alias("raw_obs"), F.col("predicted").alias("raw_pred"), F.col("uo").alias("obs"), F.col("up").alias("pred")
    )
    made = pairs.withColumns({"uo": unit(F.col("observed")), "up": unit(F.col("predicted"))}).select(key, F.posexplode(zipped).alias("slot", "v"))
    low = F.col("slot") % 6 <= 2
    named = F.array_compact(F.array(F.lit("all"), F.when(~low, "b"), F.when(low, "y")))
    return made.where("v.pred > 0").select(key, "slot", F.explode(named).alias("case"), "v.*")


def spectral_angle(pairs: DataFrame, key: str, charge: int = 0) -> DataFrame:
    """1 - 2 * acos(dot) / pi by ion type; norms are over all slots with a prediction.

    With a fragment ``charge`` (1 to 3) only its slots count in the products; 0 means all.
    """
    chosen = F.lit(True) if not charge else F.col("slot") % 3 == charge - 1
    sums = ion_cases(pairs, key).groupBy(key).agg(
        F.sum(F.when(F.col("case") == "all", F.col("raw_obs") ** 2)).alias("o2"),
        F.sum(F.when(F.col("case") == "all", F.col("raw_pred") ** 2)).alias("p2"),
        *(F.sum(F.when(chosen & (F.col("case") == c), F.col("raw_obs") * F.col("raw_pred")).otherwise(0.0)).alias(f"op_{c}") for c in ("all", "b", "y")),
    )
    norm = F.sqrt("o2") * F.sqrt("p2")
    return sums.select(
        key, *((1 - 2 * F.acos(F.least(F.coalesce(F.try_divide(f"op_{c}", norm), F.lit(0.0)), F.lit(1.0))) / F.lit(3.141592653589793)).alias(f"sa_{c}") for c in ("all", "b", "y"))
    )


def _correlation(x: Column, y: Column) -> Column:
    """Pearson's r from central moments; 0 for fewer than three values or a side that is constant but for rounding."""
    varies = [F.stddev_pop(c) > 1e-12 * F.max(F.abs(c)) for c in (x, y)]
    return F.when((F.count("*") > 2) & varies[0] & varies[1], F.corr(x, y)).otherwise(0.0)


def _log(c: str) -> Column:
    return F.log2(F.col(c) + 1e-7)


def pearson(pairs: DataFrame, key: str) -> DataFrame:
    return ion_cases(pairs, key).groupBy(key, "case").agg(
        _correlation(F.col("raw_obs"), F.col("raw_pred")).alias("pearson"), _correlation(_log("raw_obs"), _log("raw_pred")).alias("pearson_log")
    )


def spearman(pairs: DataFrame, key: str) -> DataFrame:
    """Correlation of average ranks within each key and case."""
    part = W.partitionBy(key, "case")

    def ranked(c: str) -> Column:
        ties = F.count("*").over(W.partitionBy(key, "case", c))
        return F.rank().over(part.orderBy(c)) + (ties - 1) / 2

    made = ion_cases(pairs, key).withColumns({"ro": ranked("raw_obs"), "rp": ranked("raw_pred")})
    return made.groupBy(key, "case").agg(_correlation(F.col("ro"), F.col("rp")).alias("spearman"))


def cosine(pairs: DataFrame, key: str) -> DataFrame:
    o, p = F.col("obs"), F.col("pred")
    lo, lp = F.log2(F.when(o > 0, o)), F.log2(F.when(p > 0, p))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))), F.lit(0.0))
    return ion_cases(pairs, key).groupBy(key, "case").agg(
        ratio(o, p).alias("cos"), F.when(F.min("obs") <= 0, 0.0).otherwise(ratio(lo, lp)).alias("cos_log")
    )


def residual_stats(pairs: DataFrame, key: str) -> DataFrame:
    """Nine statistics of |obs - mean(pred)| and of the pair, by case.

    A case has at most a value for each slot, so its values are gathered once and looked at in the row.
    """
    gathered = ion_cases(pairs, key).groupBy(key, "case").agg(
        F.collect_list(F.struct("obs", "pred")).alias("v"), F.avg("pred").alias("m"),
        F.avg((F.col("obs") - F.col("pred")) ** 2).alias("mse"), F.sum(F.col("obs") * F.col("pred")).alias("dot"),
    )
    made = gathered.withColumn("r", F.array_sort(F.transform("v", lambda v: F.abs(v["obs"] - F.col("m"))))).withColumn("n", F.size("r"))
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    made = made.withColumn("mean", mean)
    std = F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n"))

    def quantile(q: float) -> Column:
        at = q * (F.col("n") - 1)
        low = F.get("r", F.floor(at).cast("int"))
        return low + (at - F.floor(at)) * (F.get("r", F.ceil(at).cast("int")) - low)

    quantiles = [quantile(q).alias(n) for q, n in ((0.75, "q75"), (0.5, "q50"), (0.25, "q25"))]
    return made.select(key, "case", "mean", std.alias("std"), *quantiles, F.get("r", F.lit(0)).alias("min"), F.element_at("r", -1).alias("max"), "mse", "dot")


def histogram(peaks: DataFrame, drop_last: bool = True, most: int = K.MAX_BIN) -> DataFrame:
    """Summed intensity by scan and bin; the highest occupied bin of a scan goes if ``drop_last``.

    The highest bin is found among the scan's bins, which are few, after the peaks are summed.
    """
    from ionweave.functions.spectrum import bin_of

    sums = peaks.select("scan", bin_of(F.col("mz"), most=most).alias("bin"), "intensity").groupBy("scan", "bin").agg(F.sum("intensity").alias("intensity"))
    if drop_last:
        sums = sums.withColumn("top", F.max("bin").over(W.partitionBy("scan"))).where("bin < top").drop("top")
    return sums.where(F.col("bin") < most)


def merge_bins(y: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Probabilities of y bins and of reflected b bins (``scan, bin, p, target``): mean or maximum by bin."""
    turned = b.select("scan", (F.col("target") - F.col("bin") + 1).alias("bin"), "p")
    both = y.select("scan", "bin", "p").unionByName(turned)
    return both.groupBy("scan", "bin").agg((F.avg("p") if how == "mean" else F.max("p")).alias("p"))


def graph_edges(nodes: DataFrame, steps: list[int]) -> DataFrame:
    """Edges ``u < v`` between bins of a scan (``scan, bin``) that a residue's bin lies apart.

    The steps are exploded on one side, so that the theta join becomes an equi-join.
    """
    left = nodes.select("scan", F.col("bin").alias("u"), F.explode(F.array(*map(F.lit, steps))).alias("step"))
    right = nodes.select("scan", F.col("bin").alias("v"))
    return left.withColumn("v", F.col("u") + F.col("step")).join(right, ["scan", "v"]).select("scan", "u", "v", "step")


def top_k(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    w = W.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_by(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The row with the highest score of each group, the least ``tie`` of equals; a grouped maximum.

    A row without a score is the best only of a group that has no scores.
    """
    rest = [c for c in rows.columns if c not in (group, score, tie)]
    best = rows.groupBy(group).agg(F.min(F.struct(F.isnull(score).alias("_none"), (-F.col(score)).alias("_least"), tie, score, *rest)).alias("r"))
    return best.select(group, f"r.{score}", f"r.{tie}", *(f"r.{c}" for c in rest))


def softmax(rows: DataFrame, group: str, score: str, temperature: float) -> DataFrame:
    w = W.partitionBy(group)
    raised = rows.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return raised.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def expand(rows: DataFrame, count: str) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def mass_range_join(chosen: DataFrame, lookup: DataFrame, width: float = 0.05) -> DataFrame:
    """Candidates (``candidate, mass``) within ``low..high`` of each row, without the row's own residues.

    Masses are cut into slices of ``width``; a row asks for its own slices only, so the range
    join is an equi-join with a residual.
    """
    asked = chosen.withColumn(
        "slice", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    )
    held = lookup.withColumn("slice", F.floor(F.col("mass") / width))
    found = asked.join(held, "slice").where("mass BETWEEN low AND high AND candidate <> own")
    return found.drop("slice")


def lookup_table(spark, most: int = 9, heaviest: float = 2 * max(K.RESIDUES.values()) + 0.1, limit: int = 2_000_000) -> DataFrame:
    """All sorted multisets of up to ``most`` residues (I for L) with their masses: ``candidate, mass``.

    Those heavier than any span that a search replaces, two residues, are of no use and left out;
    some thousands are left. A table of more than ``limit`` rows has to come from a file.
    """
    names = [(r, m) for r, m in K.RESIDUES.items() if r != "L"]
    rows: list[tuple[str, float]] = []
    waiting = [("", 0.0, 0, 0)]
    while waiting:
        name, mass, first, n = waiting.pop()
        for k, (r, m) in enumerate(names[first:], first):
            if mass + m <= heaviest:
                rows.append((name + r, mass + m))
                if n + 1 < most:
                    waiting.append((name + r, mass + m, k, n + 1))
        if len(rows) > limit:
            raise ValueError(f"the mass table has more than {limit} rows: read it from a file")
    return spark.createDataFrame(rows, "candidate string, mass double")
