"""The engine's facade: rescoring, bin reclassification, evolutionary search, training."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave import constants as K
from ionweave.functions import peptide as P
from ionweave.functions import spectrum as S
from ionweave.operators import evolve, features, graph, model, relational
from ionweave.plans.rescoring import flag
from ionweave.sources import files


@dataclass(frozen=True)
class Settings:
    """What a run may change; unknown keys of a configuration are ignored."""

    match_ppm: float = K.PPM
    mutation_ppm: float = 20.0
    bin_threshold: float = 0.35
    input_weight: float = 0.1
    population: int = 64
    elite: float = 0.3
    generations: int = 2
    temperature: float = 10.0
    least_score: float = -2.0
    most_score: float = -1.0
    transform: str | None = None
    precursor_range: bool = False
    differences: bool = False
    #: Charges of the ions whose bins the network sees, and how wide a bin is.
    charges: tuple[int, ...] = (1,)
    resolution: float = 1.0
    #: Whether the score that a PSM came with is one more feature.
    original_score: bool = False

    @classmethod
    def of(cls, values: dict):
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})

    @property
    def features(self) -> list[str]:
        return [*K.FEATURES, *["original_score"] * self.original_score]

    @property
    def channels(self) -> dict:
        return {"transform": self.transform, "precursor_range": self.precursor_range, "differences": self.differences, "resolution": self.resolution}


class Engine:
    """Holds the models: a network over bins, a scorer, and what predicts spectra.

    ``predict`` adds ``mz, intensities`` to rows with ``peptide, charge``. No step joins rows by
    their scan: columns go along, so repeated and null scans are rows like any other.
    """

    def __init__(self, spark: SparkSession, network: model.Network | None = None, scorer: model.Scorer | None = None, predict: Callable[[DataFrame], DataFrame] | None = None, settings: Settings | None = None):
        self.spark, self.network, self.scorer = spark, network, scorer
        self.predict = predict or files.uniform_predictions
        self.settings = settings or Settings()

    # --- parts ---------------------------------------------------------------------

    def prepared(self, psms: DataFrame, style: str, valid_only: bool = True) -> DataFrame:
        """PSMs with predictions; ``peptide`` is the normalised one, ``peptide_given`` what it was.

        Those that are not valid are left out, or stay with ``is_valid`` false and no prediction.
        """
        rows = flag(psms, style).withColumnRenamed("peptide", "peptide_given").withColumnRenamed("peptide_norm", "peptide")
        if valid_only:
            return self.predict(rows.where("is_valid"))
        kept = F.when(F.col("is_valid"), F.col("peptide"))
        made = self.predict(rows.withColumn("peptide", kept))
        return made.withColumns({c: F.when(F.col("is_valid"), F.col(c)) for c in ("mz", "intensities")})

    def profiles(self, prepared: DataFrame, peptide: str = "peptide", mz: str = "mz", names: tuple[str, str] = ("y_bins", "b_bins"), more: bool = True) -> DataFrame:
        """``prepared`` with the occupied bins of y and b ions; with ``more``, those of further charges in ``more_bins``."""
        slots = F.filter(F.transform(mz, lambda m, i: F.struct(i.alias("slot"), m.alias("mz"))), lambda s: s["mz"] > 0)
        rows = prepared.withColumns({"_l": slots, "_m": P.mass(F.col(peptide))})
        first, *others = self.settings.charges
        bins = lambda ion, z: S.occupied_bins(F.col("_l"), ion, F.col("_m"), z, self.settings.resolution)
        found = {n: bins(i, first) for n, i in zip(names, ("y", "b"), strict=True)}
        if others and more:
            found["more_bins"] = F.array(*(bins(i, z) for z in others for i in ("y", "b")))
        return rows.withColumns(found).drop("_l", "_m")

    def bin_reclassification(self, prepared: DataFrame) -> DataFrame:
        """``prepared`` with the sparse bin probabilities of each row."""
        if self.network is None:
            raise ValueError("bin reclassification needs a network")
        return model.reclassify(self.profiles(prepared), self.network, self.settings.bin_threshold, **self.settings.channels)

    def with_truth(self, psms: DataFrame, style: str = "mgf") -> DataFrame:
        """Prepared rows of PSMs (with ``peptide_true``) with the bins of their own and of the true peptide: what a network learns from."""
        rows = self.profiles(self.prepared(psms, style))
        kept = [c for c in rows.columns if c not in ("peptide", "mz", "intensities")]
        own = F.struct("peptide", "mz", "intensities").alias("_own")
        turned = self.predict(rows.select(*kept, own, P.normalize(F.col("peptide_true"), style).alias("peptide")))
        return self.profiles(turned, names=("y_true", "b_true"), more=False).drop("peptide", "mz", "intensities").select("*", "_own.*").drop("_own").where("mz IS NOT NULL")

    def features(self, prepared: DataFrame) -> DataFrame:
        """``prepared`` with the feature columns; without a network the counts of changes are 0."""
        if self.network is None:
            rows = prepared.withColumn("y_changes", F.array().cast("array<float>"))
        else:
            rows = self.bin_reclassification(prepared)
        return features.features(rows, self.settings.match_ppm)

    def spectral_angles(self, psms: DataFrame, style: str = "mgf") -> DataFrame:
        return self.features(self.prepared(psms, style)).select("scan", "peptide", "sa_all")

    def rescoring(self, psms: DataFrame, style: str = "mgf") -> DataFrame:
        """``psms`` with ``score``, a row for each; one that is not valid, or has no prediction, has -Infinity."""
        if self.scorer is None:
            raise ValueError("rescoring needs a scorer")
        scored = self.scorer.predict(self.features(self.prepared(psms, style, valid_only=False)))
        score = F.when(F.col("is_valid") & F.col("mz").isNotNull(), F.col("score")).otherwise(float("-inf")).alias("score")
        return scored.drop("peptide").withColumnRenamed("peptide_given", "peptide").select(*psms.columns, score)

    # --- entry points --------------------------------------------------------------

    def rescoring_from_mgf(self, path: str, out: str | None = None) -> DataFrame:
        done = self.rescoring(require_rows(files.read_mgf(self.spark, path))).select("score", "scan")
        if out:
            files.write_csv(done, out)
        return done

    def rescoring_from_csv(self, path: str, out: str | None = None, **columns) -> DataFrame:
        """The file's own columns and ``score``; in the written file also ``index``, which grows from row to row.

        Where the file has a column of such a name, the new one is ``new_score`` or ``new_index``.
        """
        scored = self.rescoring(require_rows(files.read_csv(self.spark, path, original=True, **columns)), "csv")
        own = {c.lower() for c in scored.schema["original"].dataType.names}
        free = lambda name: name if name not in own else free(f"new_{name}")
        done = scored.select("original.*", F.col("score").alias(free("score")))
        if out:
            files.write_csv(done.select(F.monotonically_increasing_id().alias(free("index")), "*"), out)
        return done

    def bin_reclassification_from_mgf(self, path: str, out: str | None = None) -> DataFrame:
        return self._reclassified(files.read_mgf(self.spark, path), out)

    def bin_reclassification_from_arrays(self, path: str, out: str | None = None, **columns) -> DataFrame:
        return self._reclassified(files.read_arrays(self.spark, path, **columns), out)

    def _reclassified(self, psms: DataFrame, out: str | None) -> DataFrame:
        done = self.bin_reclassification(self.prepared(require_rows(psms), "mgf"))
        done = done.select("scan", "y_probs", "y_mz", "b_probs", "b_mz", "y_changes", "y_mz_inputs", "b_mz_inputs")
        if out:
            files.write_parquet(done, out)
        return done

    def search(self, psms: DataFrame, lookup: DataFrame, style: str = "mgf", out: str | None = None, snapshots: str | None = None, lineage: str | None = None) -> DataFrame:
        """``scan, peptide, score, peptide_init, score_init`` after the evolutionary search.

        A scan stands for one spectrum here: of rows with the same scan the one with the least
        peptide is searched for, and null scans are left out. ``snapshots`` is a folder for the
        best peptides and the populations of every generation, ``lineage`` one for whose children they are.
        """
        s = self.settings
        if s.resolution != 1 or s.charges[0] != 1:
            raise ValueError("graphs have bins of 1 m/z of singly charged ions")
        rows = require_rows(psms.where("scan IS NOT NULL"))
        first = self.rescoring(rows, style).where("score > '-Infinity'")
        one = first.groupBy("scan").agg(F.min_by(F.struct(*first.columns), F.struct("peptide", "precursor_mz", "mzs")).alias("r")).select("r.*")
        base = flag(one, style).drop("peptide").withColumnRenamed("peptide_norm", "peptide").checkpoint()
        initial = base.select("scan", "peptide", P.precursor_mass(F.col("precursor_mz"), F.col("charge")).alias("precursor"), "score")
        spectra = base.select("scan", "charge", "precursor_mz", "mzs", "ints", *["original_score"] * s.original_score)

        def prepared(wanted: DataFrame) -> DataFrame:
            return self.predict(wanted.join(spectra, "scan"))

        def score(wanted: DataFrame) -> DataFrame:
            return self.scorer.predict(self.features(prepared(wanted.select("scan", "peptide")))).select("scan", "peptide", "score")

        def bins(drawn: DataFrame) -> DataFrame:
            return graph_bins(self.bin_reclassification(prepared(drawn.select("scan", "peptide"))), s.input_weight)

        def snapshot(scored: DataFrame, generation: int) -> None:
            best = evolve.with_initial(relational.best_by(scored.select("scan", "peptide", "score"), "scan", "score", "peptide"), initial.select("scan", "peptide", "score"))
            files.write_parquet(best, f"{snapshots}/best/generation={generation}")
            files.write_parquet(scored, f"{snapshots}/population/generation={generation}")

        def trace(children: DataFrame, generation: int) -> None:
            files.write_parquet(children, f"{lineage}/generation={generation}")

        found = evolve.run(
            initial, lookup, score, bins, s.generations, s.population, (s.least_score, s.most_score),
            elite=s.elite, temperature=s.temperature, ppm=s.mutation_ppm, snapshot=snapshot if snapshots else None, lineage=trace if lineage else None,
        )
        old = initial.select("scan", F.col("peptide").alias("peptide_init"), F.col("score").alias("score_init"))
        done = found.join(old, "scan")
        if out:
            files.write_csv(done, out)
        return done

    def search_from_mgf(self, path: str, lookup: str | None = None, out: str | None = None, **folders) -> DataFrame:
        return self.search(files.read_mgf(self.spark, path), self._lookup(lookup), out=out, **folders)

    def search_from_csv(self, path: str, lookup: str | None = None, out: str | None = None, snapshots: str | None = None, lineage: str | None = None, random_subset: int | None = None, **columns) -> DataFrame:
        """Large files need no chunks: the file is read and searched in partitions. ``random_subset`` is how many of its rows to take."""
        psms = files.read_csv(self.spark, path, **columns)
        if random_subset is not None:
            psms = evolve.random_subset(psms, "scan", random_subset)
        return self.search(psms, self._lookup(lookup), "search", out, snapshots, lineage)

    def _lookup(self, path: str | None) -> DataFrame:
        return files.read_lookup(self.spark, path) if path else relational.lookup_table(self.spark)

    def feature_table(self, path: str, target: str, out: str | None = None, **columns) -> DataFrame:
        """Features and ``target`` of a CSV file with a target column; from ``out``, if it has been written there before."""
        if out and files.exists(self.spark, out):
            return files.read_features(self.spark, out)
        psms = require_rows(files.read_csv(self.spark, path, more=(target,), **columns))
        made = self.features(self.prepared(psms, "csv")).select(*(F.col(f"`{f}`") for f in self.settings.features), F.col(target).cast("double").alias("target"))
        if not out:
            return made
        files.write_parquet(made, out)
        return files.read_features(self.spark, out)

    def train_scorer(self, paths: list[str], target: str, kind: str = "forest", features_out: str | None = None, **columns) -> model.Scorer:
        """Fit a scorer on the features of CSV files with a target column; ``features_out`` is a folder to keep the features in."""
        places = [f"{features_out}/{k}" if features_out else None for k in range(len(paths))]
        return self.train_scorer_from_features([self.feature_table(p, target, o, **columns) for p, o in zip(paths, places, strict=True)], kind)

    def train_and_test_scorer(self, train: list[str], test: list[str], target: str, kind: str = "forest", **columns) -> tuple[model.Scorer, DataFrame]:
        """A scorer that is fitted on the CSV files ``train``, and its ``path, r2, mse`` on each of ``test``."""
        scorer, found = self.train_scorer(train, target, kind, **columns), None
        for path in test:
            own = self.evaluate_scorer(self.feature_table(path, target, **columns)).select(F.lit(path).alias("path"), "r2", "mse")
            found = own if found is None else found.unionByName(own)
        return scorer, found if found is not None else self.spark.createDataFrame([], "path string, r2 double, mse double")

    def train_scorer_from_features(self, tables: list[DataFrame], kind: str = "forest", **options) -> model.Scorer:
        made = tables[0]
        for more in tables[1:]:
            made = made.unionByName(more)
        self.scorer = model.Scorer.train(made, self.settings.features, "target", kind, **options)
        return self.scorer

    def evaluate_scorer(self, features_: DataFrame) -> DataFrame:
        """``r2, mse`` of the scorer's predicted distances on features with a ``target``."""
        predicted = self.scorer.predict(features_).withColumn("predicted", -F.col("score"))
        return model.metrics(predicted, "target", "predicted")

    def train_bin_reclassifier(self, train: DataFrame, valid: DataFrame, style: str = "mgf", network: model.Network | None = None, **options) -> model.Network:
        """Fit the network on PSMs with a true peptide (``peptide_true``) and keep the best on ``valid``; see ``model.train_network``."""
        extra = 2 * self.settings.differences + self.settings.precursor_range + 2 * (len(self.settings.charges) - 1)
        start = network or self.network or model.Network.random(channels=4 + extra, resolution=self.settings.resolution)
        made = [self.with_truth(x, style).checkpoint() for x in (train, valid)]
        self.network = model.train_network(*made, start, **options, **self.settings.channels)
        return self.network


def require_rows(psms: DataFrame) -> DataFrame:
    """``psms``, if it has a row."""
    if psms.isEmpty():
        raise ValueError("there are no spectra to work on")
    return psms


def graph_bins(sparse: DataFrame, weight: float) -> DataFrame:
    """``scan, peptide, bins, probs, target`` from reclassified rows (one for each scan and peptide).

    y and reflected b probabilities are merged by mean, inputs by maximum. A row's bins are few,
    so they are grouped inside the row and nothing is shuffled.
    """
    rows = sparse.withColumn("target", S.bin_of(P.mass(F.col("peptide")) + 1, most=K.MAX_TARGET))
    pair = lambda b, p: F.transform(F.arrays_zip(F.col(b).alias("b"), F.col(p).alias("p")), lambda x: F.struct(x["b"].alias("bin"), x["p"].cast("double").alias("p")))
    flip = lambda a: F.transform(a, lambda x: F.struct((F.col("target") - x["bin"] + 1).alias("bin"), x["p"].alias("p")))
    shown = F.concat(pair("y_mz", "y_probs"), flip(pair("b_mz", "b_probs"))).alias("_shown")
    given = F.concat(F.col("y_mz_inputs"), F.transform("b_mz_inputs", lambda b: F.col("target") - b + 1)).alias("_given")
    rows = rows.select("scan", "peptide", "target", shown, given)
    bins = F.array_sort(F.array_distinct(F.concat(F.transform("_shown", lambda s: s["bin"]), F.col("_given"))))

    def probability(b):
        mine = F.filter("_shown", lambda s: s["bin"] == b)
        mean = F.try_divide(F.aggregate(mine, F.lit(0.0), lambda a, s: a + s["p"]), F.size(mine))
        return F.greatest(mean, F.when(F.array_contains("_given", b), F.lit(weight)))

    return rows.select("scan", "peptide", "target", bins.alias("bins"), F.transform(bins, probability).alias("probs"))
