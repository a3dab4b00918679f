"""Registered queries over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave import constants as K
from ionweave.functions import peptide as P
from ionweave.functions import spectrum as S
from ionweave.operators import evolve, features, graph, model, trees
from ionweave.operators import relational as R
from ionweave.plans.rescoring import valid
from ionweave.plans.views import peaks, psms, slots, spectra, sql, table, vector_pairs, word_peptides
from ionweave.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Wide enough that the views, which are not spectra, have matches.
VIEW_PPM = 2000.0


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def draw_sql(*parts: str) -> str:
    """A number from 0 up to 1 of ``graph.drawn``."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums may differ in their last digits; ``+ 0.0`` makes -0 to 0."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def flagship(spark, sf_dir):
    """The query that ``entry`` runs."""
    return nearest_peak_join(spark, sf_dir)


@query(sql("SELECT psm, raw, peptide FROM psms"))
def peptide_normalize(spark, d):
    return psms(spark, d).select("psm", "raw", "peptide")


_WORDS = """words AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ADEFGHIKMNPQRSTVWY]{2,30}')) AS peptide FROM documents),
coded AS (SELECT peptide, i, code, mass FROM (SELECT peptide, unnest(t) AS residue, unnest(range(1, len(t) + 1)) AS i FROM (SELECT peptide, string_split(peptide, '') AS t FROM words)) JOIN residues USING (residue))"""


@query(sql("SELECT peptide, count(*) AS n_residues, string_agg(code::VARCHAR, ' ' ORDER BY i) AS codes, peptide AS spelled FROM coded GROUP BY peptide", _WORDS))
def peptide_tokenize(spark, d):
    coded = word_peptides(spark, d).withColumn("c", P.codes(F.col("peptide")))
    return coded.select("peptide", F.size("c").cast("long").alias("n_residues"), F.array_join(F.col("c").cast("array<string>"), " ").alias("codes"), P.spell(F.col("c")).alias("spelled"))


@query(sql(f"SELECT peptide, round(sum(mass) + {K.WATER!r}, 6) AS mass FROM coded GROUP BY peptide", _WORDS))
def peptide_mass(spark, d):
    return rounded(word_peptides(spark, d).select("peptide", P.mass(F.col("peptide")).alias("mass")), "mass")


_VALID = rf"""SELECT psm, coalesce(n_residues, 31) AS n_residues, n_residues IS NOT NULL AND charge <= 6 AND n_residues <= 30 AS mgf_valid,
    n_residues IS NOT NULL AND charge <= 6 AND n_residues > 1 AND n_residues <= 30 AS csv_valid,
    CASE WHEN n_residues IS NOT NULL AND charge <= 6 AND n_residues <= 30 THEN 0.0::DOUBLE ELSE '-infinity'::DOUBLE END AS score
FROM (SELECT psm, charge, CASE WHEN regexp_matches(replace(raw, 'L', 'I'), '^[ACDEFGHIKMNPQRSTVWYZ]*$') THEN CAST(length(raw) AS INTEGER) END AS n_residues FROM psms)"""


@query(sql(_VALID))
def psm_validity(spark, d):
    n = F.size(P.codes(P.normalize(F.col("raw"))))
    made = psms(spark, d).withColumn("n_residues", F.when(n >= 0, n))
    mgf, csv = (valid(F.col("n_residues"), F.col("charge"), style) for style in ("mgf", "csv"))
    length = F.coalesce("n_residues", F.lit(K.MAX_LENGTH + 1)).alias("n_residues")  # unreadable peptides count as too long
    return made.select("psm", length, mgf.alias("mgf_valid"), csv.alias("csv_valid"), F.when(mgf, 0.0).otherwise(float("-inf")).alias("score"))


@query(sql("SELECT psm, slot, round(tmz, 6) AS mz FROM slots"))
def fragment_ladder(spark, d):
    return rounded(slots(spark, d).select("psm", "slot", F.col("tmz").alias("mz")), "mz")


@query(sql("SELECT scan, bin, intensity FROM (SELECT scan, bin, sum(intensity) AS intensity, max(bin) OVER (PARTITION BY scan) AS top FROM (SELECT scan, CAST(least(floor(mz), 2001) AS INTEGER) AS bin, intensity FROM peaks) GROUP BY scan, bin) WHERE bin < top AND bin < 2000"))
def peak_binning(spark, d):
    return R.histogram(peaks(spark, d))


_SPECTRA = "spectra AS (SELECT *, max(intensity) OVER (PARTITION BY scan) AS top, avg(mz) OVER (PARTITION BY scan) AS center FROM peaks)"


def _spectra(spark, d):
    p = peaks(spark, d).groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("pos", "mz", "intensity"))).alias("p"))
    return p.select("scan", F.transform("p", lambda x: F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity"))).alias("s"))


@query(sql("SELECT scan, count(*) AS n, round(sum(mz * intensity / top), 4) AS moment, round(sum(intensity / top), 6) AS total FROM spectra WHERE intensity / top >= 0.02 GROUP BY scan", _SPECTRA))
def max_normalize(spark, d):
    kept = _spectra(spark, d).withColumn("s", S.at_least(S.max_normalize(F.col("s")), 0.02)).select("scan", F.inline("s"))
    return kept.groupBy("scan").agg(F.count("*").alias("n"), F.round(F.sum(F.col("mz") * F.col("intensity")), 4).alias("moment"), F.round(F.sum("intensity"), 6).alias("total"))


@query(sql("SELECT scan, count(*) AS n FROM peaks WHERE NOT abs(mz - 400.0::DOUBLE) <= 20000.0::DOUBLE * 1e-6::DOUBLE * 400.0::DOUBLE GROUP BY scan"))
def precursor_filter(spark, d):
    kept = S.remove_precursor(F.col("s"), F.lit(400.0), 20000.0)
    return _spectra(spark, d).select("scan", F.size(kept).cast("long").alias("n")).where("n > 0")


_OCC = f"""ions AS (SELECT psm, 'b' AS ion, tmz AS mz FROM slots WHERE slot % 6 = 3 UNION ALL SELECT psm, 'y', tmz FROM slots WHERE slot % 6 = 0
 UNION ALL SELECT psm, unnest(['b', 'b', 'y', 'y']), unnest([1.0::DOUBLE, m - 17, 19.0::DOUBLE, m + 1]) FROM (SELECT DISTINCT psm, whole + {K.WATER!r} AS m FROM sums))"""


@query(sql("SELECT DISTINCT psm, ion, CAST(least(floor(mz), 2001) AS INTEGER) AS bin FROM ions WHERE floor(mz) > 0 AND floor(mz) < 2000", _OCC))
def occupancy_profile(spark, d):
    p = psms(spark, d).withColumns({"l": P.ladder(F.col("peptide"), F.col("charge")), "m": P.mass(F.col("peptide"))}).where(F.size(P.tokens(F.col("peptide"))) > 0)

    def marked(ion: str):
        return F.transform(S.occupied_bins(F.col("l"), ion, F.col("m")), lambda b: F.struct(F.lit(ion).alias("ion"), b.alias("bin")))

    return p.select("psm", F.inline(F.concat(marked("b"), marked("y"))))


_FINE = f"""ions AS (SELECT psm, CASE WHEN slot % 6 < 3 THEN 'y' ELSE 'b' END AS ion, CAST(slot % 3 + 1 AS INTEGER) AS charge, tmz AS mz FROM slots
 UNION ALL SELECT psm, ion, z, mz / z FROM (SELECT psm, unnest(['b', 'b', 'y', 'y']) AS ion, unnest([1.0::DOUBLE, m - 17, 19.0::DOUBLE, m + 1]) AS mz FROM (SELECT DISTINCT psm, whole + {K.WATER!r} AS m FROM sums)), (VALUES (1), (2), (3)) c(z))"""


@query(sql("SELECT DISTINCT psm, ion, charge, CAST(least(floor(mz / 0.5::DOUBLE), 4001) AS INTEGER) AS bin FROM ions WHERE floor(mz / 0.5::DOUBLE) > 0 AND floor(mz / 0.5::DOUBLE) < 4000", _FINE))
def occupancy_fine(spark, d):
    """Profiles of three fragment charges in bins of half an m/z."""
    p = psms(spark, d).withColumns({"l": P.ladder(F.col("peptide"), F.col("charge")), "m": P.mass(F.col("peptide"))}).where(F.size(P.tokens(F.col("peptide"))) > 0)

    def marked(ion: str, z: int):
        return F.transform(S.occupied_bins(F.col("l"), ion, F.col("m"), z, 0.5), lambda b: F.struct(F.lit(ion).alias("ion"), F.lit(z).alias("charge"), b.alias("bin")))

    return p.select("psm", F.inline(F.concat(*(marked(i, z) for i in "by" for z in (1, 2, 3)))))


_J1 = f"""common AS (SELECT scan, psm, slot, tmz, tint, coalesce(best.mz, 0) AS emz, coalesce(best.intensity, 0) AS eint FROM (
 SELECT s.scan, s.psm, s.slot, s.tmz, s.tint, min({{'away': abs(tmz - mz), 'pos': pos, 'mz': mz, 'intensity': intensity}}) FILTER (mz IS NOT NULL) AS best
 FROM slots s LEFT JOIN peaks p ON s.scan = p.scan AND 1e6 * abs(tmz - mz) <= {VIEW_PPM} * tmz GROUP BY ALL))"""


@query(sql("SELECT psm, slot, round(tmz, 6) AS tmz, tint, round(emz, 6) AS emz, eint FROM common", _J1))
def nearest_peak_join(spark, d):
    """A PSM holds its spectrum, so slots and peaks are matched inside the row."""
    return rounded(features.matched_slots(spectra(spark, d), ["psm"], VIEW_PPM), "tmz", "emz")


@query(sql("SELECT psm, slot, round(tmz, 6) AS tmz, tint, round(emz, 6) AS emz, eint FROM common", _J1))
def nearest_peak_relational(spark, d):
    """The same where peaks are rows of a table."""
    return rounded(R.nearest_peaks(slots(spark, d), peaks(spark, d), ["psm"], VIEW_PPM).drop("scan"), "tmz", "emz")


def _counting_sql() -> str:
    ions = {"": "true", "_b": "slot % 6 > 2", "_y": "slot % 6 <= 2"}
    t, e = "tint > 0", "eint > 0"
    groups = {"exp_theo": f"{t} AND {e}", "exp_notTheo": f"tmz > 0 AND NOT {t} AND {e}", "notExp_theo": f"{t} AND NOT {e}", "exp": e}
    out = []
    for g, p in groups.items():
        for k, i in ions.items():
            n = f"count(*) FILTER ({p} AND {i})::DOUBLE"
            out.append(f"{n} AS num_{g}{k}")
            out.append(f"round(coalesce({n} * {2 if k else 1} / nullif(count(*) FILTER (tmz > 0), 0), 0), 6) AS rel_{g}{k}")
            if g != "exp":
                out.append(f"round(coalesce({n} / nullif(count(*) FILTER ({t} AND {i}), 0), 0), 6) AS rel2theo_{g}{k}")
    return f"SELECT psm, {', '.join(out)} FROM common GROUP BY psm"


@query(sql(_counting_sql(), _J1))
def counting_features(spark, d):
    found = R.counting_features(features.matched_slots(spectra(spark, d), ["psm"], VIEW_PPM), ["psm"])
    return rounded(found, *(c for c in found.columns if c.startswith("rel")))


def _angles(more: str = "") -> str:
    one = lambda c: f"""round(1 - 2 * acos(least(coalesce(sum(raw_obs * raw_pred) FILTER ("case" = '{c}'{more}) / nullif(nn, 0), 0), 1)) / pi(), 6) AS sa_{c}"""
    norms = """(SELECT vec_id, sqrt(sum(raw_obs ** 2)) * sqrt(sum(raw_pred ** 2)) AS nn FROM cases WHERE "case" = 'all' GROUP BY vec_id)"""
    return f"SELECT vec_id, {', '.join(map(one, ('all', 'b', 'y')))} FROM cases JOIN {norms} USING (vec_id) GROUP BY vec_id, nn"


@query(sql(_angles(" AND slot % 3 = 0")))
def spectral_angle_charge(spark, d):
    """Spectral angles over the slots of singly charged fragments."""
    return rounded(R.spectral_angle(vector_pairs(spark, d), "vec_id", charge=1), "sa_all", "sa_b", "sa_y")


@query(sql("""SELECT vec_id, round(1 - 2 * acos(least(coalesce(sum(raw_obs * raw_pred) FILTER ("case" = 'all') / nullif(nn, 0), 0), 1)) / pi(), 6) AS sa_all,
 round(1 - 2 * acos(least(coalesce(sum(raw_obs * raw_pred) FILTER ("case" = 'b') / nullif(nn, 0), 0), 1)) / pi(), 6) AS sa_b,
 round(1 - 2 * acos(least(coalesce(sum(raw_obs * raw_pred) FILTER ("case" = 'y') / nullif(nn, 0), 0), 1)) / pi(), 6) AS sa_y
FROM cases JOIN (SELECT vec_id, sqrt(sum(raw_obs ** 2)) * sqrt(sum(raw_pred ** 2)) AS nn FROM cases WHERE "case" = 'all' GROUP BY vec_id) USING (vec_id) GROUP BY vec_id, nn"""))
def spectral_angle(spark, d):
    return rounded(R.spectral_angle(vector_pairs(spark, d), "vec_id"), "sa_all", "sa_b", "sa_y")


def _corr(x: str, y: str) -> str:
    varies = " AND ".join(f"stddev_pop({c}) > 1e-12::DOUBLE * max(abs({c}))" for c in (x, y))
    return f"CASE WHEN count(*) > 2 AND {varies} THEN round(corr({x}, {y}), 6) ELSE 0 END"


@query(sql(f"""SELECT vec_id, "case", {_corr('raw_obs', 'raw_pred')} AS pearson, {_corr('log2(raw_obs + 1e-7)', 'log2(raw_pred + 1e-7)')} AS pearson_log FROM cases GROUP BY vec_id, "case" """))
def pearson(spark, d):
    return rounded(R.pearson(vector_pairs(spark, d), "vec_id"), "pearson", "pearson_log")


@query(sql(f"""SELECT vec_id, "case", {_corr('ro', 'rp')} AS spearman FROM (SELECT vec_id, "case",
 rank() OVER (PARTITION BY vec_id, "case" ORDER BY raw_obs) + (count(*) OVER (PARTITION BY vec_id, "case", raw_obs) - 1) / 2.0::DOUBLE AS ro,
 rank() OVER (PARTITION BY vec_id, "case" ORDER BY raw_pred) + (count(*) OVER (PARTITION BY vec_id, "case", raw_pred) - 1) / 2.0::DOUBLE AS rp FROM cases) GROUP BY vec_id, "case" """))
def spearman(spark, d):
    return rounded(R.spearman(vector_pairs(spark, d), "vec_id"), "spearman")


@query(sql("""SELECT vec_id, "case", round(coalesce(sum(obs * pred) / nullif(sqrt(sum(obs * obs)) * sqrt(sum(pred * pred)), 0), 0), 6) AS cos,
 CASE WHEN min(obs) <= 0 THEN 0 ELSE round(coalesce(sum(log2(nullif(obs, 0)) * log2(pred)) / nullif(sqrt(sum(log2(nullif(obs, 0)) ** 2)) * sqrt(sum(log2(pred) ** 2)), 0), 0), 6) END AS cos_log
FROM cases GROUP BY vec_id, "case" """))
def cosine(spark, d):
    return rounded(R.cosine(vector_pairs(spark, d), "vec_id"), "cos", "cos_log")


@query(sql("""SELECT vec_id, "case", round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(quantile_cont(r, 0.75), 6) AS q75, round(quantile_cont(r, 0.5), 6) AS q50,
 round(quantile_cont(r, 0.25), 6) AS q25, round(min(r), 6) AS min, round(max(r), 6) AS max, round(avg((obs - pred) ** 2), 6) AS mse, round(sum(obs * pred), 6) AS dot
FROM (SELECT *, abs(obs - avg(pred) OVER (PARTITION BY vec_id, "case")) AS r FROM cases) GROUP BY vec_id, "case" """))
def residual_stats(spark, d):
    return rounded(R.residual_stats(vector_pairs(spark, d), "vec_id"), *K.STATS)



_TINT = "((slot * 37 + psm * 11) % 13)::DOUBLE / 13.0::DOUBLE"


def _feature_sql() -> str:
    """All features of each PSM of the view from its slots: similarities by case, raw and in logarithms, then counts."""
    per_case = f"""SELECT psm, "case", {_corr('o', 'p')} AS pearson, {_corr('ra', 'rb')} AS spearman,
 CASE WHEN is_log AND min(a) <= 0 THEN 0 ELSE round(coalesce(sum(ca * cb) / nullif(sqrt(sum(ca * ca)) * sqrt(sum(cb * cb)), 0), 0), 6) END AS cos,
 round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(quantile_cont(r, 0.75), 6) AS q75, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.25), 6) AS q25,
 round(min(r), 6) AS min, round(max(r), 6) AS max, round(avg((x - y) ** 2), 6) AS mse, round(sum(x * y), 6) AS dot FROM ranked GROUP BY psm, "case", is_log"""
    pivoted = ", ".join(f"""coalesce(max({s}) FILTER ("case" = '{c}'), 0) + 0.0::DOUBLE AS {s}_{c}""" for s in ("pearson", "cos", *K.STATS, "spearman") for c in K.CASES)
    angle = lambda c: f"""round(1 - 2 * acos(least(coalesce(sum(o * p) FILTER ("case" = '{c}') / nullif(sqrt(sum(o * o) FILTER ("case" = 'all')) * sqrt(sum(p * p) FILTER ("case" = 'all')), 0), 0), 1)) / pi(), 6) + 0.0::DOUBLE AS sa_{c}"""
    changes = ", ".join(f"count(*) FILTER (tint > {t}::DOUBLE)::DOUBLE AS p2p_gt_{int(100 * t)}" for t in K.CHANGE_THRESHOLDS)
    more = f"""pred AS (SELECT scan, psm, slot, tmz, {_TINT} AS tint FROM slots),
{_J1.replace("FROM slots s", "FROM pred s")},
unit AS (SELECT *, eint / coalesce(nullif(sqrt(sum(eint ** 2) OVER (PARTITION BY psm)), 0), 1) AS a, tint / coalesce(nullif(sqrt(sum(tint ** 2) OVER (PARTITION BY psm)), 0), 1) AS b FROM common),
shown AS (SELECT u.*, c.c AS ion FROM unit u JOIN (VALUES ('all'), ('b'), ('y')) c(c) ON tint > 0 AND (c.c = 'all' OR (c.c = 'b') = (slot % 6 > 2))),
scaled AS (SELECT psm, ion AS "case", false AS is_log, eint AS o, tint AS p, a, a AS x, b AS y, a AS ca, b AS cb FROM shown UNION ALL
 SELECT psm, ion || '_log', true, log2(eint + 1e-7), log2(tint + 1e-7), a, log2(a + 1e-7), log2(b + 1e-7), log2(nullif(a, 0)), log2(b) FROM shown),
ranked AS (SELECT *, abs(x - avg(y) OVER (PARTITION BY psm, "case")) AS r,
 rank() OVER (PARTITION BY psm, "case" ORDER BY x) + (count(*) OVER (PARTITION BY psm, "case", x) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY psm, "case" ORDER BY y) + (count(*) OVER (PARTITION BY psm, "case", y) - 1) / 2.0::DOUBLE AS rb FROM scaled),
per_case AS ({per_case}), counts AS ({_counting_sql()}),
wide AS (SELECT psm, {pivoted} FROM (SELECT DISTINCT psm FROM common) LEFT JOIN per_case USING (psm) GROUP BY psm),
angles AS (SELECT psm, {', '.join(map(angle, K.CASES[:3]))} FROM (SELECT DISTINCT psm FROM common) LEFT JOIN scaled USING (psm) GROUP BY psm),
changed AS (SELECT psm, {changes} FROM common GROUP BY psm)"""
    return sql(f"SELECT psm, {', '.join(K.FEATURES)} FROM wide JOIN angles USING (psm) JOIN counts USING (psm) JOIN changed USING (psm)", more)


@query(_feature_sql())
def feature_vector(spark, d):
    """All 114 features of each PSM, as rescoring makes them; its predicted intensities stand for probabilities of change too."""
    given = F.transform("mz", lambda m, i: F.when(m > 0, (i * 37 + F.col("psm") * 11) % 13 / F.lit(13.0)).otherwise(-1.0))
    rows = files.uniform_predictions(spectra(spark, d)).where(F.exists("mz", lambda m: m > 0)).withColumn("intensities", given)
    made = features.features(rows.withColumn("y_changes", F.filter("intensities", lambda x: x >= 0)), VIEW_PPM, ["psm"])
    return rounded(made, *K.FEATURES)


_CHANGES = "changes AS (SELECT vec_id, slot, p, CASE WHEN slot % 2 = 1 THEN 1 - p ELSE p END AS c FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS slot, 1 / (1 + exp(-10 * unnest(embedding)::DOUBLE)) AS p FROM embeddings))"


@query(sql(f"SELECT vec_id, {', '.join(f'count(*) FILTER (c > {t}::DOUBLE) AS gt_{int(t * 100)}' for t in K.CHANGE_THRESHOLDS)}, count(*) FILTER (p > 0.35::DOUBLE) AS kept FROM changes GROUP BY vec_id", _CHANGES))
def change_counts(spark, d):
    p = F.transform("embedding", lambda x: S.sigmoid(x.cast("double") * 10))
    made = table(spark, d, "embeddings").withColumn("p", p).withColumn("c", F.transform("p", lambda x, i: S.change(x, i % 2 == 1)))
    over = lambda c, t: F.size(F.filter(c, lambda x: x > t)).cast("long")
    return made.select("vec_id", *(over("c", t).alias(f"gt_{int(t * 100)}") for t in K.CHANGE_THRESHOLDS), over("p", 0.35).alias("kept"))


_BINS = """bins AS (SELECT scan, CAST(least(floor(mz), 2001) AS INTEGER) AS bin, pos % 2 AS ion, intensity / 100 AS p, 2001 AS target FROM peaks),
merged AS (SELECT scan, bin, p FROM bins WHERE ion = 0 UNION ALL SELECT scan, target - bin + 1, p FROM bins WHERE ion = 1)"""


def _merged(spark, d, how):
    b = peaks(spark, d).select("scan", S.bin_of(F.col("mz")).alias("bin"), "pos", (F.col("intensity") / 100).alias("p"), F.lit(2001).alias("target"))
    return R.merge_bins(b.where("pos % 2 = 0"), b.where("pos % 2 = 1"), how)


@query(sql("SELECT scan, bin, round(avg(p), 6) AS p FROM merged GROUP BY scan, bin", _BINS))
def bin_merge_mean(spark, d):
    return rounded(_merged(spark, d, "mean"), "p")


@query(sql("SELECT scan, bin, round(max(p), 6) AS p FROM merged GROUP BY scan, bin", _BINS))
def bin_merge_max(spark, d):
    return rounded(_merged(spark, d, "max"), "p")


_STEPS = list(K.residue_bins())
_EDGES = f"nodes AS (SELECT DISTINCT scan, CAST(least(floor(mz), 2001) AS INTEGER) AS bin FROM peaks), edges AS (SELECT a.scan, a.bin AS u, b.bin AS v, b.bin - a.bin AS step FROM nodes a JOIN nodes b ON a.scan = b.scan AND b.bin - a.bin IN ({', '.join(map(str, _STEPS))}))"


def _nodes(spark, d):
    return peaks(spark, d).select("scan", S.bin_of(F.col("mz")).alias("bin")).distinct()


@query(sql("SELECT scan, u, v, step FROM edges", _EDGES))
def graph_edges(spark, d):
    return R.graph_edges(_nodes(spark, d), _STEPS)


@query(sql("SELECT scan, bin FROM reach", _EDGES + ", reach AS (SELECT scan, max(bin) AS bin FROM nodes GROUP BY scan UNION SELECT e.scan, e.u FROM reach r JOIN edges e ON e.scan = r.scan AND e.v = r.bin)"))
def graph_reachability(spark, d):
    return graph.reachable(_nodes(spark, d), _STEPS)


_NAMED = ", ".join(f"({step}, '{names[0]}')" for step, names in K.residue_bins().items())
_PATHS = _EDGES + f""", weighted AS (SELECT scan, bin, max(p) AS p FROM (SELECT scan, CAST(least(floor(mz), 2001) AS INTEGER) AS bin, intensity / 100 AS p FROM peaks) GROUP BY scan, bin),
reach AS (SELECT scan, max(bin) AS bin FROM nodes GROUP BY scan UNION SELECT e.scan, e.u FROM reach r JOIN edges e ON e.scan = r.scan AND e.v = r.bin),
ends AS (SELECT scan, min(bin) AS source, max(bin) AS target, CAST(count(*) AS INTEGER) AS n_nodes FROM reach GROUP BY scan),
kept AS (SELECT r.scan, r.bin, CASE WHEN r.bin IN (source, target) THEN 1e-3::DOUBLE ELSE p END AS p FROM reach r JOIN weighted USING (scan, bin) JOIN ends USING (scan)),
steps(step, residue) AS (VALUES {_NAMED}),
links AS (SELECT e.scan, u, v, residue, (a.p + b.p) / 2 / sum((a.p + b.p) / 2) OVER (PARTITION BY e.scan, u) AS w
 FROM edges e JOIN kept a ON a.scan = e.scan AND a.bin = u JOIN kept b ON b.scan = e.scan AND b.bin = v JOIN steps USING (step)),
paths AS (SELECT scan, source AS bin, '' AS peptide, 0::DOUBLE AS score FROM ends UNION ALL
 SELECT p.scan, v, residue || peptide, score + w FROM paths p JOIN links l ON l.scan = p.scan AND l.u = p.bin)"""


@query(sql("SELECT scan, peptide, n_nodes, round(score, 6) AS score FROM paths JOIN ends USING (scan) WHERE bin = target QUALIFY row_number() OVER (PARTITION BY scan ORDER BY score DESC, peptide) = 1", _PATHS))
def longest_path(spark, d):
    weighted = peaks(spark, d).select("scan", S.bin_of(F.col("mz")).alias("bin"), (F.col("intensity") / 100).alias("p"))
    return rounded(graph.longest_paths(weighted.groupBy("scan", "bin").agg(F.max("p").alias("p")), _STEPS, source=None), "score")


_CHOICES = ", ".join(f"({step}, {k}, {len(names)}, '{r}')" for step, names in K.residue_bins().items() for k, r in enumerate(names))
_WALKS = _PATHS[: _PATHS.index("paths AS")] + f"""choices(step, k, many, residue) AS (VALUES {_CHOICES}),
ways AS (SELECT scan, u, v, w, coalesce(sum(w) OVER (PARTITION BY scan, u ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
 sum(w) OVER (PARTITION BY scan, u ORDER BY v) AS upto, sum(w) OVER (PARTITION BY scan, u) AS total FROM links),
walks AS (SELECT scan, CAST(path AS INTEGER) AS path, source AS bin, 0 AS step, '' AS peptide, 0::DOUBLE AS score FROM ends, range(5) r(path)
 UNION ALL SELECT w.scan, w.path, l.v, w.step + 1, c.residue || w.peptide, w.score + l.w
 FROM walks w JOIN ways l ON l.scan = w.scan AND l.u = w.bin JOIN choices c ON c.step = l.v - l.u
 WHERE {draw_sql("w.scan", "w.path", "w.step", "'walk'")} * total >= below AND {draw_sql("w.scan", "w.path", "w.step", "'walk'")} * total < upto
  AND c.k = CAST(floor({draw_sql("w.scan", "w.path", "w.step", "'residue'")} * c.many) AS INTEGER))"""


@query(sql("SELECT scan, path, peptide, round(score, 6) AS score FROM walks JOIN ends USING (scan) WHERE bin = target", _WALKS))
def graph_walk(spark, d):
    weighted = peaks(spark, d).select("scan", S.bin_of(F.col("mz")).alias("bin"), (F.col("intensity") / 100).alias("p"))
    return rounded(graph.walks(weighted.groupBy("scan", "bin").agg(F.max("p").alias("p")), _STEPS, paths=5, source=None), "score")


def _scores(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("scan"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("score"))


_SCORES = "scores AS (SELECT o_custkey AS scan, o_orderkey AS candidate, o_totalprice AS score FROM orders)"


@query(sql("SELECT scan, candidate, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scan ORDER BY score DESC, candidate) AS INTEGER) AS rank FROM scores) WHERE rank <= 19", _SCORES))
def elite_topk(spark, d):
    return R.top_k(_scores(spark, d), "scan", [F.desc("score"), F.asc("candidate")], 19)


_BEST = _SCORES + ", best AS (SELECT scan, candidate, score FROM scores QUALIFY row_number() OVER (PARTITION BY scan ORDER BY score DESC, candidate) = 1)"


@query(sql("SELECT scan, candidate, score FROM best", _BEST))
def best_per_scan(spark, d):
    return R.best_by(_scores(spark, d), "scan", "score", "candidate")


@query(sql("SELECT scan, candidate, round(e / sum(e) OVER (PARTITION BY scan), 6) AS weight FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY scan)) / 10000) AS e FROM scores)", _SCORES))
def softmax_weights(spark, d):
    return rounded(R.softmax(_scores(spark, d), "scan", "score", 10000.0).select("scan", "candidate", "weight"), "weight")


@query(sql("SELECT c_custkey AS scan, coalesce(candidate, -1) AS candidate, coalesce(score, c_acctbal) AS score FROM customer LEFT JOIN best ON scan = c_custkey", _BEST))
def ea_result_coalesce(spark, d):
    init = table(spark, d, "customer").select(F.col("c_custkey").alias("scan"), F.lit(-1).cast("long").alias("candidate"), F.col("c_acctbal").alias("score"))
    return evolve.with_initial(R.best_by(_scores(spark, d), "scan", "score", "candidate"), init)


@query(sql("SELECT scan, candidate, score FROM scores s WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.candidate)", _SCORES))
def cache_misses(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate"))
    return _scores(spark, d).join(known, "candidate", "left_anti")


_LOOKUP = f"""names AS (SELECT residue AS r, mass AS m, code AS c FROM residues WHERE residue <> 'L'),
lookup AS (SELECT r AS candidate, c AS last, m AS mass FROM names UNION ALL SELECT candidate || r, c, mass + m FROM lookup JOIN names ON c >= last AND mass + m <= {2 * max(K.RESIDUES.values()) + 0.1!r}),
spans AS (SELECT psm, any_value(r1) || any_value(r2) AS own, sum(mass) AS m FROM (SELECT psm, mass, min(code) OVER (PARTITION BY psm) AS lo, max(code) OVER (PARTITION BY psm) AS hi FROM toks JOIN residues USING (residue) WHERE n >= 2 AND i - 1 - psm * 7919 % (n - 1) IN (0, 1))
 JOIN (SELECT code AS lo, residue AS r1 FROM residues) USING (lo) JOIN (SELECT code AS hi, residue AS r2 FROM residues) USING (hi) GROUP BY psm)"""


@query(sql("SELECT psm, own, candidate, round(mass, 6) AS mass FROM spans, lookup WHERE mass BETWEEN m - 0.02::DOUBLE AND m + 0.02::DOUBLE AND candidate <> own", _LOOKUP))
def mass_range_join(spark, d):
    """Replacements for one span of each peptide: two residues at a place that its number draws, as a mutation does."""
    codes = P.codes(F.col("peptide"))
    two = F.slice(codes, (F.col("psm") * 7919 % (F.size(codes) - 1) + 1).cast("int"), 2)
    chosen = psms(spark, d).where(F.size(codes) >= 2).select("psm", P.spell(F.array_sort(two)).alias("own"), P.total(P.residue_masses(P.spell(two))).alias("m"))
    found = R.mass_range_join(chosen.select("psm", "own", (F.col("m") - 0.02).alias("low"), (F.col("m") + 0.02).alias("high")), R.lookup_table(spark))
    return rounded(found.select("psm", "own", "candidate", "mass"), "mass")


@query("SELECT l_suppkey AS scan, l_partkey AS candidate, count(*) AS n FROM lineitem GROUP BY ALL")
def population_unique_count(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("scan"), F.col("l_partkey").alias("candidate")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS scan, l_linenumber AS candidate, CAST(unnest(range(1, CAST(l_quantity AS INTEGER) + 1)) AS INTEGER) AS copy FROM lineitem")
def expand_by_count(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("candidate"), "l_quantity")
    return R.expand(rows, "l_quantity").select("scan", "candidate", "copy")


@query("SELECT o_orderstatus, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) AS r2, round(avg((y - p) ** 2) / 1e6, 3) AS mse FROM (SELECT o_orderstatus, o_totalprice AS y, o_orderkey::DOUBLE AS p, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m FROM orders) GROUP BY o_orderstatus")
def regression_metrics(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").alias("y"), F.col("o_orderkey").cast("double").alias("p"))
    return model.metrics(rows, "y", "p", ["o_orderstatus"]).select("o_orderstatus", F.round("r2", 6).alias("r2"), F.round(F.col("mse") / 1e6, 3).alias("mse"))


@query(sql("SELECT a.psm, b.psm AS other, levenshtein(replace(a.peptide, 'C[UNIMOD:4]', 'C'), replace(b.peptide, 'C[UNIMOD:4]', 'C'))::INTEGER AS distance FROM psms a JOIN psms b ON b.psm = a.psm + 1"))
def residue_distance(spark, d):
    a = psms(spark, d).select("psm", "peptide")
    b = a.select((F.col("psm") - 1).alias("psm"), F.col("psm").alias("other"), F.col("peptide").alias("next"))
    return a.join(b, "psm").select("psm", "other", P.residue_distance(F.col("peptide"), F.col("next")).alias("distance"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 3)))::DECIMAL(12,3)::DOUBLE AS total, len(embedding)::INTEGER AS n FROM embeddings")
def float_list_parse(spark, d):
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.format_string("%.3f", F.round(x.cast("double"), 3))), ", "), F.lit("]"))
    made = table(spark, d, "embeddings").select("vec_id", P.float_list(text).alias("x"))
    return made.select("vec_id", F.round(P.total(F.col("x")), 3).alias("total"), F.size("x").alias("n"))


@query(sql("SELECT psm, scan, charge, peptide, raw FROM psms ORDER BY md5(psm || '|13')[1:13], psm LIMIT 200"))
def random_subset(spark, d):
    return evolve.random_subset(psms(spark, d), "psm", 200)


def _mutant_sql(size: int = 64, ppm: float = 20.0, precursor: float = 1500.0) -> str:
    """The mutants of every peptide, one after the other: ``made(scan, number, peptide)``; a draw's key is scan, peptide, number and purpose."""
    at = lambda *of: draw_sql("scan", "peptide", "number", *of)
    order = lambda n, *of: f"list_transform(list_sort(list_transform(range({n}), lambda i: {{'u': {at(*of, 'i')}, 'i': i}})), lambda x: x.i)"
    names = ", ".join(f"'{r}'" for r in K.RESIDUES)
    return f"""base AS MATERIALIZED (SELECT CAST(psm AS VARCHAR) AS scan, peptide, list(residue ORDER BY i) AS t, list(mass ORDER BY i) AS m, list(code ORDER BY i) AS c, CAST(count(*) AS INTEGER) AS len
 FROM toks JOIN residues USING (residue) JOIN (SELECT psm, peptide FROM psms) USING (psm) GROUP BY ALL),
names AS (SELECT residue AS r, mass AS m, code AS c FROM residues WHERE residue <> 'L'),
lookup AS (SELECT r AS candidate, [r] AS parts, c AS last, m AS mass FROM names
 UNION ALL SELECT candidate || r, list_append(parts, r), c, mass + m FROM lookup JOIN names ON c >= last AND mass + m <= {2 * max(K.RESIDUES.values()) + 0.1!r}),
spots AS (SELECT scan, peptide, number, t, m, c, len, {at("'kind'")} <= 0.4::DOUBLE AS swapped FROM base, range({size}) r(number)),
tries AS MATERIALIZED (SELECT *, [{names}][least(c[place + 1], c[place + many])] || CASE WHEN many = 2 THEN [{names}][greatest(c[place + 1], c[place + 2])] ELSE '' END AS own,
  CASE WHEN many = 2 THEN 0::DOUBLE + m[place + 1] + m[place + 2] ELSE m[place + 1] END AS weight
 FROM (SELECT *, CAST(least(wanted, len - 1 - place) AS INTEGER) AS many FROM (SELECT *,
   1 + CAST(floor({at("a", "'many'")} * (greatest(2, least(3, len - 1)) - 1)) AS INTEGER) AS wanted,
   CAST(floor({at("a", "'place'")} * (len - 1)) AS INTEGER) AS place, {at("a", "'pick'")} AS pick FROM spots, range(5) q(a) WHERE NOT swapped AND len > 1))),
sliced AS MATERIALIZED (SELECT candidate, parts, mass, CAST(floor(mass * 10) AS INTEGER) AS slice FROM lookup),
steps AS (SELECT scan, CAST(-1 AS BIGINT) AS number, (-{precursor!r}::DOUBLE * {ppm!r}::DOUBLE) * 1e-6::DOUBLE AS lo, ({precursor!r}::DOUBLE * {ppm!r}::DOUBLE) * 1e-6::DOUBLE AS hi,
  NULL::BIGINT AS a, NULL::INTEGER AS place, NULL::INTEGER AS many, NULL::VARCHAR[] AS parts FROM base
 UNION ALL SELECT scan, number, lo - coalesce(off, 0), hi - coalesce(off, 0), a, place, many, parts FROM (
  SELECT *, row_number() OVER (PARTITION BY scan ORDER BY a NULLS LAST, abs(spot - floor(pick * found))) AS first FROM (
   SELECT x.scan, x.number, x.lo, x.hi, CASE WHEN k.candidate IS NULL THEN NULL ELSE x.a END AS a, x.place, x.many, x.pick, k.parts, k.mass - x.weight AS off,
    row_number() OVER (PARTITION BY x.scan, x.a ORDER BY k.mass NULLS LAST, k.candidate) - 1 AS spot, count(k.candidate) OVER (PARTITION BY x.scan, x.a) AS found
   FROM (SELECT p.scan, p.number + 1 AS number, p.lo, p.hi, y.a, y.place, y.many, y.pick, y.weight, y.own,
      unnest(CASE WHEN floor((y.weight + p.lo) * 10) = floor((y.weight + p.hi) * 10) THEN [CAST(floor((y.weight + p.lo) * 10) AS INTEGER)]
       ELSE [CAST(floor((y.weight + p.lo) * 10) AS INTEGER), CAST(floor((y.weight + p.hi) * 10) AS INTEGER)] END) AS slice
     FROM steps p LEFT JOIN tries y ON y.scan = p.scan AND y.number = p.number + 1 WHERE p.number < {size - 1}) x
   LEFT JOIN sliced k ON k.slice = x.slice AND k.mass >= x.weight + x.lo AND k.mass <= x.weight + x.hi AND k.candidate <> x.own)
 ) WHERE first = 1),
dealt AS (SELECT s.scan, s.peptide, number, s.t, s.len, s.a, s.place, s.many, list_transform({order("len(parts)", "a", "'mix'")}, lambda i: parts[i + 1]) AS mixed,
  1 + CAST(floor({at("a", "'groups'")} * least(many, len(parts))) AS INTEGER) AS n, {order("len(parts) - 1", "a", "'cut'")}[1] + 1 AS cut, {order("2", "a", "'places'")}[1] AS front,
  CAST(floor({at("'swap'")} * (len - 2)) AS INTEGER) AS i
 FROM (SELECT s.scan, s.peptide, p.number, s.t, s.len, p.a, p.place, p.many, p.parts FROM steps p JOIN base s ON s.scan = p.scan WHERE p.number >= 0) s),
made AS (SELECT scan, CASE WHEN len(new) >= 30 THEN peptide ELSE array_to_string(new, '') END AS peptide FROM (SELECT *, CASE
  WHEN a IS NOT NULL THEN list_concat(t[:place], CASE WHEN n = 2 AND front = 1 THEN list_concat(mixed[cut + 1:], mixed[:cut]) ELSE mixed END, t[place + many + 1:])
  WHEN len < 3 THEN t ELSE list_concat(t[:i], [t[i + 2], t[i + 1]], t[i + 3:]) END AS new FROM dealt)
 UNION ALL SELECT scan, peptide FROM base)"""


@query(sql("SELECT scan, peptide, count(*) AS n FROM made GROUP BY scan, peptide", _mutant_sql()))
def mutation_population(spark, d):
    p = psms(spark, d).select(F.col("psm").cast("string").alias("scan"), "peptide", F.lit(1500.0).alias("precursor"))
    return evolve.initial_population(p, R.lookup_table(spark), size=64)


_POPULATION = "population AS (SELECT o_custkey AS scan, CAST(o_orderkey AS VARCHAR) AS peptide, o_orderkey % 7 + 1 AS n, o_totalprice AS score FROM orders)"
_SELECTION = _POPULATION + """, ranked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scan ORDER BY score DESC, peptide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  n * exp((score - max(score) OVER (PARTITION BY scan)) / 10000) AS w FROM population),
spans AS (SELECT *, sum(w) OVER (PARTITION BY scan ORDER BY score DESC, peptide ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY scan) AS high FROM ranked),
spanned AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY scan ORDER BY score DESC, peptide), 0) AS low FROM spans),
draws AS (SELECT scan, ('0x' || md5(scan || '|' || i || '|1')[1:13])::BIGINT::DOUBLE / 4503599627370496 AS u FROM (SELECT DISTINCT scan FROM population), range(1, 46) r(i))"""


@query(sql("""SELECT scan, peptide, 'elite' AS kind, CAST(least(n, greatest(0, 19 - before)) AS BIGINT) AS n FROM ranked WHERE before < 19
 UNION ALL SELECT s.scan, peptide, 'drawn', count(*) FROM spanned s JOIN draws d ON d.scan = s.scan AND u >= low AND u < high GROUP BY s.scan, peptide""", _SELECTION))
def selection(spark, d):
    """The elites of a population and the parents that are drawn, with their numbers."""
    named = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("scan"), named.cast("string").alias("peptide"), (named % 7 + 1).alias("n"), F.col("o_totalprice").alias("score"))
    elites, drawn = evolve.select(rows, size=64, elite=0.3, temperature=10000.0)
    kinds = [x.select("scan", "peptide", F.lit(k).alias("kind"), F.col("n").cast("long").alias("n")) for x, k in ((elites, "elite"), (drawn, "drawn"))]
    return kinds[0].unionByName(kinds[1])


@query()
def evolution_search(spark, d):
    """The whole search over the view's peptides: their own ladders are the graphs, and a peptide scores by how far its mass is from the precursor's."""
    p = psms(spark, d).where(F.size(P.tokens(F.col("peptide"))).between(2, K.MAX_LENGTH))
    initial = p.select(F.col("psm").cast("string").alias("scan"), "peptide", (P.mass(F.col("peptide")) + 0.01).alias("precursor"), F.lit(-1.5).alias("score"))

    def score(wanted):
        away = F.abs(P.mass(F.col("peptide")) - F.col("precursor"))
        return wanted.join(initial.select("scan", "precursor"), "scan").select("scan", "peptide", (-away - 1).alias("score"))

    def bins(drawn):
        target = S.bin_of(P.mass(F.col("peptide")) + 1, most=K.MAX_TARGET)
        own = drawn.select("scan", "peptide").withColumn("bins", S.occupied_bins(P.ladder(F.col("peptide"), F.lit(1)), "y", P.mass(F.col("peptide"))))
        return own.select("scan", "peptide", "bins", F.transform("bins", lambda b: F.lit(1.0)).alias("probs"), target.alias("target"))

    return evolve.run(initial, R.lookup_table(spark), score, bins)


_SPLITS = """cells AS (
    SELECT l_linenumber AS node, feature, bin, -sum(l_extendedprice / 1e5) AS g, count(*)::DOUBLE AS h
    FROM (SELECT l_linenumber, l_extendedprice, unnest([0, 1, 2]) AS feature, unnest([CAST(l_quantity AS INTEGER), CAST(round(l_discount * 100) AS INTEGER), CAST(round(l_tax * 100) AS INTEGER)]) AS bin FROM lineitem)
    GROUP BY ALL),
run AS (SELECT node, feature, bin, sum(g) OVER c AS gl, sum(h) OVER c AS hl, sum(g) OVER p AS g, sum(h) OVER p AS h FROM cells
    WINDOW p AS (PARTITION BY node, feature), c AS (PARTITION BY node, feature ORDER BY bin)),
gains AS (SELECT *, round(0.5 * (gl * gl / hl + (g - gl) * (g - gl) / nullif(h - hl, 0) - g * g / h), 7) AS gain FROM run WHERE h >= 100 AND hl >= 80 AND h - hl >= 80)"""


@query(f"WITH {_SPLITS} SELECT node, feature, bin, round(gain, 4) AS gain, hl, h FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) = 1")
def tree_split(spark, d):
    """The best split of each node of a forest's level, here a line number, over three features in bins."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.round(c).cast("int").alias("bin")) for k, c in enumerate((F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)))))
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("tree"), F.col("l_linenumber").alias("node"), (F.col("l_extendedprice") / 1e5).alias("y"), cells.alias("c"))
    sums = rows.groupBy("tree", "node", "c.feature", "c.bin").agg((-F.sum("y")).alias("g"), F.count("*").cast("double").alias("h"))
    best = trees.best_splits(sums, trees.Growth(least_split=100, least_leaf=80, boosted=False)).where("gain IS NOT NULL")
    return best.select("node", "feature", "bin", F.round("gain", 4).alias("gain"), "hl", "h")


@query()
def scorer_train(spark, d):
    counted = R.counting_features(features.matched_slots(spectra(spark, d), ["psm"], VIEW_PPM), ["psm"])
    names = [c for c in counted.columns if c != "psm"]
    folder = f"{files.scratch(spark, 'scorer')}/rows"  # they are read by several jobs
    counted.withColumn("target", F.ln(F.lit(1.0) + F.col("num_exp"))).write.parquet(folder)
    rows = spark.read.parquet(folder)
    return model.Scorer.train(rows, names, "target", kind="forest").predict(rows).select("psm", "score")


@query()
def binreclass_infer(spark, d):
    """Probabilities of each peptide's bins by a network of random weights; peptides of equal letters and charge are one spectrum, which goes through it once."""
    whole = psms(spark, d).select(F.col("psm").alias("scan"), "peptide", "charge")
    kinds = whole.select("peptide", "charge").distinct()
    p = kinds.withColumns({"l": P.ladder(F.col("peptide"), F.col("charge")), "m": P.mass(F.col("peptide"))})
    mz = F.transform("l", lambda s: s["mz"])
    one = F.transform("l", lambda s: F.lit(1.0))
    rows = p.select("peptide", "charge", S.occupied_bins(F.col("l"), "y", F.col("m")).alias("y_bins"), S.occupied_bins(F.col("l"), "b", F.col("m")).alias("b_bins"), mz.alias("mz"), one.alias("intensities"), mz.alias("mzs"), one.alias("ints"), (F.col("m") / F.col("charge")).alias("precursor_mz"))
    made = ("y_probs", "y_mz", "b_probs", "b_mz", "y_changes", "y_mz_inputs", "b_mz_inputs")
    done = model.reclassify(rows.repartition(spark.sparkContext.defaultParallelism), model.Network.random(channels=4))
    done = done.select(F.col("peptide").alias("_peptide"), F.col("charge").alias("_charge"), *made)
    same = F.col("peptide").eqNullSafe(F.col("_peptide")) & F.col("charge").eqNullSafe(F.col("_charge"))
    # arrays are sized as one of their elements, so that Spark might broadcast them
    return whole.join(done.hint("merge"), same).select("scan", *made)
