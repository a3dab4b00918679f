import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionweave import constants as K
from ionweave.functions import peptide as P
from ionweave.functions import spectrum as S
from ionweave.operators import evolve, features, graph, model, relational
from ionweave.plans import catalog
from ionweave.plans.api import Engine
from ionweave.plans.rescoring import flag
from ionweave.sources import files

MGF = """BEGIN IONS
TITLE=a=b scan=1
PEPMASS=596.262 12.5
CHARGE=2+
SCANS=1
SEQ=YVGDSYDSSAK
SCORE=0.5
147.1128 10.0 
164.0706 20.0 
500.0 5.0 
END IONS

BEGIN IONS
PEPMASS=411.86
CHARGE=3+
SCANS=2
SEQ=[UNIMOD:1]GIFN[UNIMOD:7]K
100.5 1.0 
END IONS
"""


@pytest.fixture(scope="module")
def mgf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("mgf") / "a.mgf"
    path.write_text(MGF)
    return str(path)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "style,raw,want",
    [
        ("mgf", "LM(ox)N[UNIMOD:7]Q[UNIMOD:7]Z", "IM[UNIMOD:35]DEM[UNIMOD:35]"),
        ("mgf", "AC[UNIMOD:4]C", "AC[UNIMOD:4]C[UNIMOD:4]"),
        ("csv", " C(Cam)OxM ", "C[UNIMOD:4]M[UNIMOD:35]"),
        ("search", "A C L", "AC[UNIMOD:4]I"),
    ],
)
def test_normalize(spark, style, raw, want):
    assert one(spark, P.normalize(F.lit(raw), style).alias("x")).x == want


def test_codes_and_spelling(spark):
    r = one(spark, P.codes(F.lit("AC[UNIMOD:4]M[UNIMOD:35]K")).alias("c"), P.codes(F.lit("AXB")).alias("bad"), P.codes(F.lit("AC")).alias("bare"))
    assert r.c == [1, 2, 21, 9] and r.bad is None and r.bare is None
    assert one(spark, P.spell(F.array(*map(F.lit, [1, 2, 0, 21]))).alias("x")).x == "AC[UNIMOD:4]M[UNIMOD:35]"


@pytest.mark.parametrize("peptide,mass", [("YVGDSYDSSAK", 1190.509148), ("GFVIDDGIITK", 1176.639041)])
def test_mass_and_ladder(spark, peptide, mass):
    r = one(spark, P.mass(F.lit(peptide)).alias("m"), P.ladder(F.lit(peptide), F.lit(2)).alias("l"))
    assert r.m == pytest.approx(mass, abs=1e-6)
    mz = {s.slot: s.mz for s in r.l}
    assert len(mz) == 40 and mz[0] == pytest.approx(147.11280, abs=1e-5)
    assert mz[3] == pytest.approx({"Y": 164.07061, "G": 58.02874}[peptide[0]], abs=1e-5)
    tokens = list(peptide)
    for i in range(1, len(tokens)):
        b = sum(K.RESIDUES[t] for t in tokens[:i])
        y = sum(K.RESIDUES[t] for t in tokens[-i:]) + K.WATER
        assert mz[6 * (i - 1) + 4] == pytest.approx(b / 2 + K.PROTON, abs=1e-9)
        assert mz[6 * (i - 1)] == pytest.approx(y + K.PROTON, abs=1e-9)


def test_ladder_of_short_peptides(spark):
    for text in ("", "K"):
        assert one(spark, P.ladder(F.lit(text), F.lit(3)).alias("l")).l == []


def test_mgf_and_validity(spark, mgf):
    from ionweave.plans.rescoring import flag

    rows = {r.scan: r for r in flag(files.read_mgf(spark, mgf)).collect()}
    assert rows["1"].mzs == [147.1128, 164.0706, 500.0] and rows["1"].charge == 2 and rows["1"].original_score == 0.5
    assert rows["1"].is_valid and not rows["2"].is_valid and rows["2"].original_score is None


def test_float_list(spark):
    r = one(spark, P.float_list(F.lit("[1.0, 2.5]")).alias("a"), P.float_list(F.lit("[]")).alias("b"))
    assert r.a == [1.0, 2.5] and r.b == []


def brute_match(tmz, emz, eint, ppm=20.0):
    out = []
    for t in tmz:
        best = min(((abs(t - m), i) for i, m in enumerate(emz)), default=None)
        out.append(eint[best[1]] if best and t > 0 and 1e6 * best[0] <= ppm * t else 0.0)
    return out


def test_match_forms_agree(spark):
    rng = np.random.default_rng(1)
    tmz = np.concatenate([rng.uniform(100, 900, 30), [500.0, 500.0]])
    emz = np.concatenate([tmz[:10] * (1 + 1e-5 * rng.uniform(-3, 3, 10)), [499.995, 500.005, 500.005], rng.uniform(100, 900, 20)])
    eint = np.arange(1.0, len(emz) + 1)
    want = brute_match(tmz, emz, eint)
    assert features.match(tmz, emz, eint)[1].tolist() == want
    slots = spark.createDataFrame([(1, i, float(t), 1.0) for i, t in enumerate(tmz)], "scan int, slot int, tmz double, tint double")
    peaks = spark.createDataFrame([(1, i, float(m), float(x)) for i, (m, x) in enumerate(zip(emz, eint))], "scan int, pos int, mz double, intensity double")
    got = {r.slot: r.eint for r in relational.nearest_peaks(slots, peaks, []).collect()}
    assert [got[i] for i in range(len(tmz))] == want


def test_feature_vector(spark, mgf):
    engine = Engine(spark)
    made = engine.features(engine.prepared(files.read_mgf(spark, mgf), "mgf")).collect()
    assert len(made) == 1 and len(K.FEATURES) == 114
    r = made[0].asDict()
    assert r["num_exp"] == 2 and r["num_exp_b"] == 1 and r["rel_exp"] == pytest.approx(2 / 40)
    assert 0 <= r["sa_all"] <= 1 and all(np.isfinite(r[f]) for f in K.FEATURES)


def test_features_of_many_rows_are_those_of_each():
    """Ladders and spectra of any length, ties, missing arrays and intensities."""
    rng, rows = np.random.default_rng(2), []
    for i in range(200):
        n = int(rng.integers(0, 30)) * 6
        mz = np.full(K.SLOTS, -1.0)
        mz[:n] = np.round(rng.uniform(50, 900, n) / 50) * 50 if i % 7 == 0 else rng.uniform(50, 900, n)
        predicted = np.where(mz > 0, rng.integers(0, 13, K.SLOTS) / 13, -1.0)
        peaks = np.round(rng.uniform(50, 900, int(rng.integers(0, 100))), 0 if i % 3 else 3)
        ints = rng.integers(0, 100, len(peaks)).astype(float)
        ints[: i % 50 == 1] = np.nan
        rows.append([None if missing else x.tolist() for x, missing in ((mz, i % 31 == 0), (predicted, i % 31 == 0), (peaks, i % 29 == 0), (ints, i % 29 == 0), (predicted[mz > 0], i % 3 == 0))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.float64())) for c in zip(*rows)], ["mz", "intensities", "mzs", "ints", "y_changes"])
    none = [-1.0] * K.SLOTS
    want = [features.vector(mz or none, own or none, peaks or [], ints or [], changes, ppm=20000.0) for mz, own, peaks, ints, changes in rows]
    np.testing.assert_allclose(features.vectors(batch, ppm=20000.0), want, rtol=1e-9, atol=1e-9)


def test_no_peaks_and_constant_values():
    zero = features.vector(np.full(K.SLOTS, -1.0), np.full(K.SLOTS, -1.0), [], [], None)
    assert len(zero) == 114 and np.isfinite(zero).all()
    flat = features.similarity(np.ones(K.SLOTS), np.ones(K.SLOTS))
    assert np.isfinite(flat).all() and flat[0] == pytest.approx(1.0, abs=1e-6)


def test_bins(spark):
    peaks = spark.createDataFrame([(1, float(m), 1.0) for m in (0.5, 1.0, 1.5, 1999.9, 2000.0, 2500.0)], "scan int, mz double, intensity double")
    assert {r.bin: r.intensity for r in relational.histogram(peaks).collect()} == {0: 1.0, 1: 2.0, 1999: 1.0}
    assert {r.bin for r in relational.histogram(peaks, drop_last=False).collect()} == {0, 1, 1999}
    assert one(spark, S.bin_of(F.lit(3000.0)).alias("b")).b == 2001


def test_graph_path_and_fallback():
    steps = list(K.residue_bins())
    bins = np.array([19, 19 + 57, 19 + 57 + 71, 400])
    kept, edges = graph.transitions(bins[:3], np.ones(3), steps)
    path, score = graph.best_path(kept, edges)
    assert path == [19, 76, 147] and score == pytest.approx(1.5) and graph.spell(path) == "AG"
    assert list(graph.transitions(bins, np.ones(4), steps)[0]) == [400]
    assert all(w in ([19, 147], path) for w in graph.random_walks(kept, edges, 9, lambda walk, step: graph.drawn(walk, step)))
    assert K.residue_bins()[128] == ["K", "Q"] and K.residue_bins()[147] == ["F", "M[UNIMOD:35]"]


def test_walks_end_where_no_edge_weighs(spark):
    """Three steps of W, of which the second has no weight in the second scan."""
    made = [("a", b, 0.5) for b in (19, 205, 391, 577)] + [("b", b, 0.0) for b in (19, 205, 391, 577)]
    nodes = spark.createDataFrame(made, "scan string, bin int, p double")
    got = graph.walks(nodes, list(K.residue_bins()), paths=3, source=None).collect()
    assert sorted((r.scan, r.path, r.peptide) for r in got) == [("a", k, "WWW") for k in range(3)]


def test_longest_path_of_equals_is_the_first_peptide(spark):
    """G and then Y weighs as much as Y and then G; a path without a weight is above all, as in SQL."""
    made = [("a", b, 0.5) for b in (19, 76, 182, 239)] + [("b", b, 0.0) for b in (19, 205, 391, 577)]
    nodes = spark.createDataFrame(made, "scan string, bin int, p double")
    got = {r.scan: r for r in graph.longest_paths(nodes, list(K.residue_bins()), source=None).collect()}
    assert got["a"].peptide == "GY" and got["a"].score == pytest.approx(1.5)
    assert got["b"].peptide == "WWW" and np.isnan(got["b"].score)


def test_mutants_keep_the_mass(spark):
    lookup = relational.lookup_table(spark).collect()
    m = evolve.Mutator([r.candidate for r in lookup], [r.mass for r in lookup])
    peptide = "GFVIDDGIITK"
    total = lambda p: sum(K.RESIDUES[t] for t in evolve.TOKEN.findall(p))
    budget = 1176.6 * 20e-6
    for k in range(50):
        new, left = m.mutate(peptide, (-budget, budget), graph.Draws(k))
        assert abs(total(new) - total(peptide)) <= budget + 1e-9 and new[-1] == "K"
        assert left[1] - left[0] == pytest.approx(2 * budget) and left[0] == pytest.approx(-budget - (total(new) - total(peptide)), abs=1e-9)
        # handed on, the budget bounds what all mutants together have added
        many = m.mutants(peptide, 1176.6, 30, k)
        assert abs(sum(total(x) - total(peptide) for x in many)) <= budget + 1e-9
    assert {tuple(map(tuple, m.deal(list("AB"), 2, graph.Draws(k)))) for k in range(60)} == {
        (("A",), ("B",)), (("B",), ("A",)), (("A", "B"), ()), (("B", "A"), ()), ((), ("A", "B")), ((), ("B", "A")),
    }
    for k in range(40):  # nothing outside the two places is replaced
        new, _ = m.substitute(evolve.TOKEN.findall(peptide), (-0.05, 0.05), graph.Draws(k), 2, 5)
        assert "".join(new).startswith("GF") and "".join(new).endswith("GIITK") or sorted("".join(new)) == sorted(peptide)
    whole = evolve.Mutator(["A"], [71.0], permute=1.0, everything=True)
    assert len({whole.mutate("ACDEK".replace("C", "C[UNIMOD:4]"), (0, 0), graph.Draws(k))[0] for k in range(40)}) > 20


def test_draws_are_those_of_their_text():
    """A draw is an MD5 of the key and the purpose, joined; what has one outcome is not hashed."""
    draws = graph.Draws("7", None, "ACK")
    assert draws.at(2, "mix", 0) == draws.of(b"2|mix|0") == graph.drawn("7", None, "ACK", 2, "mix", 0)
    assert draws.under(5).of(b"kind") == graph.Draws("7", None, "ACK", 5).at("kind") == graph.drawn("7", None, "ACK", 5, "kind")
    assert draws.order(4, 1, "cut") == sorted(range(4), key=lambda i: graph.drawn("7", None, "ACK", 1, "cut", i))
    edges = [{1: 0.25, 2: 0.75}, {2: 1.0}, {}]
    want = lambda k: [19, 76, 133] if graph.drawn("s", k, 0, "walk") < 0.25 else [19, 133]
    assert graph.spelled_walks(np.array([19, 76, 133]), edges, 20, "s") == ([want(k) for k in range(20)], ["GG" if len(want(k)) == 3 else "N" for k in range(20)])


def test_lookup_table(spark):
    """All multisets of residues up to the weight of the two heaviest, by brute force."""
    from itertools import combinations_with_replacement

    names = [r for r in K.RESIDUES if r != "L"]
    most = 2 * max(K.RESIDUES.values()) + 0.1
    want = {"".join(c) for n in range(1, 7) for c in combinations_with_replacement(names, n) if sum(K.RESIDUES[r] for r in c) <= most}
    got = {r.candidate: r.mass for r in relational.lookup_table(spark).collect()}
    assert set(got) == want and got["AG"] == pytest.approx(K.RESIDUES["A"] + K.RESIDUES["G"])


def test_population_and_selection(spark):
    rows = spark.createDataFrame([("a", "GFVIDDGIITK", 1176.6), ("b", "YVGDSYDSSAK", 1190.5)], "scan string, peptide string, precursor double")
    lookup = relational.lookup_table(spark, 2)
    found = sorted(map(tuple, evolve.initial_population(rows, lookup).collect()))
    assert {s: sum(n for x, _, n in found if x == s) for s in "ab"} == {"a": 65, "b": 65}
    assert found == sorted(map(tuple, evolve.initial_population(rows.repartition(7), lookup).collect()))
    population = evolve.initial_population(rows, lookup).withColumn("score", -F.length("peptide") * 1.0)
    elites, drawn = evolve.select(population)
    sums = lambda df: {r.scan: r.n for r in df.groupBy("scan").agg(F.sum("n").alias("n")).collect()}
    assert sums(elites) == {"a": 19, "b": 19}
    assert sums(drawn) == {"a": 45, "b": 45}


def test_search_without_candidates_returns_the_start(spark):
    rows = spark.createDataFrame([("a", "GFVIDDGIITK", 1176.6, -5.0)], "scan string, peptide string, precursor double, score double")
    got = evolve.run(rows, relational.lookup_table(spark, 1), None, None)
    assert [tuple(r) for r in got.collect()] == [("a", "GFVIDDGIITK", -5.0)]


def slow_layer(w, name, x, widths):
    """A gapped layer place by place: x is a list of channels."""
    n = x.shape[1]
    out = np.zeros((len(w[f"{name}.{widths[0]}.w"]), n))
    for g in widths:
        rows = n // g + 1
        at = lambda c, i, j: x[c, i * g + j] if 0 <= i < rows and 0 <= j < g and i * g + j < n else 0.0
        for o in range(len(out)):
            for p in range(n):
                i, j = divmod(p, g)
                out[o, p] += w[f"{name}.{g}.b"][o]
                for c in range(len(x)):
                    for a in range(3):
                        for b in range(3):
                            out[o, p] += w[f"{name}.{g}.w"][o, c, a, b] * at(c, i + a - 1, j + b - 1)
    return out


def small_network(seed=0, channels=4):
    rng = np.random.default_rng(seed)
    net = model.Network.random(channels=channels, width=3, convs=1, seed=seed)
    some = net.widths[:2]
    w = {k: rng.normal(0, 0.3, v.shape) for k, v in net.weights.items() if "." not in k[3:] or k.split(".")[1] in ("scale", "shift", *map(str, some)) or k.startswith("mix")}
    return model.Network(w, some, 1)


def test_network_against_loops(tmp_path):
    net = small_network()
    x = np.random.default_rng(1).normal(size=(2, 4, 90))
    got = net.forward(x)
    for one, want in zip(x, got):
        h = np.maximum(slow_layer(net.weights, "start", one, net.widths), 0) * net.weights["start.scale"][:, None] + net.weights["start.shift"][:, None]
        h = h + np.maximum(slow_layer(net.weights, "mid0", h, net.widths), 0) * net.weights["mid0.scale"][:, None] + net.weights["mid0.shift"][:, None]
        end = slow_layer(net.weights, "end", h, net.widths)  # no ReLU
        for k, (inner, outer) in enumerate(((one[2], end[0]), (one[3], end[1]))):
            two = [net.weights["mix1.w"][k, o, 0] * inner + net.weights["mix1.w"][k, o, 1] * outer + net.weights["mix1.b"][2 * k + o] for o in (0, 1)]
            assert np.allclose(want[k], net.weights["mix2.w"][k] @ np.array(two) + net.weights["mix2.b"][k])
    net.save(tmp_path / "n.npz")
    assert np.allclose(model.Network.load(str(tmp_path / "n.npz")).forward(x), got)


@pytest.mark.parametrize("n", [60, 400, 2000])
def test_prepared_network(n):
    """The network by spectra, for many, against the one that folds the axis for each width."""
    net = model.Network.random(channels=4, width=3, convs=2, seed=5)
    rng = np.random.default_rng(6)
    net.weights.update({k: rng.normal(size=v.shape).astype(np.float32) for k, v in net.weights.items() if k.endswith((".b", "shift"))})
    x = rng.random((3, 4, n)).astype(np.float32)
    want = net.forward(x)
    assert np.abs(model.Prepared(net, n).forward(x) - want).max() < 1e-4 * np.abs(want).max()


def test_equal_peptides_are_reclassified_once(spark, tmp_path):
    rows = [(k, name, "TIN", size) for k, (name, size) in enumerate([("green ring", 1), ("green ring", 4), ("hot bolt", 1), (None, 2), ("green ring", 2), (None, 2)])]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    made = catalog.binreclass_infer(spark, str(tmp_path))
    got = {r.scan: r for r in made.collect()}
    assert sorted(got) == list(range(6)) and got[0][1:] == got[1][1:] != got[4][1:] and got[3].y_probs is None and len(got[0].y_mz_inputs) > 5
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("MapInArrow") and "HashAggregate" in plan[plan.index("MapInArrow") :]


def test_gradients():
    net, rng = small_network(3), np.random.default_rng(2)
    x, y, weight = rng.normal(size=(2, 4, 60)), (rng.random((2, 2, 60)) < 0.2).astype(float), np.array([[[3.0], [2.0]]])
    loss, found = net.gradients(x, y, weight)
    assert loss == pytest.approx(model.focal(net.forward(x), y, weight)[0]) and set(found) == set(net.weights)
    for name, w in net.weights.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 4)]:
            both = []
            for step in (1e-5, -1e-5):
                w[at] += step
                both.append(model.focal(net.forward(x), y, weight)[0])
                w[at] -= step
            assert np.reshape(found[name], w.shape)[at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-3, abs=1e-4), name


def test_channels():
    """Hand-made rows: occupied bins, predicted as they are, measured without the precursor and relative to the highest."""
    x = model.channels([19, 147], [1], [147.1, -1.0, 200.9, 900.0], [0.5, -1.0, 0.25, 0.1], [0.5, 100.2, 100.7, 300.0, 450.0, 1500.0], [5.0, 10.0, 10.0, 99.0, 20.0, 1.0], 300.0)
    assert x.shape == (4, K.MAX_BIN)
    assert np.flatnonzero(x[0]).tolist() == [19, 147] and np.flatnonzero(x[1]).tolist() == [1]
    assert {int(i): float(x[2][i]) for i in np.flatnonzero(x[2])} == {147: 0.5, 200: 0.25}  # the highest occupied bin, 900, is left out
    assert {int(i): pytest.approx(float(x[3][i])) for i in np.flatnonzero(x[3])} == {0: 0.25, 100: 1.0, 450: 1.0}
    more = model.channels([19, 147], [1], [147.1, 900.0], [0.49, 0.1], [147.5, 990.0], [1.0, 1.0], 300.0, transform="sqrt", precursor_range=True, differences=True)
    assert len(more) == 7 and more[2].sum() == 147 and more[5][147] == pytest.approx(0.7) and more[3][147] == pytest.approx(0.3)
    assert more[4][147] == pytest.approx(0.3 / (0.85 + 1e-5))
    assert model.channels([], [], None, None, [], [], 300.0).sum() == 0
    assert model.scaled_log(np.array([0.0, 1.0])).tolist() == [0.0, 1.0]


def spectra(spark, rows):
    """PSMs of ``(scan, peptide)`` with their own ladders as peaks."""
    made = spark.createDataFrame([(s, p, 2) for s, p in rows], "scan string, peptide string, charge int").withColumn("l", P.ladder(F.col("peptide"), F.col("charge")))
    mzs = F.transform("l", lambda s: s["mz"])
    return made.select("scan", "charge", (P.mass(F.col("peptide")) / 2 + K.PROTON).alias("precursor_mz"), "peptide", F.lit(None).cast("double").alias("original_score"), mzs.alias("mzs"), F.transform(mzs, lambda m: F.lit(1.0)).alias("ints"))


class LengthScorer:
    """A stand-in for a trained scorer."""

    def predict(self, rows):
        return rows.withColumn("score", -F.col("num_exp") / 100)


def test_rescoring_keeps_every_row(spark):
    """Repeated and null scans are rows like others; what is not valid has -Infinity."""
    rows = spectra(spark, [("1", "GFVIDDGIITK"), ("1", "GFVIDDGIITK"), ("1", "YVGDSYDSSAK"), (None, "AGAGAGK"), ("2", "A" * 31), ("3", "AXB")])
    for network in (None, model.Network.random(width=2, convs=1)):
        got = Engine(spark, network=network, scorer=LengthScorer()).rescoring(rows).collect()
        assert [x.name for x in rows.schema] + ["score"] == list(got[0].asDict())
        scores = sorted((r.scan or "", r.peptide[:2], r.score) for r in got)
        assert [s[:2] for s in scores] == [("", "AG"), ("1", "GF"), ("1", "GF"), ("1", "YV"), ("2", "AA"), ("3", "AX")]
        assert scores[1] == scores[2] and [s[2] == float("-inf") for s in scores] == [False] * 4 + [True] * 2


def test_predictions_by_table(spark):
    rows = spark.createDataFrame([("AGK", 2, 0.29), ("AGK", 3, 30.0), ("K", 2, 29.0)], "peptide string, charge int, ce double")
    table = spark.createDataFrame([("AGK", 2, 29.0, [1.0], [5e-5]), ("AGK", 2, 30.0, [2.0], [1.0]), ("AGK", 2, 29.0, [1.0], [5e-5])], "peptide string, charge int, ce double, mz array<double>, intensities array<double>")
    got = sorted((r.peptide, r.charge, r.mz, r.intensities) for r in files.table_predictions(table)(rows).collect())
    assert got == [("AGK", 2, [1.0], [0.0]), ("AGK", 3, None, None), ("K", 2, None, None)]
    assert files.table_predictions(table, energy=0.3)(rows.drop("ce")).where("mz[0] = 2.0").count() == 1


def test_csv_keeps_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,seq,z,m,i,p,note,true\nx,GFVIDDGIITK,2,"[147.1, 200.5]","[1.0, 2.0]",589.3,keep me,GFVIDDGIITK\nx,,2,"[]","[]",1.0,empty,\n')
    names = {"peptide": "seq", "charge": "z", "mzs": "m", "ints": "i", "precursor_mz": "p", "scan": "id"}
    done = Engine(spark, scorer=LengthScorer()).rescoring_from_csv(str(tmp_path / "a.csv"), str(tmp_path / "out"), **names)
    assert done.columns == ["id", "seq", "z", "m", "i", "p", "note", "true", "score"] and done.count() == 2
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r.note, r.score == "-Infinity") for r in back} == {("keep me", False), ("empty", True)} and "index" in back[0].asDict()
    read = files.read_csv(spark, str(tmp_path / "a.csv"), truth="true", **names)
    assert {r.peptide_true for r in read.collect()} == {"GFVIDDGIITK", None}
    (tmp_path / "l.csv").write_text("GAC,231.1\nM(ox),147.0\nXX,1.0\n")
    assert [tuple(r) for r in files.read_lookup(spark, str(tmp_path / "l.csv")).collect()] == [("M[UNIMOD:35]", 147.0), ("AC[UNIMOD:4]G", 231.1)]
    with pytest.raises(ValueError):
        (tmp_path / "none.csv").write_text("id,seq,z,m,i,p\n")
        Engine(spark, scorer=LengthScorer()).rescoring_from_csv(str(tmp_path / "none.csv"), **names)


def test_search(spark, tmp_path):
    """Two generations: 65 rows a scan in each, nothing is scored twice, the best comes back with what it was."""
    rows = spectra(spark, [("a", "GFVIDDGIITK"), ("b", "YVGDSYDSSAK"), ("c", "AGK")])
    initial = rows.select("scan", "peptide", P.mass(F.col("peptide")).alias("precursor"), F.when(F.col("scan") == "c", -9.0).otherwise(-1.5).alias("score"))
    asked, sizes, children = [], [], []

    def score(wanted):
        asked.extend((r.scan, r.peptide) for r in wanted.collect())
        return wanted.withColumn("score", F.when(F.col("peptide").startswith("GF"), -0.5).otherwise(-3.0))

    def bins(drawn):
        own = drawn.select("scan", "peptide").withColumn("bins", S.occupied_bins(P.ladder(F.col("peptide"), F.lit(1)), "y", P.mass(F.col("peptide"))))
        return own.select("scan", "peptide", "bins", F.transform("bins", lambda b: F.lit(1.0)).alias("probs"), S.bin_of(P.mass(F.col("peptide")) + 1, most=K.MAX_TARGET).alias("target"))

    def snapshot(scored, generation):
        sizes.append({r.scan: r.n for r in scored.groupBy("scan").agg(F.sum("n").alias("n")).collect()})

    got = evolve.run(initial, relational.lookup_table(spark), score, bins, generations=3, snapshot=snapshot, lineage=lambda c, g: children.append(c.agg(F.sum("n")).first()[0]))
    found = {r.scan: (r.peptide, r.score) for r in got.collect()}
    assert sizes == [{"a": 65, "b": 65}] * 3 and len(asked) == len(set(asked)) and children == [90, 90]
    assert found["a"][0].startswith("GF") and found["a"][1] == -0.5 and found["b"][1] == -3.0 and found["c"] == ("AGK", -9.0)


def test_search_of_the_engine(spark, tmp_path):
    from ionweave.plans.api import Settings

    engine = Engine(spark, model.Network.random(width=2, convs=1), LengthScorer(), settings=Settings(population=6, least_score=-9.0, most_score=0.0))
    rows = spectra(spark, [("a", "GFVIDDGIITK"), ("a", "YVGDSYDSSAK"), ("b", "AGAGK"), (None, "AGK")])
    got = engine.search(rows, relational.lookup_table(spark), snapshots=str(tmp_path / "s"), lineage=str(tmp_path / "l")).collect()
    assert sorted((r.scan, r.peptide_init) for r in got) == [("a", "GFVIDDGIITK"), ("b", "AGAGK")] and all(r.score >= r.score_init for r in got)
    assert spark.read.parquet(str(tmp_path / "s/best")).count() == 4 and spark.read.parquet(str(tmp_path / "l")).count() > 0


def test_training(spark, tmp_path):
    engine = Engine(spark)
    names = ["GFVIDDGIITK", "YVGDSYDSSAK", "AGAGAGK", "MFPEK"]
    rows = spectra(spark, [(str(i), p) for i, p in enumerate(names)]).withColumn("peptide_true", F.reverse("peptide"))
    start = model.Network.random(width=2, convs=1)
    truth = engine.with_truth(rows).checkpoint()
    before = truth.count(), model.class_weights(truth)
    net = engine.train_bin_reclassifier(rows, rows, network=start, epochs=3, steps=2, rate=3e-3, save=str(tmp_path / "best.npz"))
    assert before[0] == 4 and before[1]["y"] > 50 and (tmp_path / "best.npz").exists()
    dense = [model.reclassify_with_truth(truth, n).collect() for n in (start, net)]

    def loss(found):
        return sum(model.focal(np.log(np.array(r[f"{i}_outputs"]) / (1 - np.array(r[f"{i}_outputs"]))), np.array(r[f"{i}_targets"]), before[1][i])[0] for r in found for i in "yb")

    assert loss(dense[1]) < loss(dense[0])
    r = dense[1][0]
    assert r.y_changed == [float(a != b) for a, b in zip(r.y_inputs, r.y_targets)] and sum(r.b_targets) > 0
    lines = ["seq,z,m,i,p,d"] + [f'{p},2,"[147.1, {200 + i}.5]","[1.0, 2.0]",589.3,{i % 5}' for i, p in enumerate(names * 30)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    columns = {"peptide": "seq", "charge": "z", "mzs": "m", "ints": "i", "precursor_mz": "p"}
    table = engine.feature_table(str(tmp_path / "t.csv"), "d", str(tmp_path / "f"), **columns)
    assert table.columns == [*K.FEATURES, "target"] and table.count() == 120
    assert engine.feature_table("not read again", "d", str(tmp_path / "f"), **columns).count() == 120
    engine.scorer = model.Scorer.train(table, K.FEATURES, "target", kind="boosted", count=2, depth=2)
    assert 0 <= engine.evaluate_scorer(table).first().mse < 5


def test_sql_functions(spark):
    from ionweave.functions.register import register

    register(spark)
    assert spark.sql("SELECT peptide_mass('GFVIDDGIITK') AS m").first().m == pytest.approx(1176.639041, abs=1e-6)
    assert spark.sql("SELECT * FROM fragments('AGK', 2)").count() == 8


def test_queries_have_oracles_of_the_same_names():
    from ionweave.plans import catalog

    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 35


def test_stream(spark, mgf, tmp_path):
    from ionweave.streaming.mgf import stream_mgf

    found = stream_mgf(spark, str(mgf).rsplit("/", 1)[0])
    query = found.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.scan, r.is_valid) for r in spark.table("arrived").collect()} == {("1", True), ("2", False)}


def test_settings(tmp_path):
    from ionweave import cli
    from ionweave.plans.api import Settings

    (tmp_path / "c.yaml").write_text("# settings\npopulation: 32  # rows\ntransform: sqrt\nunknown: 1\nleast_score: -3.5\n")
    made = Settings.of(cli.read_config(str(tmp_path / "c.yaml")))
    assert (made.population, made.transform, made.least_score, made.generations) == (32, "sqrt", -3.5, 2)
    (tmp_path / "c.json").write_text('{"elite": 0.5}')
    assert Settings.of(cli.read_config(str(tmp_path / "c.json"))).elite == 0.5


def test_matched_slots(spark):
    """The Arrow pass gives what the joins give, for odd peptides and spectra too."""
    rows = [(1, "GFVIDDGIITK", 3, [147.1128, 165.0], [1.0, 2.0]), (2, "K", 2, [100.0], [1.0]), (3, "", 2, [], []), (4, None, 2, None, None), (5, "AG", None, [1.0], [1.0]), (6, "A" * 40, 2, [72.0], [1.0]), (7, "M[UNIMOD:35]C[UNIMOD:4]K", 1, [], [])]
    psms = spark.createDataFrame(rows, "scan int, peptide string, charge int, mzs array<double>, ints array<double>").withColumn("tints", F.array_repeat(F.lit(1.0), K.SLOTS))
    slots = P.ladder_rows(psms, ["scan"]).select("scan", "slot", F.col("mz").alias("tmz"), F.lit(1.0).alias("tint"))
    peaks = psms.select("scan", F.posexplode(F.arrays_zip("mzs", "ints")).alias("pos", "p")).select("scan", "pos", F.col("p.mzs").alias("mz"), F.col("p.ints").alias("intensity"))
    want = sorted((r.scan, r.slot, round(r.tmz, 6), r.tint, r.emz, r.eint) for r in relational.nearest_peaks(slots, peaks, [], 5000.0).collect())
    got = sorted((r.scan, r.slot, round(r.tmz, 6), r.tint, r.emz, r.eint) for r in features.matched_slots(psms, ["scan"], 5000.0).collect())
    assert got == want and len({r[0] for r in got}) == 3 and any(r[5] for r in got)


def test_band_join_of_a_large_scan(spark):
    """50,000 peaks and 6,000 slots in one scan: only pairs in reach of each other meet, and each slot gets its nearest."""
    rng = np.random.default_rng(1)
    mz, ints = np.round(rng.uniform(100, 2000, 50_000), 3), rng.random(50_000)
    tmz = np.concatenate([np.round(rng.uniform(90, 2100, 5_994), 3), mz[:3], [0.0, -1.0, np.nan]])
    peaks = spark.createDataFrame([(7, k, float(m), float(i)) for k, (m, i) in enumerate(zip(mz, ints))] + [(8, 0, 500.0, 1.0), (7, 50_001, 0.0, 1.0), (7, 50_002, None, 1.0), (None, 1, 500.0, 1.0)], "scan int, pos int, mz double, intensity double").repartition(8)
    slots = spark.createDataFrame([(7, k, float(t), 1.0) for k, t in enumerate(tmz)] + [(None, 1, 500.0, 1.0), (8, 2, 500.0, 0.5), (8, 2, 500.0, 0.5)], "scan int, slot int, tmz double, tint double").repartition(8)
    met = relational.band_join(slots, peaks, 50.0)
    assert met.count() < 40 * len(tmz)
    asked, held = relational.log_slices(slots, peaks, 50.0)
    assert asked.groupBy("scan", "slot").count().agg(F.max("count")).first()[0] <= 4 and held.count() == 50_002  # slot 2 of scan 8 is there twice
    got = {(r.scan, r.slot): (r.emz, r.eint) for r in relational.nearest_peaks(slots, peaks, [], 50.0).collect()}
    want_mz, want_int = features.match(tmz, mz, ints, 50.0)
    assert all(got[7, k] == (want_mz[k], want_int[k]) for k in range(len(tmz))) and (want_mz > 0).sum() > 4_000
    assert got[None, 1] == (0.0, 0.0) and got[8, 2] == (500.0, 1.0)
    assert relational.nearest_peaks(slots, peaks, [], 50.0).where("scan = 8").count() == 2
    with pytest.raises(ValueError):
        relational.nearest_peaks(slots, peaks, [], 1e6)


def test_scores_that_are_null(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (1, "c", 2.0), (1, "d", 2.0), (2, "e", None), (2, "f", None), (None, "g", -1.0)], "scan int, peptide string, score double")
    got = sorted((r.scan or 0, r.peptide, r.score) for r in relational.best_by(rows, "scan", "score", "peptide").collect())
    assert got == [(0, "g", -1.0), (1, "c", 2.0), (2, "e", None)]


def test_malformed_spectra(spark, tmp_path):
    """A number that is none makes its spectrum not valid; the others are read."""
    good = "BEGIN IONS\nSCANS=1\nPEPMASS=589.3\nCHARGE=2+\nSEQ=GFVIDDGIITK\n147.1 5.0\nEND IONS\n"
    (tmp_path / "x.mgf").write_text(good + good.replace("SCANS=1", "SCANS=2").replace("147.1 5.0", "1.2.3 7\n200 1,5") + good.replace("SCANS=1", "SCANS=3"))
    read = files.read_mgf(spark, str(tmp_path / "x.mgf"))
    assert {r.scan: r.is_valid for r in flag(read).collect()} == {"1": True, "2": False, "3": True}
    df = spark.createDataFrame([("[1.0, x]",), ("[]",), (None,), ("[1.5,2]",)], "s string")
    assert [r.v for r in df.select(P.float_list(F.col("s")).alias("v")).collect()] == [[1.0, None], [], None, [1.5, 2.0]]


def test_unknown_residues_have_no_slots(spark):
    from ionweave.functions.register import register

    register(spark)
    assert spark.sql("SELECT * FROM fragments('PEBTIDE', 2)").count() == 0 == spark.sql("SELECT * FROM fragments(NULL, 2)").count()
    rows = spark.createDataFrame([("PEBTIDE", 2), ("AGK", 1)], "peptide string, charge int")
    assert P.ladder_rows(rows, ["peptide"]).count() == 4 and len(features.slots_of("PEBTIDE", 2)[0]) == 0
    want = sorted((r.slot, round(r.mz, 6)) for r in P.ladder_rows(rows, ["peptide"]).collect())
    assert sorted((r.slot, round(r.mz, 6)) for r in spark.sql("SELECT * FROM fragments('AGK', 1)").collect()) == want


def test_scans_of_any_kind(spark):
    nodes = spark.createDataFrame([(s, b, 0.5) for s in ("F1:7", None) for b in (19, 76, 147, 300)], "scan string, bin int, p double")
    steps = list(K.residue_bins())
    paths = graph.longest_paths(nodes, steps).collect()
    assert {r.scan for r in paths} == {"F1:7", None} and len({r.peptide for r in paths}) == 1
    assert {r.scan for r in graph.walks(nodes, steps).collect()} <= {"F1:7", None}


def test_names_that_clash(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,seq,z,m,i,p,Score,index\nx,GFVIDDGIITK,2,"[147.1]","[1.0]",589.3,9,8\n')
    names = {"peptide": "seq", "charge": "z", "mzs": "m", "ints": "i", "precursor_mz": "p", "scan": "id"}
    done = Engine(spark, scorer=LengthScorer()).rescoring_from_csv(str(tmp_path / "a.csv"), str(tmp_path / "out"), **names)
    assert done.columns[-2:] == ["index", "new_score"]
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["new_index", "id", "seq", "z", "m", "i", "p", "Score", "index", "new_score"] and back.first()["index"] == "8"


def normalised_loss(state, x, y, weight, mask):
    """The loss of a whole batch at once, layer by layer."""
    net = model.Network(state.weights, state.widths, state.layers)

    def layer(name, k, h):
        a = np.maximum(net._sums(name, h) * mask(k), 0)
        unit = (a - a.mean(axis=(0, 2))[:, None]) / np.sqrt(a.var(axis=(0, 2)) + 1e-5)[:, None]
        return unit * state.weights[f"{name}.scale"][:, None] + state.weights[f"{name}.shift"][:, None]

    h = layer("start", 0, x)
    for k in range(state.layers):
        h = h + layer(f"mid{k}", k + 1, h)
    return model.focal(net._mixed(x, net._sums("end", h))[2], y, weight)[0]


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_normalised_gradients(spark, dropout):
    """Any number of partitions gives the gradients of the whole batch, which are those of small steps."""
    from ionweave.operators import normalised

    rng, weight = np.random.default_rng(2), np.array([[[3.0], [2.0]]])
    x, y = rng.normal(size=(5, 4, 60)), (rng.random((5, 2, 60)) < 0.2).astype(float)
    state = normalised.State.of(small_network(3))
    rows = spark.createDataFrame([(k, x[k].ravel().tolist(), y[k].ravel().tolist()) for k in range(5)], "row long, vx array<double>, vy array<double>")

    def inputs(batch):
        take = lambda c, n: np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, n, 60)
        return take("vx", 4), take("vy", 2)

    got = []
    for parts in (1, 3):
        batch = normalised.Batch(rows.repartition(parts, "row"), inputs, state, weight, dropout, (1, 2), 2)
        got.append((*batch.gradients(), batch.found))
    (loss, n, found, stats), (loss3, n3, found3, _) = got
    assert n == n3 == 5 and loss == pytest.approx(loss3, rel=1e-6) and set(found) == set(found3) == set(state.weights)
    assert all(np.allclose(found[k], found3[k], rtol=1e-3, atol=1e-5) for k in found)
    own = normalised.Pass(state, stats, dropout, (1, 2))
    mask = lambda k: own.mask(np.arange(5), k, (len(state.weights[f"{state.names[k]}.scale"]), 60))
    assert loss == pytest.approx(normalised_loss(state, x, y, weight, mask), rel=1e-5)
    for name in state.weights:
        w = state.weights[name]
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 3)]:
            both = []
            for step in (1e-5, -1e-5):
                w[at] += step
                both.append(normalised_loss(state, x, y, weight, mask))
                w[at] -= step
            assert found[name][at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=2e-2, abs=2e-3), name


def test_running_statistics(spark):
    from ionweave.operators import normalised

    rng = np.random.default_rng(3)
    a, b = rng.normal(3, 2, (4, 3, 50)), rng.normal(-1, 1, (2, 3, 50))
    n, mean, squares = normalised.merged(normalised.part(a), normalised.part(b))
    both = np.concatenate([a, b])
    assert n == 300 and np.allclose(mean, both.mean(axis=(0, 2))) and np.allclose(squares / n, both.var(axis=(0, 2)))
    state = normalised.State.of(small_network(3))
    width = len(state.weights["start.scale"])
    state.running = {k: (np.full(width, 2.0), np.full(width, 4.0)) for k in state.names}
    sums = rng.normal(size=(1, width, 30))
    want = (np.maximum(sums, 0) - 2) / np.sqrt(4 + 1e-5) * state.weights["start.scale"][:, None] + state.weights["start.shift"][:, None]
    assert np.allclose(state.network()._layer("start", sums), want, atol=1e-5)


def test_normalised_training(spark):
    engine, names = Engine(spark), ["GFVIDDGIITK", "YVGDSYDSSAK", "AGAGAGK", "MFPEK"]
    rows = spectra(spark, [(str(i), p) for i, p in enumerate(names)]).withColumn("peptide_true", F.reverse("peptide"))
    start = model.Network.random(width=2, convs=1)
    net = engine.train_bin_reclassifier(rows, rows, network=start, epochs=2, steps=1, rate=3e-3, normalise=True, dropout=0.1)
    assert set(net.weights) == set(start.weights) and not np.allclose(net.weights["start.scale"], start.weights["start.scale"])
    assert all(np.isfinite(v).all() for v in net.weights.values())
    with pytest.raises(ValueError):
        engine.train_bin_reclassifier(rows, rows, network=start, epochs=1, dropout=0.1)


def test_table_functions_in_sql(spark):
    """LATERAL joins give the rows of the operators."""
    from ionweave.functions.register import register

    register(spark)
    rows = [(1, "GFVIDDGIITK", 2, [147.1128, 165.0], [1.0, 2.0]), (2, "PEBTIDE", 2, [100.0], [1.0]), (3, None, 2, None, None), (4, "AGK", 1, [147.1128], [3.0])]
    psms = spark.createDataFrame(rows, "scan int, peptide string, charge int, mzs array<double>, ints array<double>")
    psms.createOrReplaceTempView("some_psms")
    got = spark.sql("SELECT scan, n.slot, round(n.tmz, 6), n.emz, n.eint FROM some_psms, LATERAL nearest_peaks(peptide, charge, mzs, ints, 5000D) n")
    want = features.matched_slots(psms.withColumn("tints", F.array_repeat(F.lit(1.0), K.SLOTS)), ["scan"], 5000.0).selectExpr("scan", "slot", "round(tmz, 6)", "emz", "eint")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r.scan for r in got.collect()} == {1, 4}
    nodes = spark.createDataFrame([("F1:7", b, 0.5) for b in (19, 76, 90, 147, 300)] + [("x", 5, 1.0)], "scan string, bin int, p double")
    nodes.createOrReplaceTempView("some_nodes")
    walked = spark.sql("SELECT scan, w.* FROM (SELECT scan, collect_list(bin) AS bins, collect_list(p) AS p FROM some_nodes GROUP BY scan) s, LATERAL graph_walks(s.scan, s.bins, s.p, 5) w")
    same = graph.walks(nodes, list(K.residue_bins()), 5, None)
    assert sorted((r.scan, r.path, r.peptide, round(r.score, 9)) for r in walked.collect()) == sorted((r.scan, r.path, r.peptide, round(r.score, 9)) for r in same.collect())


def test_original_score_is_a_feature(spark, tmp_path):
    from ionweave.plans.api import Settings

    lines = ["seq,z,m,i,p,s,d"] + [f'AGAG{"G" * (i % 3)}K,2,"[147.1, {200 + i}.5]","[1.0, 2.0]",589.3,{i % 7}.5,{i % 7}' for i in range(60)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    columns = {"peptide": "seq", "charge": "z", "mzs": "m", "ints": "i", "precursor_mz": "p", "score": "s"}
    engine = Engine(spark, settings=Settings(original_score=True))
    table = engine.feature_table(str(tmp_path / "t.csv"), "d", str(tmp_path / "f"), **columns)
    assert table.columns == [*K.FEATURES, "original_score", "target"]
    engine.train_scorer_from_features([table], "boosted", count=4, depth=3)
    assert engine.scorer.ensemble.names[-1] == "original_score"
    done = engine.rescoring_from_csv(str(tmp_path / "t.csv"), **columns)
    assert done.count() == 60 and done.where("score > '-Infinity'").count() == 60


def test_profiles_of_more_charges_in_finer_bins(spark):
    """Ions of three charges in bins of half an m/z become channels; a network of that width runs and learns."""
    from ionweave.plans.api import Settings

    settings = Settings(charges=(1, 2), resolution=0.5)
    engine = Engine(spark, settings=settings, network=model.Network.random(channels=6, width=2, convs=1, resolution=0.5))
    rows = spectra(spark, [("1", "GFVIDDGIITK"), ("2", "AGK")])
    got = engine.profiles(engine.prepared(rows, "mgf")).where("scan = '2'").first()
    masses = np.array([71.037114, 57.021464, 128.094963])
    y = masses[::-1].cumsum()[:2] + K.WATER
    whole = masses.sum() + K.WATER
    for z, found in ((1, got.y_bins), (2, got.more_bins[0])):
        want = [19 / z, *((m + z * K.PROTON) / z for m in y), (whole + 1) / z]
        assert found == sorted({int(m // 0.5) for m in want})
    x = model.channels(got.y_bins, got.b_bins, got.mz, got.intensities, got.mzs, got.ints, 1.0, got.more_bins, resolution=0.5)
    assert x.shape == (6, 4000) and np.flatnonzero(x[2]).tolist() == got.more_bins[0]
    assert np.flatnonzero(model.channels([], [], [147.6], [1.0], [147.6, 900.0], [1.0, 1.0], 1.0, resolution=0.5)[-1]).tolist() == [295]
    done = engine.bin_reclassification(engine.prepared(rows, "mgf")).collect()
    assert {r.scan: r.y_mz_inputs for r in done}["2"] == got.y_bins
    truth = rows.withColumn("peptide_true", F.reverse("peptide"))
    net = engine.train_bin_reclassifier(truth, truth, epochs=1, steps=1, rate=1e-3)
    assert not np.allclose(net.weights["mix2.w"], model.Network.random(channels=6, width=2, convs=1, resolution=0.5).weights["mix2.w"])
    with pytest.raises(ValueError):
        engine.search(rows, relational.lookup_table(spark))


def test_uniform_predictions_fill_their_slots(spark):
    rows = spark.createDataFrame([("GFVIDDGIITK", z) for z in (1, 2, 3, 5, None, 0)] + [("A", 2), (None, 2), ("A" * 40, 3), ("AXB", 2)], "peptide string, charge int")
    for r in files.uniform_predictions(rows).collect():
        slot, mz = features.slots_of(r.peptide, r.charge)
        want = np.full(K.SLOTS, -1.0)
        want[slot] = mz
        assert np.allclose(r.mz, want) and r.intensities == [1.0 if m > 0 else -1.0 for m in want]


def test_reachable_needs_no_worker(spark):
    steps = list(K.residue_bins())
    rng = np.random.default_rng(5)
    held = {s: sorted(rng.choice(2000, n, replace=False).tolist()) for s, n in (("F1:7", 300), ("a", 40), (None, 60), ("one", 1))}
    nodes = spark.createDataFrame([(s, b) for s, bins in held.items() for b in bins] + [("a", held["a"][-1]), ("a", None), ("none", None)], "scan string, bin int")
    found = graph.reachable(nodes, steps)
    assert "Pandas" not in found._jdf.queryExecution().toString() and found.dtypes == nodes.dtypes
    want = {(s, int(b)) for s, bins in held.items() for b in np.array(bins)[graph.back_reachable(np.array(bins), steps)]}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.reachable(nodes.limit(0), steps).count() == 0


def test_weighted_cross_entropy():
    """Without a gamma occupied cells alone are weighted, and the gradient is that of the loss."""
    rng = np.random.default_rng(1)
    logits, truth, weight = rng.normal(size=(2, 2, 5)), rng.integers(0, 2, (2, 2, 5)), np.array([[3.0], [7.0]])
    p = 1 / (1 + np.exp(-logits))
    want = -(weight * truth * np.log(p) + (1 - truth) * np.log(1 - p))
    loss, d = model.focal(logits, truth, weight, None)
    assert loss == pytest.approx(want.sum()) and np.allclose(d, np.where(truth > 0, weight * (p - 1), p))


def test_subsets_and_test_files(spark, tmp_path):
    from ionweave.plans.api import Settings

    for name, n in (("train", 40), ("test", 12)):
        lines = ["seq,z,m,i,p,d,scan"] + [f'AGAG{"G" * (i % 3)}K,2,"[147.1, {200 + i}.5]","[1.0, 2.0]",{230 + 28.51 * (i % 3)},{i % 7},s{i}' for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    columns = {"peptide": "seq", "charge": "z", "mzs": "m", "ints": "i", "precursor_mz": "p"}
    engine = Engine(spark)
    scorer, found = engine.train_and_test_scorer([str(tmp_path / "train.csv")], [str(tmp_path / "test.csv")], "d", **columns)
    predicted = scorer.predict(engine.feature_table(str(tmp_path / "test.csv"), "d", **columns)).toPandas()
    assert found.first().mse == pytest.approx(((predicted["target"] + predicted["score"]) ** 2).mean())
    few = Engine(spark, scorer=LengthScorer(), network=model.Network.random(width=2, convs=1), settings=Settings(population=4, generations=1, least_score=-9.0, most_score=-5.0))
    done = few.search_from_csv(str(tmp_path / "test.csv"), random_subset=3, scan="scan", **columns)
    assert done.count() == 3
