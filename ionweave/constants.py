"""Fixed values of the domain: residues, masses, slots, feature names."""

# Residue masses in the order of the residue codes 1..21.
RESIDUES = {
    "A": 71.037114, "C[UNIMOD:4]": 103.009185 + 57.0214637236, "D": 115.026943, "E": 129.042593, "F": 147.068414,
    "G": 57.021464, "H": 137.058912, "I": 113.084064, "K": 128.094963, "L": 113.084064, "M": 131.040485, "N": 114.042927,
    "P": 97.052764, "Q": 128.058578, "R": 156.101111, "S": 87.032028, "T": 101.047679, "V": 99.068414, "W": 186.079313,
    "Y": 163.063329, "M[UNIMOD:35]": 131.040485 + 15.99491,
}
CODES = {r: i for i, r in enumerate(RESIDUES, 1)}
PROTON, HYDROGEN, OXYGEN = 1.007276467, 1.007825035, 15.99491463
WATER = 2 * HYDROGEN + OXYGEN
MAX_LENGTH, MAX_CHARGE = 30, 6
PPM = 20.0
#: A ladder has a slot for each of 29 cleavages, ion type (y, b) and charge 1..3.
SLOTS = 6 * (MAX_LENGTH - 1)
SOURCE_BIN, MAX_BIN, MAX_TARGET = 19, 2000, 4000
CHANGE_THRESHOLDS = (0.3, 0.4, 0.45, 0.5, 0.55, 0.6)
TOKEN = r"M\[UNIMOD:35\]|C\[UNIMOD:4\]|[A-Z]"

CASES = ("all", "b", "y", "all_log", "b_log", "y_log")
STATS = ("mean", "std", "q75", "q50", "q25", "min", "max", "mse", "dot")
_IONS = ("", "_b", "_y")
FEATURES = (
    [f"p2p_gt_{int(100 * t)}" for t in CHANGE_THRESHOLDS]  # in hundredths: a name with a point would be a path
    + [f"sa_{c}" for c in CASES[:3]]
    + [f"pearson_{c}" for c in CASES]
    + [f"cos_{c}" for c in CASES]
    + [f"{s}_{c}" for s in STATS for c in CASES]
    + [f"spearman_{c}" for c in CASES]
    + [f"{k}_{g}{i}" for g in ("exp_theo", "exp_notTheo", "notExp_theo") for k in ("num", "rel", "rel2theo") for i in _IONS]
    + [f"{k}_exp{i}" for k in ("num", "rel") for i in _IONS]
)


def residue_bins(resolution: float = 1.0) -> dict[int, list[str]]:
    """Bins of the residue masses (I stands for L too), with the residues that share each."""
    found: dict[int, list[str]] = {}
    for residue, mass in RESIDUES.items():
        if residue != "L":
            found.setdefault(int(mass // resolution), []).append(residue)
    return dict(sorted(found.items()))
