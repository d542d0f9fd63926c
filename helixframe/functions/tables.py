"""Fixed tables: the genetic code, ambiguity codes, residue scales and groups.

Larger tables (instability weights, substitution matrices) are parameters of
the functions that use them.
"""

from __future__ import annotations

from itertools import product

# The standard genetic code, bases in the order TCAG.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product(BASES, repeat=3), AMINO, strict=True)}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Ambiguity codes of nucleotides, in the order in which codons are enumerated.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

# Hydropathy (Kyte and Doolittle 1982).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# Helix propensity in kcal/mol (Pace and Scholtz 1998).
HELIX_PROPENSITY = {
    "A": 0.00, "R": 0.21, "N": 0.65, "D": 0.69, "C": 0.68, "Q": 0.39, "E": 0.40, "G": 1.00, "H": 0.61, "I": 0.41,
    "L": 0.21, "K": 0.26, "M": 0.24, "F": 0.54, "P": 3.16, "S": 0.50, "T": 0.66, "W": 0.49, "Y": 0.53, "V": 0.61,
}

# Consensus hydrophobicity (Eisenberg).
CONSENSUS_HYDROPHOBICITY = {
    "A": 0.62, "R": -2.53, "N": -0.78, "D": -0.90, "C": 0.29, "Q": -0.85, "E": -0.74, "G": 0.48, "H": -0.40, "I": 1.38,
    "L": 1.06, "K": -1.50, "M": 0.64, "F": 1.19, "P": 0.12, "S": -0.18, "T": -0.05, "W": 0.81, "Y": 0.26, "V": 1.08,
}

# Average masses of residues in Da (without the water of the free amino acid).
MASSES = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "Q": 128.1307, "E": 129.1155, "G": 57.0519, "H": 137.1411, "I": 113.1594,
    "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326,
}
WATER = 18.0153

# Two sets of pKa values.
PKA = {"D": 3.9, "E": 4.1, "H": 6.0, "C": 8.3, "Y": 10.1, "K": 10.5, "R": 12.5, "N_TERM": 8.0, "C_TERM": 3.1}
PKA_TAG = {"D": 3.65, "E": 4.25, "H": 6.0, "C": 8.3, "Y": 10.1, "K": 10.53, "R": 12.48, "N_TERM": 8.0, "C_TERM": 3.1}

# Residues that may replace another conservatively, in the order in which a scan lists them.
CONSERVATIVE = {
    "G": "A", "A": "GVS", "V": "AIL", "L": "VIM", "I": "VLM", "M": "LI", "F": "YW", "Y": "FWH", "W": "FY", "S": "TAN",
    "T": "SVN", "N": "QSD", "Q": "NEK", "K": "RQ", "R": "KH", "H": "RKY", "D": "EN", "E": "DQ", "C": "SA", "P": "AG",
}
