"""Column functions over nucleotide and protein sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in the order T, C, A, G of each base.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Residue weights in daltons.
WEIGHTS = {
    "A": 89.1, "R": 174.2, "N": 132.1, "D": 133.1, "C": 121.2, "E": 147.1, "Q": 146.2, "G": 75.1, "H": 155.2, "I": 131.2,
    "L": 131.2, "K": 146.2, "M": 149.2, "F": 165.2, "P": 115.1, "S": 105.1, "T": 119.1, "W": 204.2, "Y": 181.2, "V": 117.1,
}
UNKNOWN_WEIGHT = 110.0
WATER = 18.015
# Ribosome binding motifs and their weights; spacing peak and width.
RBS = (("AGGAGG", 1.0), ("GGAGG", 0.75), ("AGGAG", 0.65))
PEAK, WIDTH = 9, 6

VALID_GENOME = "^[ATGCNRYSWKMBDHV]*$"
VALID_PROTEIN = "^[ACDEFGHIKLMNPQRSTVWYX*]*$"
# Annotations that say nothing.
PLACEHOLDERS = (
    "hypothetical protein", "predicted protein", "unknown protein", "uncharacterized protein",
    "putative protein", "conserved hypothetical protein", "probable protein",
)
ORF_NAME = r"^(orf|gp|cds|gene|protein|hypothetical|putative\s+orf)\s*[\d_\-]+$"


def reverse_complement(seq: Column, keep_others: bool = False) -> Column:
    """Other letters than A, T, G, C become N, or stay with ``keep_others``."""
    plain = seq if keep_others else F.regexp_replace(seq, "[^ATGCN]", "N")
    return F.reverse(F.translate(plain, "ATGC", "TACG"))


def gc_percent(seq: Column, digits: int | None = 2) -> Column:
    n = F.length(seq)
    share = F.when(n > 0, F.lit(100.0) * (n - F.length(F.translate(seq, "GC", ""))) / n).otherwise(0.0)
    return share if digits is None else F.round(share, digits)


def codons(seq: Column) -> Column:
    """Whole codons in order, in one pass."""
    return F.regexp_extract_all(seq, F.lit("[A-Za-z*-]{3}"), F.lit(0))


def translate_dna(seq: Column) -> Column:
    """Standard code; codons with other letters give X, stops *."""

    def amino(c: Column) -> Column:
        first, second, third = (F.instr(F.lit(BASES), F.substring(c, i, 1)) for i in (1, 2, 3))
        known = (first > 0) & (second > 0) & (third > 0)
        return F.when(known, F.substring(F.lit(AMINO_ACIDS), (first - 1) * 16 + (second - 1) * 4 + third, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(codons(seq), amino), "")


def protein_length(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, r"\*+$", ""))


def molecular_weight(seq: Column, digits: int | None = 2) -> Column:
    """Sum of residue weights (others 110) less a water for each bond, the trailing stops aside."""
    bare = F.regexp_replace(seq, r"\*+$", "")
    n = F.length(bare)
    total, known = F.lit(0.0), F.lit(0)
    for letter, weight in WEIGHTS.items():
        count = n - F.length(F.translate(bare, letter, ""))
        total, known = total + count * F.lit(weight), known + count
    total = total + (n - known) * F.lit(UNKNOWN_WEIGHT) - F.when(n > 1, (n - 1) * F.lit(WATER)).otherwise(0.0)
    return total if digits is None else F.round(total, digits)


def composition(seq: Column) -> Column:
    """Map of letter to count, of letters that occur."""
    letters = F.array_sort(F.array_distinct(F.filter(F.split(seq, ""), lambda x: x != "")))
    return F.map_from_arrays(letters, F.transform(letters, lambda x: F.length(seq) - F.length(F.replace(seq, x, F.lit("")))))


def rbs_count(seq: Column, start: Column) -> Column:
    """Different binding motifs in [start - 14, start - 4)."""
    low = F.greatest(start - 14, F.lit(0))
    window = F.upper(F.substring(seq, low + 1, F.greatest(start - 4 - low, F.lit(0)).cast("int")))
    return sum((window.contains(m).cast("int") for m, _ in RBS[1:]), window.contains(RBS[0][0]).cast("int"))


def position_weight(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(distance - PEAK) / F.lit(float(WIDTH)))


def weighted_sd_score(seq: Column, start: Column) -> Column:
    """Best motif weight times position weight in [start - 15, start - 3); 0 for starts below 3."""
    low = F.greatest(start - 15, F.lit(0))
    window = F.upper(F.substring(seq, (low + 1).cast("int"), F.greatest(start - 3 - low, F.lit(0)).cast("int")))
    places = F.sequence(F.lit(0), F.lit(11))
    scores = [F.array_max(F.transform(places, _sd_at(window, motif, weight, start, low))) for motif, weight in RBS]
    # every motif holds one of the two shorter ones
    some = window.contains(RBS[1][0]) | window.contains(RBS[2][0])
    return F.when((start >= 3) & some, F.greatest(*scores)).otherwise(0.0)


def _sd_at(window: Column, motif: str, weight: float, start: Column, low: Column):
    def score(i: Column) -> Column:
        distance = F.bround(start - low - i - F.lit(len(motif) / 2.0), 0)
        return F.when(F.substring(window, i + 1, F.lit(len(motif))) == motif, F.lit(weight) * position_weight(distance)).otherwise(0.0)

    return score


def is_uninformative(text: Column) -> Column:
    bare = F.lower(F.trim(text))
    return bare.isin(*PLACEHOLDERS) | bare.rlike(ORF_NAME)


def display_name(name: Column, locus_tag: Column, gene_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(locus_tag, F.lit("")), gene_id)


def normalise_gene(seq: Column) -> Column:
    """Upper case, ambiguity codes as N."""
    return F.translate(F.upper(seq), "RYWSKMBDHV", "NNNNNNNNNN")
