"""Peptides: digestion, fragments, decoys, score thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Monoisotopic residue masses, and the masses of water, a proton, carbon monoxide and ammonia.
RESIDUES = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
WATER, PROTON, CO, NH3 = 18.010565, 1.007276, 27.994915, 17.026549
# What each ion series adds to its residues.
SERIES = {"a": -CO, "b": 0.0, "c": NH3, "x": WATER + CO - 2 * 1.007825, "y": WATER, "z": WATER - NH3}
PREFIX = ("a", "b", "c")


def digest(sequence: Column) -> Column:
    """Fragments after K or R, unless P follows."""
    return F.filter(F.split(F.upper(sequence), r"(?<=[KR])(?!P)"), lambda f: f != "")


def rotated(fragment: Column) -> Column:
    """The last three residues before the two that precede them; shorter fragments as slices of text give them."""
    n = F.length(fragment)
    head = F.substring(fragment, F.lit(1), F.greatest(n - 5, F.lit(0)))
    tail = F.when(n >= 3, F.right(fragment, F.lit(3))).otherwise(fragment)
    middle = F.substring(fragment, F.greatest(n - 4, F.lit(1)), F.greatest(F.least(n - 3, F.lit(2)), F.lit(0)))
    return F.concat(head, tail, middle)


def rotate_sequence(sequence: Column) -> Column:
    return F.array_join(F.transform(digest(sequence), rotated), "")


#: Orders that are drawn before places are moved on by one.
DRAWS = 8


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row."""
    return F.transform(F.array(value), use)[0]


def _in_drawn_order(places: Column, key: Column) -> Column:
    drawn = F.array_sort(F.transform(places, lambda p: F.struct(F.md5(F.concat(key, p.cast("string")).cast("binary")).alias("h"), p.alias("p"))))
    return F.transform(drawn, lambda d: d["p"])


def shuffled(fragment: Column, key: Column, mode: str, percent: float) -> Column:
    """Residues of a fragment in an order drawn by hashes of ``key`` and place: some places but the last, those about the middle, or the last five. With some places, an order that moves none is drawn again."""
    n = F.length(fragment)
    if mode == "random":
        some = F.floor((n - 1) * percent).cast("int")
        picked = F.slice(_in_drawn_order(F.sequence(F.lit(0), n - 2), F.concat(key, F.lit(":pick:"))), F.lit(1), some)
        places = F.when(n > 1, F.array_sort(picked)).otherwise(F.array().cast("array<int>"))
    elif mode == "random_center":
        middle = F.floor(n / 2).cast("int")
        places = F.sequence(F.greatest(middle - 3, F.lit(0)), F.least(middle + 3, n) - 1)
    else:
        places = F.sequence(F.greatest(n - 5, F.lit(0)), n - 1)
    order = lambda p, a: _in_drawn_order(p, F.concat(key, F.lit(":order:"), a.cast("string"), F.lit(":")))

    def chosen(p: Column) -> Column:
        if mode != "random":
            return order(p, F.lit(0))
        on = F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
        return F.when(F.size(p) > 1, F.coalesce(F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda a: order(p, a)), lambda o: o != p), F.lit(0)), on)).otherwise(p)

    def moved(p: Column, o: Column) -> Column:
        at = lambda q: F.array_position(o, q).cast("int")
        source = lambda q: F.when(at(q) > 0, F.get(p, at(q) - 1)).otherwise(q)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda q: F.substr(fragment, source(q) + 1, F.lit(1))), "")

    return _let(places, lambda p: _let(chosen(p), lambda o: moved(p, o)))


def mutate_sequences(rows: DataFrame, column: str, mutation: str = "random_end", percent: float = 0.5, seed: int = 42) -> DataFrame:
    """Decoys of a column of sequences, fragment by fragment; the same sequence always gives the same decoy."""
    if mutation == "rotate":
        return rows.withColumn(column, rotate_sequence(F.col(column)))
    key = F.concat(F.md5(F.col(column).cast("binary")), F.lit(f":{seed}:"))
    parts = F.transform(digest(F.col(column)), lambda f, i: shuffled(f, F.concat(key, i.cast("string")), mutation, percent))
    return rows.withColumn(column, F.array_join(parts, ""))


def fragments(rows: DataFrame, column: str, charge: int = 1, series: tuple[str, ...] = ("b", "y")) -> DataFrame:
    """(columns.., ion, length, mz): m/z of the fragment ions of 1 to n-2 residues; residues without a mass count as none."""
    masses = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    per_residue = F.transform(F.split(F.col(column), ""), lambda c: F.coalesce(F.try_element_at(masses, c), F.lit(0.0)))
    out = rows.withColumn("_masses", F.filter(per_residue, lambda m: m.isNotNull())).withColumn("_n", F.length(column))
    out = out.where("_n >= 3").withColumn("length", F.explode(F.sequence(F.lit(1), F.col("_n") - 2)))
    out = out.withColumn("ion", F.explode(F.array(*map(F.lit, series))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = F.when(F.col("ion").isin(*PREFIX), total(F.slice("_masses", F.lit(1), F.col("length")))).otherwise(total(F.slice("_masses", F.col("_n") - F.col("length") + 1, F.col("length"))))
    extra = F.element_at(F.create_map(*[F.lit(x) for s in series for x in (s, SERIES[s])]), F.col("ion"))
    return out.withColumn("mz", (part + extra + charge * PROTON) / charge).drop("_masses", "_n")


def evalue_threshold(sequences: DataFrame, column: str, n_database: DataFrame, pvalue: float = 0.05) -> DataFrame:
    """(evalue): ceil(p * median length * number of database sequences); ``n_database`` has one row (n)."""
    return sequences.agg(F.median(F.length(column)).alias("m")).join(n_database).select(F.ceil(F.lit(pvalue) * F.col("m") * F.col("n")).cast("int").alias("evalue"))


def min_probability(rows: DataFrame, column: str) -> DataFrame:
    """(cutoff): the least of a column of text that reads as numbers."""
    return rows.agg(F.min(F.col(column).try_cast("double")).alias("cutoff"))
