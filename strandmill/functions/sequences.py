"""Sequences as expressions: composition, masking, codons, mutations, corrections."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard genetic code by codons in TCAG order, and letter sets: fixed values.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
NUCLEOTIDES = "ACGTN"
OTHER_IUPAC = "rymkswhbvd"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def codon_table() -> dict[str, str]:
    return {"".join(codon): amino for codon, amino in zip(product("TCAG", repeat=3), CODE, strict=True)}


_NUCLEOTIDE_CLASSES = {"A": "a", "C": "c", "G": "g", "T": "t", "N": "n", "other_IUPAC": OTHER_IUPAC, "-": "-", "?": "?"}
_RESIDUE_CLASSES = {a: a.lower() for a in AMINO_ACIDS} | {"*": "*", "X": "x", "-": "-"}


def _letter_counts(text: Column, classes: dict[str, str]) -> Column:
    """Counts of classes of (lower-case) letters, by one pass over each text."""
    place = np.zeros((256, len(classes)), dtype=np.int64)
    for i, letters in enumerate(classes.values()):
        place[[ord(c) for c in letters], i] = 1

    @F.pandas_udf("array<long>")
    def counted(texts: pd.Series) -> pd.Series:
        # Signs beyond Latin-1 count as its last letter, which is in no class.
        found = []
        for text in texts:
            codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
            found.append(np.bincount(np.minimum(codes, 255), minlength=256) @ place)
        return pd.Series(found)

    return counted(text)


def _index(df: DataFrame, id_column: str, sequence: str, classes: dict[str, str], rest: str) -> DataFrame:
    text = F.coalesce(F.col(sequence), F.lit(""))
    rows = df.select(F.col(id_column).alias(id_column), F.length(F.lower(text)).cast("long").alias("length"), _letter_counts(text, classes).alias("_sm_counts"))
    named = [F.col("_sm_counts")[i].alias(name) for i, name in enumerate(classes)]
    return rows.select(id_column, "length", *named, (F.col("length") - F.aggregate("_sm_counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias(rest))


def nucleotide_index(df: DataFrame, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    """Length and counts of A, C, G, T, N, other IUPAC letters, gaps, ? and the rest."""
    return _index(df, id_column, sequence, _NUCLEOTIDE_CLASSES, "invalid_nucleotides")


def amino_acid_index(df: DataFrame, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    """Length and counts of the twenty residues, stops, X, gaps and the rest."""
    return _index(df, id_column, sequence, _RESIDUE_CLASSES, "invalid_residues")


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").copy()


def masked(sequence: Column, begin: int = 0, end: int = 0, sites: list[int] = (), invalid: bool = False) -> Column:
    """N over the first and last letters, listed 0-based sites and, if asked, invalid letters.

    Any number of sites takes one pass over a sequence; sites past its end do nothing.
    """
    size = F.length(sequence)
    out = F.regexp_replace(sequence, "(?i)[^acgtnrymkswhbvd?-]", "N") if invalid else sequence
    if sites:
        places = np.array(sorted({int(s) for s in sites if s >= 0}), dtype=np.int64)

        @F.pandas_udf("string")
        def covered(texts: pd.Series) -> pd.Series:
            def one(text: str | None) -> str | None:
                if text is None:
                    return None
                letters = _code_points(text)
                letters[places[: np.searchsorted(places, len(letters))]] = ord("N")
                return letters.tobytes().decode("utf-32-le")

            return texts.map(one)

        out = covered(out)
    if not begin and not end:
        return out
    middle = F.substring(out, F.lit(begin + 1), F.greatest(size - begin - end, F.lit(0)))
    return F.when(size <= begin + end, F.repeat(F.lit("N"), size)).otherwise(F.concat(F.lit("N" * begin), middle, F.lit("N" * end)))


def _amino_tables() -> tuple[np.ndarray, np.ndarray]:
    """A code of 0 to 5 per letter (four bases, gap, other), and the amino acid of three codes."""
    codes = np.full(256, 5, dtype=np.int64)
    for i, base in enumerate("TCAG"):
        codes[[ord(base), ord(base.lower())]] = i
    codes[ord("-")] = 4
    amino = np.full((6, 6, 6), ord("X"), dtype=np.uint8)
    amino[:4, :4, :4] = np.frombuffer(CODE.encode(), dtype=np.uint8).reshape(4, 4, 4)
    amino[4, 4, 4] = ord("-")
    return codes, amino


def translated(sequence: Column) -> Column:
    """Amino acids of whole codons: --- is a gap, what has no meaning X, stops *.

    Raises where the length is no multiple of three. One pass, whatever the length.
    """
    codes, amino = _amino_tables()

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            letters = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
            if len(letters) % 3:
                raise ValueError("gene length is no multiple of 3")
            a, b, c = codes[letters].reshape(-1, 3).T
            return amino[a, b, c].tobytes().decode()

        return texts.map(one)

    return read(sequence)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTUNRYMKSWBDHVacgtu", "TGCAANYRKMSWVHDBtgcaa"))


def feature(sequence: Column, parts: list[tuple[int, int]], strand: int = 1) -> Column:
    """Joined 0-based half-open parts of a sequence, complemented on the reverse strand."""
    pieces = [F.substring(sequence, start + 1, end - start) for start, end in sorted(parts)]
    joined = F.concat(*pieces)
    return reverse_complement(joined) if strand < 0 else joined


def mutations(parent: Column, child: Column) -> Column:
    """Differing positions of two equally long sequences: array of <from><1-based place><to>."""
    pairs = F.zip_with(F.split(parent, ""), F.split(child, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    marked = F.transform(pairs, lambda p, i: F.when(p["a"] != p["b"], F.concat(p["a"], (i + 1).cast("string"), p["b"])))
    return F.array_compact(marked)


def parsed_mutation(text: Column) -> Column:
    """``struct<ref, pos, alt>`` of a mutation such as A10T."""
    form = r"^(\D*?)(\d+)(\D+)$"
    return F.struct(F.regexp_extract(text, form, 1).alias("ref"), F.regexp_extract(text, form, 2).try_cast("int").alias("pos"), F.regexp_extract(text, form, 3).alias("alt"))


def applied(sequence: Column, changes: Column) -> Column:
    """A sequence after an array of mutations ``struct<pos (1-based), alt>``, in one pass.

    Positions count the letters of the given sequence; of several changes of one place
    the last holds, those past the end are appended in order. Null changes do nothing.
    """

    @F.pandas_udf("string")
    def changed(texts: pd.Series, places: pd.Series, letters: pd.Series) -> pd.Series:
        def one(text: str | None, at: np.ndarray | None, to: np.ndarray | None) -> str | None:
            if text is None or at is None:
                return text
            out = list(text)
            for place, letter in zip(at, to, strict=True):
                if place is None or letter is None or place != place:
                    continue
                if 0 < place <= len(text):
                    out[int(place) - 1] = letter
                elif place > len(text):
                    out.append(letter)
            return "".join(out)

        return pd.Series([one(*row) for row in zip(texts, places, letters, strict=True)])

    return changed(sequence, F.transform(changes, lambda m: m["pos"]), F.transform(changes, lambda m: m["alt"]))


def corrected(sequence: Column, alphabet: str = "nuc") -> Column:
    """Upper case, with N (or X for amino acids) for letters outside the alphabet."""
    letters, blank = ("ACGTN-RYMKSWBDHV", "N") if alphabet == "nuc" else (AMINO_ACIDS + "*X-BZ", "X")
    return F.regexp_replace(F.upper(sequence), f"[^{letters.replace('-', '')}-]", blank)


def hamming(a: Column, b: Column, gaps_as_n: bool = True) -> Column:
    """Places where both letters are A, C, G or T and differ (or any letters, if asked)."""
    x, y = F.split(F.upper(a), ""), F.split(F.upper(b), "")
    real = lambda c: c.isin("A", "C", "G", "T")
    differ = F.zip_with(x, y, lambda p, q: ((p != q) & (real(p) & real(q) if gaps_as_n else F.lit(True))).cast("long"))
    return F.aggregate(differ, F.lit(0).cast("long"), lambda s, v: s + v)


def stripped_columns(sequence: Column, reference: Column) -> Column:
    """Letters of an aligned sequence where the reference has none of its gaps."""
    kept = F.filter(F.arrays_zip(F.split(sequence, "").alias("s"), F.split(reference, "").alias("r")), lambda p: p["r"] != "-")
    return F.array_join(F.transform(kept, lambda p: p["s"]), "")


def insertions(sequence: Column, reference: Column) -> Column:
    """Runs that an aligned sequence has where the reference has gaps:
    array<struct<place (letters of the reference before it), letters>>."""
    start = F.struct(F.lit(0).alias("place"), F.lit("").alias("run"), F.array().cast("array<struct<place:int,letters:string>>").alias("done"))
    pairs = F.arrays_zip(F.split(sequence, "").alias("s"), F.split(reference, "").alias("r"))

    def closed(a: Column) -> Column:
        return F.when(a["run"] != "", F.concat(a["done"], F.array(F.struct(a["place"].alias("place"), a["run"].alias("letters"))))).otherwise(a["done"])

    def step(a: Column, p: Column) -> Column:
        inside = p["r"] == "-"
        run = F.when(inside & (p["s"] != "-"), F.concat(a["run"], p["s"])).when(inside, a["run"]).otherwise("")
        return F.struct((a["place"] + F.when(inside, 0).otherwise(1)).alias("place"), run.alias("run"), F.when(inside, a["done"]).otherwise(closed(a)).alias("done"))

    return F.aggregate(pairs, start, step, closed)


def pretty_alignment(sequence: Column, id_: Column) -> tuple[Column, Column]:
    """(upper-case sequence, id without the mark of a reversed sequence)."""
    return F.upper(sequence), F.regexp_replace(id_, "^_R_", "")


def gaps_as_unknown(sequence: Column) -> Column:
    return F.translate(sequence, "-", "N")


def escaped_defline(name: Column) -> Column:
    """Names with the signs that tree builders reject replaced by reversible words."""
    out = name
    for sign, word in DEFLINE:
        out = F.replace(out, F.lit(sign), F.lit(word))
    return out


def unescaped_defline(name: Column) -> Column:
    out = name
    for sign, word in DEFLINE:
        out = F.replace(out, F.lit(word), F.lit(sign))
    return out


#: Signs and their stand-ins: a rule of code points, reversible.
DEFLINE = tuple((sign, f"_SIGN{ord(sign):03d}_") for sign in "/|*()';,:[]{}\"<>@#%&!? +=~^`")
