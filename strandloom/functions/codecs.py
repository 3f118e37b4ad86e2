"""Column expressions for bases, chromosomes, packed observations and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
CHROMOSOMES = [str(i) for i in range(1, 23)] + ["X", "Y"]


def encode_base(c: Column) -> Column:
    """A 0, C 1, G 2, T or U 3, in either case; anything else 5."""
    u = F.upper(c)
    return F.when(u == "A", 0).when(u == "C", 1).when(u == "G", 2).when(u.isin("T", "U"), 3).otherwise(5)


def decode_base(code: Column) -> Column:
    return F.when(code.between(0, 3), F.lit(BASES).substr(code + 1, F.lit(1))).otherwise("N")


def pack(cell: Column, base: Column) -> Column:
    return F.shiftleft(cell, 2).bitwiseOR(base)


def unpack_cell(packed: Column) -> Column:
    return F.shiftright(packed, 2)


def unpack_base(packed: Column) -> Column:
    return packed.bitwiseAND(3)


def chromosome_name(id_: Column) -> Column:
    return F.when(id_ == 22, "X").when(id_ == 23, "Y").when(id_.between(0, 21), (id_ + 1).cast("string"))


def chromosome_id(name: Column) -> Column:
    """0 to 23, null for any other name."""
    n = name.try_cast("int")
    return F.when(F.upper(name) == "X", 22).when(F.upper(name) == "Y", 23).when(n.between(1, 22), n - 1)


def genotype(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 3).bitwiseOR(b)


def first_allele(g: Column) -> Column:
    return F.shiftright(g, 3)


def second_allele(g: Column) -> Column:
    return g.bitwiseAND(7)


def is_homozygous(g: Column) -> Column:
    return first_allele(g) == second_allele(g)


def same_genotype(a: Column, b: Column) -> Column:
    """Whatever the order of the alleles; two missing genotypes are the same."""
    order = lambda g: F.when(g.isNotNull(), F.struct(F.least(first_allele(g), second_allele(g)), F.greatest(first_allele(g), second_allele(g))))
    return order(a).eqNullSafe(order(b))
