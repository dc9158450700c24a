"""Selection, classification and cross-checks over a catalogue of named units.

A catalogue has ``name, module``, the flags ``has_range, is_theorem, is_proj, is_private, is_type,
is_instance, is_simp`` and the name lists ``type_consts`` and ``value_consts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.keys import file_safe, first_part
from runlens.operators.joins import salted_join
from runlens.operators.ordered import GROUP_LIMIT, scan_groups
from runlens.session import keep

# The constants that count as logic, as booleans and as natural numbers.
LOGIC = ["True", "False", "Not", "And", "Or", "Iff", "Eq"]
BOOL = """Bool true false Bool.and Bool.or Bool.xor Bool.not BEq BEq.beq bne instBEqOfDecidableEq
instDecidableEqBool ite cond Decidable Decidable.decide""".split()
NAT = """Nat OfNat.ofNat instOfNatNat Nat.add Nat.sub Nat.mul Nat.div Nat.mod HAdd HAdd.hAdd instHAdd
instAddNat HSub HSub.hSub instHSub instSubNat HMul HMul.hMul instHMul instMulNat HDiv HDiv.hDiv instHDiv
Nat.instDiv HMod HMod.hMod instHMod Nat.instMod LE LE.le instLENat LT LT.lt instLTNat GE.ge GT.gt""".split()


def is_human() -> Column:
    """Written by a person: has a source range, is a theorem and no projection."""
    return F.col("has_range") & F.col("is_theorem") & ~F.col("is_proj")


def human_units(catalog: DataFrame) -> DataFrame:
    return catalog.filter(is_human())


def from_package(df: DataFrame, package: str, module: str = "module") -> DataFrame:
    """Rows whose module's first part is ``package``."""
    return df.filter(first_part(F.col(module)) == package)


def module_filter(df: DataFrame, wanted: Column | DataFrame | None = None, module: str = "module") -> DataFrame:
    """Rows of the wanted modules, given as a condition or as a table of modules; all by default."""
    if wanted is None:
        return df
    if isinstance(wanted, Column):
        return df.filter(wanted)
    return df.join(wanted.select(F.col("module").alias(module)).distinct(), module, "left_semi")


def only_uses(consts: Column, allowed: Sequence[str]) -> Column:
    """Every used constant is in ``allowed``."""
    return F.size(F.array_except(consts, F.array(*[F.lit(a) for a in allowed]))) == 0


def relevant(include_simp: bool, logic: Sequence[str] = LOGIC) -> Column:
    """Useful as a premise: public, no type, not logic only, no instance and, unless wanted, no simp rule."""
    wanted = ~F.col("is_private") & ~F.col("is_type") & ~only_uses(F.col("type_consts"), logic) & ~F.col("is_instance")
    return wanted if include_simp else wanted & ~F.col("is_simp")


def unsafe_names(df: DataFrame, name: str = "module") -> DataFrame:
    """Names that cannot be file names; empty when all can."""
    return df.filter(~file_safe(F.col(name)))


def require_file_safe(df: DataFrame, name: str = "module") -> DataFrame:
    bad = unsafe_names(df, name).take(1)
    if bad:
        raise ValueError(f"name cannot be a file name: {bad[0][name]}")
    return df


def tier(logic: Sequence[str] = LOGIC, bools: Sequence[str] = BOOL, nats: Sequence[str] = NAT) -> Column:
    """The narrowest of logic, bool and nat whose constants cover the type; NULL for none."""
    consts = F.col("type_consts")
    return (
        F.when(only_uses(consts, logic), "logic")
        .when(only_uses(consts, [*logic, *bools]), "bool")
        .when(only_uses(consts, [*logic, *bools, *nats]), "nat")
    )


def with_tiers(catalog: DataFrame, **sets: Sequence[str]) -> DataFrame:
    """Human units with their tier; units of no tier are left out."""
    return human_units(catalog).withColumn("tier", tier(**sets)).filter(F.col("tier").isNotNull())


def lists_by(df: DataFrame, key: str, unit: str, chunk: int = 10_000, limit: int = GROUP_LIMIT) -> DataFrame:
    """Units of each key in order, in numbered lists of at most ``chunk``, with the key's total."""
    ones = df.select(key, unit).withColumn("_one", F.lit(1).cast("long"))
    placed = scan_groups(
        ones, [key], [unit], running={"_n": ("sum", "_one")}, whole={"units": ("sum", "_one")}, limit=limit
    )
    placed = placed.withColumn("chunk", F.floor((F.col("_n") - 1) / chunk))
    return placed.groupBy(key, "chunk").agg(
        F.max("units").alias("units"), F.sort_array(F.collect_list(unit)).alias("names")
    )


def with_module(names: DataFrame, catalog: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Names with their owning module, NULL for an unknown name."""
    return salted_join(names, catalog.select("name", "module"), ["name"], "left", limit)


def tally_by_module(names: DataFrame, catalog: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Names by owning module; a name without module is an error."""
    found = with_module(names, catalog)
    missing = F.raise_error(F.concat(F.lit("cannot find module of "), F.col("name")))
    return lists_by(found.withColumn("module", F.coalesce("module", missing)), "module", "name", chunk)


def imports_of(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """The distinct modules that own the names."""
    return with_module(names, catalog).select("module").filter(F.col("module").isNotNull()).distinct()


def new_names(before: DataFrame, after: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Rows of ``after`` whose name ``before`` does not have."""
    return salted_join(after, before.select("name").distinct(), ["name"], "left_anti", limit)


def used_names(catalog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct names that each unit refers to in the given lists."""
    lists = F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]))
    return catalog.select(F.col("name").alias("unit"), F.explode(lists).alias("name"))


def used_theorems(catalog: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Theorems that each unit's proof refers to: ``unit, name``."""
    theorems = catalog.filter(F.col("is_theorem")).select("name")
    refs = keep(used_names(catalog, ["value_consts"]), "refs")
    return salted_join(refs, theorems, ["name"], "left_semi", limit)


def relevant_premises(catalog: DataFrame, include_simp: bool, limit: int = GROUP_LIMIT) -> DataFrame:
    """Used theorems that are useful as premises."""
    wanted = catalog.filter(F.col("is_theorem") & relevant(include_simp)).select("name")
    refs = keep(used_names(catalog, ["value_consts"]), "refs")
    return salted_join(refs, wanted, ["name"], "left_semi", limit)


def unknown_references(catalog: DataFrame, known: DataFrame | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Names used in a proof or type that the catalogue does not have: ``unit, name``."""
    names = (known if known is not None else catalog).select("name")
    refs = keep(used_names(catalog, ["value_consts", "type_consts"]), "refs")
    return salted_join(refs, names, ["name"], "left_anti", limit)


def experiment_grid(units: DataFrame, variants: Sequence[str], repetitions: int = 1) -> DataFrame:
    """Every unit with every variant and repetition; each row of ``units`` expands in place."""
    names = F.array(*[F.lit(v) for v in variants])
    with_variants = units.select("*", F.posexplode(names).alias("variant_index", "variant"))
    return with_variants.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))


def skip_list(units: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Every variant with every unit of a list of units to skip."""
    return units.select("unit", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))


def with_skips(grid: DataFrame, skips: DataFrame) -> DataFrame:
    """Status T for rows whose (variant, unit) is to be skipped, NULL for rows to run."""
    marked = skips.select("variant", "unit").distinct().withColumn("_skip", F.lit(True))
    return grid.join(marked, ["variant", "unit"], "left").withColumn("status", F.when(F.col("_skip"), "T")).drop("_skip")
