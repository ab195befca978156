"""Residue runs, chain sequences and their overlap, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.steps import settled

SID = "structure_id"


def residue_boundaries(atoms: DataFrame) -> DataFrame:
    """``atoms`` with ``starts``: the first atom of a residue in its chain."""
    w = W.partitionBy(SID, "chain_id").orderBy("atom_seq")
    same = F.lag("res_id").over(w).eqNullSafe(F.col("res_id")) & F.lag("ins_code").over(w).eqNullSafe(F.col("ins_code")) & (F.row_number().over(w) > 1)
    return atoms.withColumn("starts", ~same)


def residue_counts(atoms: DataFrame) -> DataFrame:
    return residue_boundaries(atoms).groupBy(SID).agg(F.count_if("starts").alias("residues"))


def chain_sequences(atoms: DataFrame) -> DataFrame:
    """(structure_id, chain_id, sequence): residue names in order."""
    firsts = residue_boundaries(atoms).filter("starts")
    ordered = F.sort_array(F.collect_list(F.struct("atom_seq", "res_name")))
    return firsts.groupBy(SID, "chain_id").agg(F.transform(ordered, lambda r: r["res_name"]).alias("sequence"))


def sequence_overlap(a: Column, b: Column) -> Column:
    """Most matches over all offsets of the shorter inside the longer, by the longer's
    length; two empty sequences overlap fully."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)

    def matches(offset: Column) -> Column:
        return F.size(F.filter(F.zip_with(F.slice(long, offset + 1, F.size(short)), short, lambda x, y: x == y), lambda m: m))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size(long) - F.size(short)), matches))
    return F.when(F.size(long) == 0, 1.0).when(F.size(short) == 0, 0.0).otherwise(best / F.size(long))


def unique_chain_count(sequences: Column, threshold: float = 0.95) -> Column:
    """Number of greedy clusters of an array of sequences, in order."""
    def add(reps: Column, s: Column) -> Column:
        return F.when(F.exists(reps, lambda r: sequence_overlap(r, s) >= threshold), reps).otherwise(F.array_append(reps, s))

    return F.size(F.aggregate(sequences, F.array().cast("array<array<string>>"), add))


def near_chains(chains: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(structure_id, a, b), a < b: chains of a structure whose overlap reaches
    ``threshold`` (over 0, at most 1). ``chains``: structure_id, k, sequence, unlike ones.

    A shorter chain of n residues that overlaps enough has floor(n * (1 - threshold))
    mismatches at most where it lies best. Cut into one block more than that, one block
    at least matches there without a mismatch. So equal blocks give the pairs and places
    that can overlap enough, and only these are compared residue by residue."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    n = F.size("sequence")
    slack = 1e-9
    most = lambda size: F.floor(size * (1 - threshold) + slack)
    width = lambda size: F.floor(size / (most(size) + 1)).cast("int")
    piece = lambda at, w: F.xxhash64(F.slice("sequence", at.cast("int") + 1, w))
    w = width(n)
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), most(n)), lambda i: F.struct((i * w).cast("int").alias("p"), piece(i * w, w).alias("h")))
    short = chains.filter(n > 0).select(SID, F.col("k").alias("s"), n.alias("ns"), w.alias("w"), F.explode(blocks).alias("e")).select(SID, "s", "ns", "w", "e.*")
    widths = F.array_distinct(F.transform(F.sequence(F.greatest(F.lit(1), F.ceil(n * threshold - slack).cast("int")), n), width))
    windows = F.transform("ws", lambda v: F.transform(F.sequence(F.lit(0), F.col("nl") - v), lambda q: F.struct(v.alias("w"), q.alias("q"), piece(q, v).alias("h"))))
    long = chains.filter(n > 0).withColumns({"ws": widths, "nl": n}).select(SID, F.col("k").alias("l"), "nl", F.explode(F.flatten(windows)).alias("e")).select(SID, "l", "nl", "e.*")
    offset = F.col("q") - F.col("p")
    met = long.join(short, [SID, "w", "h"]).filter((F.col("s") != F.col("l")) & (F.col("ns") <= F.col("nl")) & (F.col("ns") >= F.col("nl") * threshold - slack) & offset.between(0, F.col("nl") - F.col("ns")))
    places = met.select(SID, "l", "s", offset.alias("at")).distinct()
    of = lambda name, out: chains.select(SID, F.col("k").alias(name), F.col("sequence").alias(out))
    laid = places.join(of("l", "x"), [SID, "l"]).join(of("s", "y"), [SID, "s"])
    same = F.size(F.filter(F.zip_with(F.slice("x", F.col("at") + 1, F.size("y")), "y", lambda u, v: u == v), lambda m: m))
    return laid.filter(same / F.size("x") >= threshold).select(SID, F.least("l", "s").alias("a"), F.greatest("l", "s").alias("b")).distinct()


def unique_chains(chains: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(structure_id, unique_chains) of chains (structure_id, chain_id, sequence): greedy
    clusters in the order of chain ids, as ``unique_chain_count``. Chains of equal
    sequence are one from the start; the fold sees ids alone."""
    unlike = chains.groupBy(SID, "sequence").agg(F.min("chain_id").alias("k"))
    before = near_chains(unlike, threshold).groupBy(SID, F.col("b").alias("k")).agg(F.collect_list("a").alias("same_as"))
    listed = unlike.select(SID, "k").join(before, [SID, "k"], "left").groupBy(SID).agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("same_as", F.array().cast("array<string>")).alias("same_as")))).alias("c"))

    def add(reps: Column, one: Column) -> Column:
        return F.when(F.arrays_overlap(reps, one["same_as"]), reps).otherwise(F.array_append(reps, one["k"]))

    return listed.select(SID, F.size(F.aggregate("c", F.array().cast("array<string>"), add)).alias("unique_chains"))


def structure_metrics(atoms: DataFrame, threshold: float = 0.95) -> DataFrame:
    """num_chains, num_residues and num_sequence_unique_chains of each structure."""
    chains = settled(chain_sequences(atoms))
    unique = unique_chains(chains, threshold)
    listed = chains.groupBy(SID).agg(F.count(F.lit(1)).alias("num_chains"))
    return listed.join(residue_counts(atoms), SID).join(unique, SID).select(SID, "num_chains", F.col("residues").alias("num_residues"), F.col("unique_chains").alias("num_sequence_unique_chains"))


def sse_fractions(residues: DataFrame) -> DataFrame:
    """frac_alpha, frac_beta, frac_coil over assigned labels; null where none is."""
    n = F.count_if(F.coalesce("sse", F.lit("")) != "")
    return residues.groupBy(SID).agg(*[F.try_divide(F.count_if(F.col("sse") == s), n).alias(f"frac_{name}") for s, name in (("a", "alpha"), ("b", "beta"), ("c", "coil"))])
