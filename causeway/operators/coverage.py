"""Coverage: expected points, witnesses, ledger, recommendations, parameter grids, mutation adequacy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.scalars import canonical_json, digest
from causeway.session import checkpointed


def expected_points(*parts: DataFrame) -> DataFrame:
    """Union of (seq, dimension, key, family): of equal points the last counts."""
    rows = reduce(DataFrame.unionByName, parts)
    last = F.row_number().over(Window.partitionBy("dimension", "key").orderBy(F.desc("seq"), F.desc("family")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def outcome_witnesses(results: DataFrame) -> DataFrame:
    """(dimension, key, witnesses) of ``invariant|status`` outcomes."""
    key = F.concat_ws("|", "invariant", "status")
    return results.groupBy(key.alias("key")).agg(F.count("*").alias("witnesses")).select(F.lit("outcome").alias("dimension"), "key", "witnesses")


#: Fault of an interaction point without one.
BASELINE = "baseline"


def _points(dimension: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(dimension).alias("dimension"), k.alias("key")))


def _interactions(family: Column, faults: Column, profiles: Column) -> Column:
    return F.flatten(F.transform(profiles, lambda p: F.transform(faults, lambda f: F.concat_ws("|", family, f, p))))


def family_points(families: DataFrame) -> DataFrame:
    """(dimension, key, family, place): what a registry of scenario families expects to see, in seven dimensions.

    ``families`` has seq, family, topology and the arrays axes, invariants, profiles and faults
    (none null). A point that several families name counts for the last of them, and has the place of the first.
    """
    named = F.concat(
        _points("family", F.array("family")), _points("topology", F.array("topology")), _points("universe_axis", F.col("axes")), _points("invariant", F.col("invariants")),
        _points("observability", F.col("profiles")), _points("interaction", _interactions(F.col("family"), F.concat(F.array(F.lit(BASELINE)), "faults"), F.col("profiles"))), _points("fault_operator", F.col("faults")),
    )
    rows = families.select("seq", "family", F.posexplode(named).alias("pos", "p"))
    return rows.groupBy("p.dimension", "p.key").agg(F.max_by("family", F.struct("seq", "pos")).alias("family"), F.min(F.struct("seq", "pos")).alias("place"))


def scenario_witnesses(instances: DataFrame, families: DataFrame, realizations: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """(dimension, key, witnesses): how many instances saw a point, in nine dimensions; each counts once a point.

    ``instances`` has instance_id (unique), family, profile and the array faults; one of an unknown
    family has none of that family's points. ``realizations`` (instance_id, realization) and
    ``results`` (a row for each case and invariant) add the last two dimensions.
    """
    rows = instances.join(families.select("family", "topology", "axes", "invariants"), "family")
    faults = F.when(F.size("faults") > 0, F.col("faults")).otherwise(F.array(F.lit(BASELINE)))
    seen = F.array_distinct(F.concat(
        _points("family", F.array("family")), _points("topology", F.array("topology")), _points("universe_axis", F.col("axes")), _points("invariant", F.col("invariants")),
        _points("observability", F.array("profile")), _points("interaction", _interactions(F.col("family"), faults, F.array("profile"))), _points("fault_operator", F.col("faults")),
    ))
    counted = rows.select(F.explode(seen).alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("witnesses"))
    if realizations is not None:
        real = realizations.join(instances.select("instance_id"), "instance_id", "left_semi").groupBy(F.col("realization").alias("key")).agg(F.count_distinct("instance_id").alias("witnesses"))
        counted = counted.unionByName(real.withColumn("dimension", F.lit("realization")))
    return counted if results is None else counted.unionByName(outcome_witnesses(results))


def suggestions(expected: DataFrame, witnesses: DataFrame, most: int = 12) -> DataFrame:
    """Families by how many points of theirs nobody saw, with the first of these by place, and the fault (none for the
    baseline) and profile of the first interaction among them."""
    missing = expected.join(witnesses, ["dimension", "key"], "left_anti")
    crossing = F.col("dimension") == "interaction"
    numbered = missing.withColumn("n", F.row_number().over(Window.partitionBy("family").orderBy("place")))
    firsts = F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", F.concat_ws(":", "dimension", "key").alias("point")))))
    top = numbered.groupBy("family").agg(F.count("*").alias("uncovered"), firsts["point"].alias("points"), F.min_by(F.when(crossing, F.col("key")), F.when(crossing, F.col("n"))).alias("first"))
    part = F.split("first", r"\|", 3)
    rank = F.row_number().over(Window.orderBy(F.desc("uncovered"), "family"))  # a row a family
    return top.select("family", "uncovered", "points", F.nullif(F.get(part, F.lit(1)), F.lit(BASELINE)).alias("fault"), F.get(part, F.lit(2)).alias("profile"), rank.alias("rank"))


def ledger(expected: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Expected points as covered or uncovered, and witnesses that none expected as supplemental."""
    known = expected.join(witnesses, ["dimension", "key"], "left").select(
        "dimension", "key", "family", F.when(F.col("witnesses").isNull(), "uncovered").otherwise("covered").alias("status"), F.coalesce("witnesses", F.lit(0)).cast("long").alias("witnesses"))
    extra = witnesses.join(expected, ["dimension", "key"], "left_anti").select(
        "dimension", "key", F.lit(None).cast("string").alias("family"), F.lit("supplemental").alias("status"), F.col("witnesses").cast("long"))
    return known.unionByName(extra)


def completion(rows: DataFrame) -> DataFrame:
    """Of each dimension how many points there are, and the share covered."""
    known = rows.where("status <> 'supplemental'")
    return known.groupBy("dimension").agg(F.count("*").alias("points"), F.count_if(F.col("status") == "covered").alias("covered"), F.round(F.avg((F.col("status") == "covered").cast("double")), 6).alias("share"))


def ledger_summary(rows: DataFrame) -> DataFrame:
    """Points by status, 0 where there is none."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("covered", "uncovered", "supplemental", "invalid", "unsupported")])


def recommend(rows: DataFrame, most: int = 12) -> DataFrame:
    """Families by how many uncovered points they have, with the first of these."""
    open_points = rows.where("status = 'uncovered' and family is not null")
    place = F.row_number().over(Window.partitionBy("family").orderBy("dimension", "key"))
    top = open_points.withColumn("n", place).groupBy("family").agg(
        F.count("*").alias("uncovered"), F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.col("key")))).alias("points"))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("uncovered"), "family")))  # a row a family


def adequacy(trials: DataFrame) -> DataFrame:
    """Mutation adequacy: detected, survived and the share detected (1 without trials)."""
    return trials.agg(F.count_if("detected").alias("detected"), F.count_if(~F.col("detected")).alias("survived")).withColumn(
        "score", F.when(F.col("detected") + F.col("survived") == 0, 1.0).otherwise(F.col("detected") / (F.col("detected") + F.col("survived"))))


def failures(constraints: list[tuple[str, str, str, object]]) -> Column:
    """Names of the constraints that a row of parameters breaks.

    A constraint is (name, operator, column, operand); for "requires" and "excludes" the
    operand is ((column value), other column, other value).
    """
    out = []
    for name, op, column, operand in constraints:
        c = F.col(column)
        if op == "eq":
            ok = c == operand
        elif op == "ne":
            ok = c != operand
        elif op == "in":
            ok = c.isin(*operand)
        elif op == "not_in":
            ok = ~c.isin(*operand)
        elif op == "requires":
            ok = (c != operand[0]) | (F.col(operand[1]) == operand[2])
        elif op == "excludes":
            ok = (c != operand[0]) | (F.col(operand[1]) != operand[2])
        else:
            raise ValueError(f"unknown constraint: {op}")
        out.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def grid(domains: dict[str, DataFrame], constraints: list) -> DataFrame:
    """Every combination of the domains' values with the constraints it breaks (none: admissible).

    The combinations are the result asked for; each domain is a table of distinct values.
    """
    empty = next(iter(domains.values())).sparkSession.range(1).select()
    combined = reduce(lambda a, b: a.join(b, F.lit(True)), domains.values(), empty)
    return combined.withColumn("broken", failures(constraints))


def _reads(constraint: tuple) -> set[str]:
    _, op, column, operand = constraint
    return {column, operand[1]} if op in ("requires", "excludes") else {column}


def join_order(sizes: dict[str, int], constraints: list) -> list[str]:
    """The domains in the order in which they are joined: next is always the one that lets the most constraints cut, then the smallest."""
    order: list[str] = []
    while len(order) < len(sizes):
        there = set(order)
        cuts = {c: sum(_reads(x) <= there | {c} and not _reads(x) <= there for x in constraints) for c in sizes if c not in there}
        order.append(min(cuts, key=lambda c: (-cuts[c], sizes[c], c)))
    return order


def admissible_steps(domains: dict[str, DataFrame], constraints: list) -> list[DataFrame]:
    """The growing product of the domains, of which each constraint cuts what breaks it as soon as its columns are there."""
    counted = reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(c).alias("c"), "n") for c, d in domains.items()])
    order = join_order({r["c"]: r["n"] for r in counted.collect()}, constraints)  # a row for each domain
    steps: list[DataFrame] = []
    for number, column in enumerate(order):
        before = set(order[:number])
        rows = steps[-1].join(domains[column], F.lit(True)) if steps else domains[column]
        ready = [x for x in constraints if _reads(x) <= before | {column} and not _reads(x) <= before]
        steps.append(rows.where(F.size(failures(ready)) == 0) if ready else rows)
    return steps


def admissible(domains: dict[str, DataFrame], constraints: list) -> DataFrame:
    """Every combination of the domains' values that breaks no constraint; the whole product is never built. Constraints on
    columns without a domain are errors."""
    if unknown := set().union(*map(_reads, constraints), set()) - set(domains):
        raise ValueError(f"constraints on unknown parameters: {sorted(unknown)}")
    return admissible_steps(domains, constraints)[-1].select(*domains)


#: Rounds of the permutation, and the numbers that its rounds multiply by.
_ROUNDS, _FIRST, _SECOND = 4, 40503, 60493


def half_bits(size: int) -> int:
    """Bits of each half of a permutation of at least ``size`` numbers; at most 30."""
    bits = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    if bits > 30:
        raise ValueError("the product of the domains has more than 2^60 combinations")
    return bits


def round_keys(seed: int, bits: int) -> list[int]:
    return [(seed * 1_000_003 + (r + 1) * 7_919) % (1 << bits) for r in range(_ROUNDS)]


def permuted(number: Column, seed: int, bits: int) -> Column:
    """A seeded permutation of the numbers of ``2 * bits`` bits: a Feistel network."""
    left, right = F.shiftrightunsigned(number, bits), number.bitwiseAND(F.lit((1 << bits) - 1))
    for key in round_keys(seed, bits):
        mixed = right.bitwiseXOR(F.lit(key)) * F.lit(_FIRST).cast("long")
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, 9)) * F.lit(_SECOND).cast("long")
        left, right = right, left.bitwiseXOR(F.shiftright(mixed, 5).bitwiseAND(F.lit((1 << bits) - 1)))
    return F.shiftleft(left, bits).bitwiseOR(right)


def sample(domains: dict[str, DataFrame], constraints: list, n: int, seed: int) -> DataFrame:
    """``n`` different admissible combinations (all, if there are fewer), drawn without building the grid; ``draw`` is their order.

    Combinations are numbered in mixed radix, the values of each domain in their order. A
    seeded permutation of all numbers is walked from 0 on: what lies beyond the last
    number, and what breaks a constraint, is passed over. Numbers are turned into values by a join
    with each domain. Blocks of draws double until enough are found or the permutation ends.
    """
    numbered = {c: d.select(F.col(c), (F.row_number().over(Window.orderBy(c)) - 1).cast("long").alias("at")) for c, d in domains.items()}
    sizes = {c: d.count() for c, d in domains.items()}
    total = reduce(lambda a, b: a * b, sizes.values(), 1)
    if not total or n <= 0:
        return grid(domains, []).drop("broken").withColumn("draw", F.lit(0).cast("long")).limit(0)
    bits, spark = half_bits(total), next(iter(domains.values())).sparkSession
    start, block, parts, found = 0, max(64, 4 * n), [], 0
    while found < n and start < 4**bits:
        end = min(start + block, 4**bits)
        rows = spark.range(start, end).select(F.col("id").alias("draw"), permuted(F.col("id"), seed, bits).alias("rank")).where(F.col("rank") < total)
        for c in reversed(domains):  # the last domain turns fastest
            digit = rows.withColumn("digit", F.col("rank") % sizes[c]).withColumn("rank", F.expr(f"rank div {sizes[c]}"))
            rows = digit.join(numbered[c], digit["digit"] == numbered[c]["at"]).drop("digit", "at")
        kept = rows.where(F.size(failures(constraints)) == 0).select(*domains, "draw").orderBy("draw").limit(n - found)
        kept = checkpointed(kept)
        parts.append(kept)
        found += kept.count()
        start, block = end, block * 2
    return reduce(DataFrame.unionByName, parts)


def parameter_pairs(instances: DataFrame, id_col: str) -> DataFrame:
    """Distinct pairs of (parameter, value) that occur together in an instance."""
    names = sorted(c for c in instances.columns if c != id_col)
    pairs = [F.struct(F.lit(a).alias("p1"), F.col(a).cast("string").alias("v1"), F.lit(b).alias("p2"), F.col(b).cast("string").alias("v2")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return instances.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()


def uncovered_pairs(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found, ["p1", "v1", "p2", "v2"], "left_anti")


def instance_points(instances: DataFrame, id_col: str) -> DataFrame:
    """Instances with their coverage points: ``parameter=value`` of each parameter."""
    names = sorted(c for c in instances.columns if c != id_col)
    return instances.select(id_col, F.array_sort(F.array(*[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])).alias("points"))


def minimized(points: Column, prefixes: list[str]) -> Column:
    """The points that begin with one of some prefixes."""
    return F.filter(points, lambda p: reduce(lambda a, b: a | b, [p.startswith(x) for x in prefixes]))


def instance_digest(instances: DataFrame, id_col: str) -> DataFrame:
    names = [c for c in instances.columns if c != id_col]
    return instances.select(id_col, digest(canonical_json(F.to_json(F.struct(*names)))).alias("digest"))
