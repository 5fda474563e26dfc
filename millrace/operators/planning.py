"""Small graphs and constraint problems: dependency levels, inherited profiles, power sets, run histories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_NODES = 1_000_000


def dependency_levels(nodes: DataFrame, edges: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(node, level): level 0 depends on nothing, every other node comes after all it depends on. A cycle is an error.

    ``edges`` has node, depends_on; edges to unknown nodes and to the node itself are dropped. A plan is a small graph: its nodes and
    edges are counted first, and are levelled on the driver, each edge once; above ``most`` the plan is refused.
    """
    names = nodes.select("node").distinct()
    known = edges.select("node", "depends_on").join(names, "node", "left_semi").join(names.withColumnRenamed("node", "depends_on"), "depends_on", "left_semi").filter("node <> depends_on").distinct()
    if names.count() + known.count() > most:
        raise ValueError(f"a plan has at most {most} nodes and edges")
    waits = {row["node"]: 0 for row in names.toLocalIterator()}
    after: dict = {}
    for row in known.toLocalIterator():
        waits[row["node"]] += 1
        after.setdefault(row["depends_on"], []).append(row["node"])
    level, ready, made = 0, sorted((n for n, w in waits.items() if not w), key=str), []
    while ready:
        made += [(n, level) for n in ready]
        following = []
        for n in ready:
            for other in after.get(n, ()):
                waits[other] -= 1
                if not waits[other]:
                    following.append(other)
        level, ready = level + 1, sorted(following, key=str)
    if len(made) < len(waits):
        raise ValueError("the plan has a cycle")
    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.sparkSession.createDataFrame(made, f"node {kind}, level int")


def inherited(profiles: DataFrame, entries: DataFrame, most: int = 32) -> DataFrame:
    """(profile, key, value): a profile's entries and those it inherits, the nearest winning. ``profiles`` has profile, parent."""
    spark = profiles.sparkSession
    profiles.createOrReplaceTempView("_profiles")
    lineage = spark.sql(f"""
        with recursive up(profile, ancestor, depth) as (
            select profile, profile, 0 from _profiles
            union all select u.profile, p.parent, u.depth + 1 from up u join _profiles p on p.profile = u.ancestor where p.parent is not null and u.depth < {most}
        ) select profile, ancestor, depth from up""")
    joined = lineage.join(entries.withColumnRenamed("profile", "ancestor"), "ancestor")
    guarded = F.when(F.col("depth") >= most, F.raise_error(F.lit("profiles inherit in a cycle")).cast("int")).otherwise(F.col("depth"))
    return joined.groupBy("profile", "key").agg(F.min_by("value", guarded).alias("value"))


def power_set(questions: DataFrame) -> DataFrame:
    """(qid, answer): each non-empty set of options as sorted letters for multi, each single option otherwise."""
    letters = F.array_sort(F.map_keys("options"))
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(letters)) - 1).cast("int"))
    subsets = F.transform(masks, lambda m: F.array_join(F.filter(letters, lambda x, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1), ""))
    return questions.select("qid", F.explode(F.when(F.col("answer_format") == "multi", subsets).otherwise(letters)).alias("answer"))


def history_bounds(runs: Mapping[str, Mapping[str, str]], correct: Mapping[str, int], valid: Mapping[str, list[str]]) -> dict[str, set[str]]:
    """The answers of each question that some assignment of right answers, consistent with every run's number of right ones, has.

    An exact dynamic programme over questions: a state is how many each run has right so far. It is a control problem of a few
    hundred questions, solved on the driver; states beyond a run's number are dropped as they appear. Inconsistent counts give
    empty sets.
    """
    names, qids = sorted(runs), sorted(valid)
    target = tuple(correct[n] for n in names)

    def gains(qid: str) -> dict[str, tuple[int, ...]]:
        return {a: tuple(int(runs[n].get(qid) == a) for n in names) for a in valid[qid]}

    forward = [{tuple([0] * len(names))}]
    for qid in qids:
        reached = {tuple(a + b for a, b in zip(state, g)) for state in forward[-1] for g in set(gains(qid).values())}
        forward.append({state for state in reached if all(x <= t for x, t in zip(state, target))})
    backward, out = {target} & forward[-1], {}
    for i in range(len(qids) - 1, -1, -1):
        of = gains(qids[i])
        out[qids[i]] = {a for a, g in of.items() if any(tuple(x - y for x, y in zip(s, g)) in forward[i] for s in backward)}
        backward = {p for s in backward for g in set(of.values()) if (p := tuple(x - y for x, y in zip(s, g))) in forward[i]}
    return out


def gain_patterns(spark: SparkSession, n: int, delta: int) -> DataFrame:
    """(pattern): each sequence of n gains (+1), losses (-1) and neutrals (0) that sums to ``delta``."""
    every = spark.range(3**n)
    digits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.pmod(F.floor(F.col("id") / F.pow(F.lit(3), i)), F.lit(3)) - 1).cast("int"))
    return every.select(digits.alias("d")).filter(F.aggregate("d", F.lit(0), lambda a, x: a + x) == delta).select(F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("pattern"))
