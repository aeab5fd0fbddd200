"""Sparse matrices as (i, j, v) and graphs as (src, dst, w): one row an entry, absent rows are zero or no edge.

Iterative operators join and aggregate a round at a time and cut their lineage with reliable checkpoints. One that hasn't
settled after its number of rounds raises: none returns what it has so far.

Edge cases: edges with a null end join nothing; repeated edges count as often as they are given where weights add up (degrees,
laplacian, matvec) and once elsewhere; self loops link nothing; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows from the folder in spark.checkpoint.dir, which all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.getConf().get("spark.checkpoint.dir") or sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


# Sparse matrices


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("j"), F.col("j").alias("__j"), F.col("v").alias("__v"))
    return a.join(right, "j").groupBy("i", F.col("__j").alias("j")).agg(F.sum(F.col("v") * F.col("__v")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """x: (j, x) -> (i, v)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def sparse_diagonal(a: DataFrame, k: int = 0) -> DataFrame:
    return a.where(F.col("j") - F.col("i") == k).select("i", "v")


def kron(a: DataFrame, b: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """shape: of b."""
    right = b.toDF("__i", "__j", "__v")
    return a.crossJoin(F.broadcast(right) if shape[0] * shape[1] <= 10_000 else right).select((F.col("i") * shape[0] + F.col("__i")).alias("i"), (F.col("j") * shape[1] + F.col("__j")).alias("j"), (F.col("v") * F.col("__v")).alias("v"))


def norm(a: DataFrame, order: str | int = "fro") -> float:
    if order == "fro":
        return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
    axis = "j" if order == 1 else "i"
    return a.groupBy(axis).agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0]


def conjugate_gradient(a: DataFrame, b: DataFrame, n: int, tol: float = 1e-10, most: int = 200) -> DataFrame:
    """(j, x) solving the symmetric positive definite system A x = b, b: (i, v). Vectors stay DataFrames; a round is one
    join and two aggregates."""
    state = checkpoint(b.sparkSession.range(n).select(F.col("id").alias("j")).join(b.select(F.col("i").alias("j"), F.col("v").alias("r")), "j", "left").select("j", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("r", F.lit(0.0)).alias("p")))
    rr = first = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
    for _ in range(most):
        if not rr or rr <= tol * tol * first:
            break
        ap = matvec(a, state.select("j", F.col("p").alias("x"))).select(F.col("i").alias("j"), F.col("v").alias("ap"))
        state = checkpoint(state.join(ap, "j", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))))
        alpha = rr / state.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        state = state.select("j", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        now = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = state.select("j", "x", "r", (F.col("r") + now / rr * F.col("p")).alias("p"))
        rr = now
    if rr and rr > tol * tol * first:
        raise RuntimeError(f"conjugate gradients did not settle in {most} rounds")
    return state.select("j", "x")


def power_iteration(a: DataFrame, n: int, rounds: int = 500, tol: float = 1e-12) -> tuple[float, DataFrame]:
    """Eigenvalue of the largest size, with its sign, and its unit vector (j, x). The start is uneven, so that it isn't
    orthogonal to the vector by symmetry. Two eigenvalues of that size don't settle, and raise."""
    x = a.sparkSession.range(n).select(F.col("id").alias("j"), (1.0 + (F.col("id") % 7) / 10.0).alias("x"))
    size = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    x = x.select("j", (F.col("x") / size).alias("x"))
    value = math.nan
    for _ in range(rounds):
        y = checkpoint(x.join(matvec(a, x).select(F.col("i").alias("j"), F.col("v").alias("y")), "j", "left").select("j", "x", F.coalesce("y", F.lit(0.0)).alias("y")))
        now, size = y.agg(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("y") * F.col("y")))).first()
        if not size:
            return 0.0, x
        x = y.select("j", (F.col("y") / size).alias("x"))
        if abs(now - value) <= tol * abs(now):
            return now, x
        value = now
    raise RuntimeError(f"power iteration did not settle in {rounds} rounds")


# Graphs


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """v, component: its smallest vertex. Large-star and small-star steps by turns, so rounds grow with the logarithm of
    the size and not with the length of paths; a run that hasn't settled after `rounds` raises."""
    both = _both(edges)
    every = both.select(F.col("src").alias("v"), (F.col("src") != F.col("dst")).alias("linked")).where("linked").select("v").distinct()
    if vertices is not None:
        every = every.union(vertices.select(F.col(vertices.columns[0]).alias("v"))).distinct()
    flat = lambda e: e.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    links, before = checkpoint(flat(edges.select("src", "dst"))), None
    for _ in range(rounds):
        around = _both(links)
        low = around.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        links = flat(around.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")))
        low = links.groupBy("src").agg(F.min("dst").alias("low"))
        links = checkpoint(flat(links.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return checkpoint(every.join(links.select(F.col("src").alias("v"), "dst"), "v", "left").select("v", F.coalesce("dst", "v").alias("component")))


def shortest_paths(edges: DataFrame, sources: DataFrame, *, limit: float = float("inf"), rounds: int = 1000) -> DataFrame:
    """source, v, distance, by relaxing the edges out of what changed (Bellman and Ford's method); edges (src, dst, w).
    A negative cycle keeps changing distances and is reported."""
    best = checkpoint(sources.select(F.col(sources.columns[0]).alias("source")).distinct().select("source", F.col("source").alias("v"), F.lit(0.0).alias("distance")))
    front = best
    most = min(rounds, edges.select("src").distinct().count() + 1)
    for _ in range(most):
        step = front.join(edges, front.v == edges.src).select("source", F.col("dst").alias("v"), (F.col("distance") + F.col("w")).alias("distance")).where(F.col("distance") <= limit)
        found = best.withColumn("old", F.col("distance")).unionByName(step.withColumn("old", F.lit(None).cast("double"))).groupBy("source", "v").agg(F.min("distance").alias("distance"), F.max("old").alias("old"))
        found = checkpoint(found)
        front = found.where("old is null or distance < old").select("source", "v", "distance")
        best = found.select("source", "v", "distance")
        if front.isEmpty():
            return best
    raise ValueError("negative cycle, or more rounds needed")


def breadth_first(edges: DataFrame, start, directed: bool = False) -> DataFrame:
    """v, depth, predecessor (the smallest vertex one level up)."""
    hop = edges.select("src", "dst") if directed else _both(edges)
    hop = checkpoint(hop.distinct())
    seen = front = hop.sparkSession.createDataFrame([(start, 0)], f"v {dict(hop.dtypes)['src']}, depth int").withColumn("predecessor", F.lit(None).cast(dict(hop.dtypes)["src"]))
    depth = 0
    while True:
        depth += 1
        new = front.join(hop, front.v == hop.src).groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("predecessor")).join(seen.select("v"), "v", "left_anti")
        front = checkpoint(new.select("v", F.lit(depth).alias("depth"), "predecessor"))
        if front.isEmpty():
            return seen
        seen = checkpoint(seen.unionByName(front))


def laplacian(edges: DataFrame, normed: bool = False) -> DataFrame:
    """(i, j, v) of the Laplacian of undirected weighted edges, each given once."""
    both = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w").union(edges.select("dst", "src", "w")).where("i != j")
    degree = both.groupBy("i").agg(F.sum("w").alias("d"))
    off, on = both.select("i", "j", (-F.col("w")).alias("v")), degree.select("i", F.col("i").alias("j"), F.col("d").alias("v"))
    whole = off.unionByName(on)
    if not normed:
        return whole
    d = degree.select("i", F.sqrt("d").alias("si"))
    return whole.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("si").alias("sj")), "j").select("i", "j", (F.col("v") / (F.col("si") * F.col("sj"))).alias("v"))


def dijkstra(edges: DataFrame, sources: DataFrame, *, limit: float = float("inf")) -> DataFrame:
    """source, v, distance, predecessor (the smallest vertex on a shortest path; null at the source) over edges whose weights
    aren't negative. Distances settle by relaxing what changed, then one join finds the predecessors."""
    if not edges.where("w < 0").isEmpty():
        raise ValueError("dijkstra needs weights that aren't negative")
    best = checkpoint(shortest_paths(edges, sources, limit=limit))
    steps = best.select("source", F.col("v").alias("src"), F.col("distance").alias("before")).join(edges.select("src", "dst", "w"), "src")
    tight = steps.join(best.select("source", F.col("v").alias("dst"), "distance"), ["source", "dst"]).where((F.col("before") + F.col("w") == F.col("distance")) & (F.col("src") != F.col("dst")) & (F.col("dst") != F.col("source")))
    found = tight.groupBy("source", F.col("dst").alias("v")).agg(F.min("src").alias("predecessor"))
    return best.join(found, ["source", "v"], "left")


def path_to(found: DataFrame, source, target) -> list:
    """Vertices from source to target by the predecessors of dijkstra's result (source, v, predecessor); none without a path.
    Follows one path: a look-up a step."""
    own = checkpoint(found.where(F.col("source") == source).select("v", "predecessor"))
    out, at = [target], target
    while at != source:
        row = own.where(F.col("v") == at).first()
        if row is None or row.predecessor is None or len(out) > own.count():
            return []
        at = row.predecessor
        out.append(at)
    return out[::-1]


def degrees(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def minimum_spanning_tree(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """src, dst, w of a spanning forest of least weight, by Boruvka's rounds: each component takes its cheapest edge out;
    ties go to the smaller (w, src, dst), so no cycle arises.

    Edges are put in that order once and go by their places in it, which are whole numbers and need no sort to find the least.
    Between rounds edges are those of components: of several between two the first is kept, so they become few."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["w", "src", "dst"]
    placed = edges.select("src", "dst", "w").where("src != dst").repartitionByRange(n, *order).sortWithinPartitions(*order)
    e = checkpoint(placed.select("src", "dst", "w", F.monotonically_increasing_id().alias("place")))
    least = lambda links: links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("place").alias("place"))
    links = checkpoint(least(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "place")))
    taken = e.select("place").where("false")
    for _ in range(rounds):
        ends = links.select(F.col("a").alias("c"), "place").unionByName(links.select(F.col("b").alias("c"), "place"))
        chosen = checkpoint(links.join(ends.groupBy("c").agg(F.min("place").alias("place")).select("place").distinct(), "place"))
        if chosen.isEmpty():
            return e.join(taken, "place").select("src", "dst", "w")
        taken = checkpoint(taken.unionByName(chosen.select("place")))
        label = connected_components(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        a, b = (label.select(F.col("v").alias(c), F.col("component").alias(f"{c}_")) for c in "ab")
        links = checkpoint(least(links.join(a, "a").join(b, "b").where("a_ != b_").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "place")))
    raise RuntimeError("the spanning forest did not settle")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """v, rank."""
    vertices = checkpoint(_both(edges).select(F.col("src").alias("v")).distinct())
    n = vertices.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    hop = checkpoint(edges.join(out, "src").select("src", "dst", (1 / F.col("k")).alias("share")))
    rank = vertices.withColumn("rank", F.lit(1 / n))
    for _ in range(rounds):
        given = hop.join(rank, hop.src == rank.v).groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        new = vertices.join(given, "v", "left").select("v", F.coalesce("in", F.lit(0.0)).alias("in"))
        lost = 1 - new.agg(F.sum("in")).first()[0]
        rank = checkpoint(new.select("v", ((1 - damping) / n + damping * (F.col("in") + lost / n)).alias("rank")))
    return rank


def triangle_count(edges: DataFrame) -> int:
    """Triangles of an undirected graph; edges go from the lower to the higher degree, which keeps hubs' lists short."""
    d = degrees(edges)
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a != b").distinct()
    e = e.join(d.select(F.col("v").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("v").alias("b"), F.col("degree").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = checkpoint(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = o.alias("p").join(o.alias("q"), F.col("p.y") == F.col("q.x")).select(F.col("p.x").alias("x"), F.col("q.y").alias("y"))
    return wedge.join(o, ["x", "y"]).count()


def value_iteration(transitions: DataFrame, rewards: DataFrame, discount: float, tol: float = 1e-9, rounds: int = 2000) -> DataFrame:
    """s, value, action of a Markov decision process: transitions (s, a, s2, p), rewards (s, a, r). The best action is the
    lowest on ties. A round is a join, an aggregate and a maximum a state."""
    moves = checkpoint(transitions.join(rewards, ["s", "a"]))
    states = rewards.select("s").distinct()
    now = checkpoint(states.withColumn("value", F.lit(0.0)).withColumn("action", F.lit(0)))
    for _ in range(rounds):
        q = moves.join(now.select(F.col("s").alias("s2"), "value"), "s2").groupBy("s", "a").agg((F.first("r") + discount * F.sum(F.col("p") * F.col("value"))).alias("q"))
        best = q.groupBy("s").agg(F.max("q").alias("value"), F.max_by("a", F.struct("q", -F.col("a"))).alias("action"))
        best = checkpoint(best)
        change = best.join(now.select("s", F.col("value").alias("old")), "s").agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0]
        now = best
        if change is None or change <= (tol * (1 - discount) / (2 * discount) if discount else tol):
            return now
    raise ArithmeticError("value iteration did not settle")


def policy_evaluation(transitions: DataFrame, rewards: DataFrame, policy: DataFrame, discount: float, tol: float = 1e-10, rounds: int = 3000) -> DataFrame:
    """s, value of a fixed policy (s, a)."""
    moves = checkpoint(transitions.join(rewards, ["s", "a"]).join(policy.select("s", "a"), ["s", "a"]))
    now = policy.select("s", F.lit(0.0).alias("value"))
    for _ in range(rounds):
        new = checkpoint(moves.join(now.select(F.col("s").alias("s2"), "value"), "s2").groupBy("s").agg((F.first("r") + discount * F.sum(F.col("p") * F.col("value"))).alias("value")))
        change = new.join(now.select("s", F.col("value").alias("old")), "s").agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0]
        now = new
        if change is None or change <= tol:
            return now
    raise ArithmeticError("policy evaluation did not settle")


def reverse_cuthill_mckee(edges: DataFrame, start) -> DataFrame:
    """v, place: breadth-first order by level and degree, reversed."""
    order = breadth_first(edges, start).join(degrees(edges), "v")
    n = order.count()
    w = Window.orderBy("depth", "predecessor", "degree", "v")  # vertices of one component; a bandwidth order is for matrices that fit a node
    return order.select("v", (n - F.row_number().over(w)).alias("place"))


def q_values(transitions: DataFrame, rewards: DataFrame, values: DataFrame, discount: float) -> DataFrame:
    """s, a, q of taking each action once and then earning `values` (s, value)."""
    ahead = transitions.join(values.select(F.col("s").alias("s2"), "value"), "s2").groupBy("s", "a").agg(F.sum(F.col("p") * F.col("value")).alias("ahead"))
    return rewards.join(ahead, ["s", "a"]).select("s", "a", (F.col("r") + discount * F.col("ahead")).alias("q"))


def greedy(q: DataFrame) -> DataFrame:
    """s, a: the best action, the lowest on ties."""
    return q.groupBy("s").agg(F.max_by("a", F.struct("q", -F.col("a"))).alias("a"))


def policy_iteration(transitions: DataFrame, rewards: DataFrame, discount: float, rounds: int = 100) -> DataFrame:
    """s, value, action: evaluate, improve, until no action changes."""
    policy = checkpoint(rewards.groupBy("s").agg(F.min("a").alias("a")))
    for _ in range(rounds):
        values = policy_evaluation(transitions, rewards, policy, discount)
        q = checkpoint(q_values(transitions, rewards, values, discount))
        own = q.join(policy, ["s", "a"]).select("s", F.col("q").alias("own"), F.col("a").alias("had"))
        better = greedy(q).join(q, ["s", "a"]).join(own, "s")
        new = checkpoint(better.select("s", F.when(F.col("q") > F.col("own") + 1e-9, F.col("a")).otherwise(F.col("had")).alias("a"), (F.col("q") > F.col("own") + 1e-9).alias("changed")))
        policy = new.select("s", "a")
        if new.where("changed").isEmpty():
            return values.join(policy.withColumnRenamed("a", "action"), "s")
    raise ArithmeticError("no convergence")


def finite_horizon(transitions: DataFrame, rewards: DataFrame, steps: int, discount: float = 1.0) -> DataFrame:
    """t, s, value, action for each step to go, by backward induction."""
    values = rewards.select("s").distinct().withColumn("value", F.lit(0.0))
    out = None
    for t in reversed(range(steps)):
        q = checkpoint(q_values(transitions, rewards, values, discount))
        best = q.groupBy("s").agg(F.max("q").alias("value"), F.max_by("a", F.struct("q", -F.col("a"))).alias("action"))
        now = checkpoint(best.select(F.lit(t).alias("t"), "s", "value", "action"))
        out = now if out is None else out.unionByName(now)
        values = now.select("s", "value")
    return out


def simulate(transitions: DataFrame, policy: DataFrame, start: DataFrame, steps: int, key: int = 0) -> DataFrame:
    """run, t, s: walks under a policy (s, a) from start (run, s). The draw of a run's step is a keyed hash, so a walk doesn't
    depend on how rows are dealt."""
    w = Window.partitionBy("s", "a").orderBy("s2").rowsBetween(Window.unboundedPreceding, 0)
    chance = checkpoint(transitions.join(policy.select("s", "a"), ["s", "a"]).withColumn("upto", F.sum("p").over(w)).select("s", "s2", (F.col("upto") - F.col("p")).alias("low"), "upto"))
    now = checkpoint(start.select("run", F.lit(0).alias("t"), "s"))
    out = now
    for t in range(steps):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(key), "run", F.lit(t)), 11) / float(1 << 53)
        now = checkpoint(now.withColumn("u", u).join(chance, "s").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("upto"))).groupBy("run").agg(F.min("s2").alias("s")).select("run", F.lit(t + 1).alias("t"), "s"))
        out = out.unionByName(now)
    return out


def lsqr(a: DataFrame, b: DataFrame, n: int, tol: float = 1e-10, most: int = 300) -> DataFrame:
    """(j, x) of least squares A x = b for a sparse A: conjugate gradients on the normal equations, A'A never made."""
    at = transpose(a)
    rhs = matvec(at, b.select(F.col("i").alias("j"), F.col("v").alias("x")))
    state = checkpoint(b.sparkSession.range(n).select(F.col("id").alias("j")).join(rhs.select(F.col("i").alias("j"), F.col("v").alias("r")), "j", "left").select("j", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("r", F.lit(0.0)).alias("p")))
    rr = first = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
    for _ in range(most):
        if not rr or rr <= tol * tol * first:
            break
        ap = checkpoint(matvec(a, state.select("j", F.col("p").alias("x"))))
        alpha = rr / ap.agg(F.sum(F.col("v") * F.col("v"))).first()[0]
        back = matvec(at, ap.select(F.col("i").alias("j"), F.col("v").alias("x"))).select(F.col("i").alias("j"), F.col("v").alias("q"))
        state = checkpoint(state.join(back, "j", "left").select("j", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.coalesce("q", F.lit(0.0))).alias("r"), "p"))
        now = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = state.select("j", "x", "r", (F.col("r") + now / rr * F.col("p")).alias("p"))
        rr = now
    if rr and rr > tol * tol * first:
        raise RuntimeError(f"least squares did not settle in {most} rounds")
    return state.select("j", "x")


def bicgstab(a: DataFrame, b: DataFrame, n: int, tol: float = 1e-10, most: int = 300) -> DataFrame:
    """(j, x) solving A x = b for a general square sparse A, b: (i, v). Two matrix products a round; sums come to the driver
    as one row."""
    start = b.sparkSession.range(n).select(F.col("id").alias("j")).join(b.select(F.col("i").alias("j"), F.col("v").alias("r")), "j", "left").select("j", F.coalesce("r", F.lit(0.0)).alias("r"))
    state = checkpoint(start.select("j", F.lit(0.0).alias("x"), "r", F.col("r").alias("r0"), F.col("r").alias("p")))
    rho, first = state.agg(F.sum(F.col("r") * F.col("r0")), F.sum(F.col("r") * F.col("r"))).first()
    if not first:
        return state.select("j", "x")
    product = lambda c, name: matvec(a, state.select("j", F.col(c).alias("x"))).select(F.col("i").alias("j"), F.col("v").alias(name))
    with_product = lambda c, name: checkpoint(state.join(product(c, name), "j", "left").withColumn(name, F.coalesce(name, F.lit(0.0))))
    for _ in range(most):
        state = with_product("p", "v")
        bottom = state.agg(F.sum(F.col("r0") * F.col("v"))).first()[0]
        if not bottom:
            break
        alpha = rho / bottom
        state = state.withColumn("s", F.col("r") - alpha * F.col("v"))
        state = with_product("s", "t")
        top, size = state.agg(F.sum(F.col("t") * F.col("s")), F.sum(F.col("t") * F.col("t"))).first()
        omega = top / size if size else 0.0
        state = state.select("j", (F.col("x") + alpha * F.col("p") + omega * F.col("s")).alias("x"), (F.col("s") - omega * F.col("t")).alias("r"), "r0", "p", "v")
        now, left = state.agg(F.sum(F.col("r") * F.col("r0")), F.sum(F.col("r") * F.col("r"))).first()
        if left <= tol * tol * first:
            return state.select("j", "x")
        if not omega or not now:
            break
        beta = now / rho * alpha / omega
        state, rho = state.select("j", "x", "r", "r0", (F.col("r") + beta * (F.col("p") - omega * F.col("v"))).alias("p")), now
    raise RuntimeError("biconjugate gradients broke down or did not settle")


def eigsh(a: DataFrame, n: int, k: int = 6, which: str = "LM", steps: int | None = None) -> tuple[list[float], DataFrame]:
    """k eigenvalues of a symmetric sparse A, rising, and their unit vectors (which, j, x), by Lanczos steps with full
    reorthogonalisation. which: LM (largest in size), LA (largest), SA (smallest).

    Vectors stay DataFrames; the driver holds the steps' small tridiagonal matrix, of a size that doesn't follow the data."""
    import numpy as np

    steps = min(n, max(2 * k + 20, 40)) if steps is None else min(steps, n)
    spark = a.sparkSession
    q = spark.range(n).select(F.col("id").alias("j"), (1.0 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"))
    size = q.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    basis = checkpoint(q.select(F.lit(0).alias("step"), "j", (F.col("x") / size).alias("x")))
    diag, off = [], []
    for s in range(steps):
        now = basis.where(F.col("step") == s).select("j", "x")
        w = checkpoint(now.select("j").join(matvec(a, now).select(F.col("i").alias("j"), F.col("v").alias("w")), "j", "left").select("j", F.coalesce("w", F.lit(0.0)).alias("w")))
        for turn in range(2):  # twice is enough
            dots = basis.join(w, "j").groupBy("step").agg(F.sum(F.col("x") * F.col("w")).alias("d")).collect()  # a row a step
            if turn == 0:
                diag.append(next((r.d for r in dots if r.step == s), 0.0))
            mine = spark.createDataFrame([(r.step, r.d) for r in dots], "step int, d double")
            back = basis.join(F.broadcast(mine), "step").groupBy("j").agg(F.sum(F.col("x") * F.col("d")).alias("b"))
            w = checkpoint(w.join(back, "j", "left").select("j", (F.col("w") - F.coalesce("b", F.lit(0.0))).alias("w")))
        size = w.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0]
        if s + 1 == steps or size <= 1e-12 * max(map(abs, diag)):
            break
        off.append(size)
        basis = checkpoint(basis.unionByName(w.select(F.lit(s + 1).alias("step"), "j", (F.col("w") / size).alias("x"))))
    t = np.diag(diag) + np.diag(off[: len(diag) - 1], 1) + np.diag(off[: len(diag) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    order = {"LM": np.argsort(-np.abs(values), kind="stable"), "LA": np.argsort(-values), "SA": np.argsort(values)}[which][:k]
    order = order[np.argsort(values[order])]
    weights = spark.createDataFrame([(c, s, float(vectors[s, i])) for c, i in enumerate(order.tolist()) for s in range(len(diag))], "which int, step int, d double")
    found = basis.join(F.broadcast(weights), "step").groupBy("which", "j").agg(F.sum(F.col("x") * F.col("d")).alias("x"))
    return values[order].tolist(), found


def svds(a: DataFrame, shape: tuple[int, int], k: int = 6, steps: int | None = None) -> list[float]:
    """k largest singular values of a sparse A, falling: the roots of the eigenvalues of A'A or AA', whichever is smaller."""
    small = matmul(transpose(a), a) if shape[1] <= shape[0] else matmul(a, transpose(a))
    values, _ = eigsh(checkpoint(small), min(shape), k, "LA", steps)
    return [max(v, 0.0) ** 0.5 for v in values[::-1]]


def spsolve_triangular(a: DataFrame, b: DataFrame, n: int, lower: bool = True) -> DataFrame:
    """(j, x) solving a triangular sparse A x = b by levels: in each round all unknowns whose others are known are solved, so
    the rounds are the longest chain of dependencies, n at most."""
    diag = checkpoint(a.where("i = j").select("i", F.col("v").alias("d")))
    if diag.where("d != 0").count() < n:
        raise ValueError("the matrix is singular")
    off = checkpoint(a.where("j < i" if lower else "j > i"))
    right = b.sparkSession.range(n).select(F.col("id").alias("i")).join(b, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("b"))
    left = checkpoint(right.join(diag, "i"))
    done = None
    while True:
        waits = off.join(left.select(F.col("i").alias("j")), "j", "left_semi").select("i").distinct()
        ready = left.join(waits, "i", "left_anti")
        now = checkpoint(ready.select(F.col("i").alias("j"), (F.col("b") / F.col("d")).alias("x")))
        done = now if done is None else checkpoint(done.unionByName(now))
        pushed = matvec(off, now)
        left = checkpoint(left.join(now.select(F.col("j").alias("i")), "i", "left_anti").join(pushed, "i", "left").select("i", (F.col("b") - F.coalesce("v", F.lit(0.0))).alias("b"), "d"))
        if left.isEmpty():
            return done


def depth_first(edges: DataFrame, start) -> list:
    """Vertices in depth-first order, smaller neighbours first. The order is sequential by definition: the edges that are
    reached are brought to the driver, so this is for graphs that fit it."""
    reached = breadth_first(edges, start).select("v")
    rows = _both(edges).join(reached.withColumnRenamed("v", "src"), "src").distinct().collect()
    near: dict = {}
    for r in rows:
        near.setdefault(r.src, []).append(r.dst)
    out, seen, stack = [], set(), [start]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            out.append(v)
            stack += sorted(near.get(v, []), reverse=True)
    return out
