"""Near-duplicate vectors by range search on a robust-pruned flat graph (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.common import connected_components, keep

#: Vectors that the centroids are fitted on, and most centroids.
FIT_VECTORS, MOST_CENTROIDS = 20_000, 4096
#: Vectors of a shard that are aimed at, and those of one block of a larger shard.
SHARD, BLOCK = 800, 1200
#: Edges of a node, candidates they are pruned from (nearest and random), and the slack of pruning.
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 16, 1.2
#: Nodes kept while searching, and how far below the threshold the search still expands.
BEAM, SLACK = 24, 0.03

_UNIT = ["label", "dim", "shard", "i", "j"]


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids_of(nodes: DataFrame, dim: int, n: int, clusters: int, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors, fitted on a bounded sample drawn by hash."""
    share = min(1.0, FIT_VECTORS / max(n, 1))
    drawn = nodes.where((F.col("dim") == dim) & (F.pmod("node", F.lit(1 << 20)) < share * (1 << 20))).select("vec").toPandas()
    rng = np.random.default_rng(seed)
    if drawn.empty:
        return np.eye(1, dim)
    x = _unit_rows(drawn["vec"])
    order = np.lexsort(x.T)
    x = x[order]
    c = x[rng.choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(8):
        label = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Neighbour lists (n x DEGREE, -1 for none) of unit vectors, every node reachable from the medoid.

    Each node starts from its nearest vectors and a few random ones; it takes the nearest left, and
    drops those that the taken one is ALPHA times closer to, until nothing is left.
    """
    n = len(x)
    distance = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
    np.fill_diagonal(distance, np.inf)
    near = np.argpartition(distance, min(NEAREST, n - 1) - 1, axis=1)[:, : min(NEAREST, n - 1)] if n > 1 else np.zeros((n, 0), int)
    candidates = np.concatenate([near, np.random.default_rng(seed).integers(0, n, (n, RANDOM))], axis=1)
    own = np.arange(n)[:, None]
    gap = distance[own, candidates]
    edges = np.full((n, DEGREE), -1)
    rows = np.arange(n)
    for k in range(DEGREE):
        pick = gap.argmin(1)
        live = np.isfinite(gap[rows, pick])
        if not live.any():
            break
        taken = candidates[rows, pick]
        edges[live, k] = taken[live]
        covered = ALPHA * np.where(candidates == taken[:, None], 0, distance[taken[:, None], candidates]) <= gap
        gap[covered & live[:, None]] = np.inf
    return edges


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def _reachable(edges: np.ndarray, start: int) -> np.ndarray:
    seen = np.zeros(len(edges), bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        ahead = np.unique(edges[front])
        front = ahead[(ahead >= 0) & ~seen[ahead]]
        seen[front] = True
    return seen


def connect(x: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """Adds an edge from the nearest reached node to one of those out of reach, until all are reached."""
    while not (seen := _reachable(edges, start)).all():
        lost, reached = np.flatnonzero(~seen), np.flatnonzero(seen)
        closest = x[lost] @ x[reached].T
        at = int(closest.max(1).argmax())
        edges = np.concatenate([edges, np.full((len(edges), 1), -1)], axis=1)
        edges[reached[closest[at].argmax()], -1] = lost[at]
        free = np.all(edges < 0, axis=0)
        edges = edges[:, ~free]
    return edges


def range_search(x: np.ndarray, edges: np.ndarray, start: int, query: int | np.ndarray, threshold: float) -> np.ndarray:
    """Nodes found with cosine to ``query``, a node or a unit vector, of at least ``threshold``.

    A greedy beam walks from ``start`` towards the query; once it stands still, every node within the
    slack of the threshold is expanded, until that finds no more.
    """
    cos = np.full(len(x), -2.0)
    done = np.zeros(len(x), bool)
    asked = query if isinstance(query, np.ndarray) else x[query]
    cos[start] = x[start] @ asked
    seen = [start]
    front = np.array([start])
    while len(front):
        done[front] = True
        ahead = np.unique(edges[front])
        ahead = ahead[(ahead >= 0) & (cos[ahead] < -1.5)]
        if len(ahead):
            cos[ahead] = x[ahead] @ asked
            seen.extend(ahead.tolist())
        known = np.array(seen)
        best = known[np.argpartition(-cos[known], BEAM)[:BEAM]] if len(known) > BEAM else known
        near = known[cos[known] >= threshold - SLACK]
        front = np.unique(np.concatenate([best, near]))
        front = front[~done[front]]
    known = np.array(seen)
    return known[cos[known] >= threshold]


def _build(unit: pd.DataFrame) -> pd.DataFrame:
    x = _unit_rows(unit["vec"])
    edges = robust_prune(x)
    nodes = unit["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "edges": [nodes[e[e >= 0]] for e in edges]})


def _search(threshold: float):
    """Looks for the links of a unit's nodes by its graph, or, where it has guests, for theirs only."""

    def search(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("node", ignore_index=True)
        x, nodes, guest = _unit_rows(unit["vec"]), unit["node"].to_numpy(), unit["guest"].to_numpy(bool)
        here, i, j, block, home, second = unit["shard"].iloc[0], unit["i"].iloc[0], unit["j"].iloc[0], *(unit[c].to_numpy() for c in ("block", "home", "second"))
        index = np.flatnonzero(~guest)
        linked = np.zeros((len(x), len(x)), bool)
        if len(index):
            own = nodes[index]
            lists = [np.unique(np.searchsorted(own, e[np.isin(e, own)])) for e in unit["edges"].iloc[index]]
            edges = np.full((len(index), max(1, max(map(len, lists)))), -1)
            for k, e in enumerate(lists):
                edges[k, : len(e)] = e
            start = medoid(x[index])
            edges = connect(x[index], edges, start)
            for q in np.flatnonzero(guest) if guest.any() else index:
                linked[q, index[range_search(x[index], edges, start, x[q], threshold - 1e-9)]] = True
        linked |= linked.T
        np.fill_diagonal(linked, False)
        # The exact test, in double precision on the vectors as they are.
        raw = np.stack(unit["vec"].to_numpy()).astype(np.float64)
        raw /= np.abs(raw).max(1, keepdims=True)
        a, b = np.nonzero(linked)
        norms = np.sqrt((raw * raw).sum(1))
        for s in range(0, len(a), 1 << 16):
            p, q = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            linked[p, q] = (raw[p] * raw[q]).sum(1) / (norms[p] * norms[q]) >= threshold
        if i != j and not guest.any():  # pairs within a block are those of another unit
            linked &= block[:, None] != block[None, :]
        # A node counts its links to nodes whose nearest centroid is this shard's, so each link counts once.
        links = (linked & (home == here)[None, :]) @ unit["copies"].to_numpy()
        reach = [np.unique(np.concatenate([home[row], second[row]])) for row in linked]
        root = np.arange(len(x))
        for k in range(len(x)):  # spanning links: to the smallest node of the unit's component
            if root[k] == k:
                front = np.array([k])
                while len(front):
                    front = np.flatnonzero(linked[front].any(0) & (root > k) & (np.arange(len(x)) > k))
                    root[front] = k
        return pd.DataFrame({"node": nodes, "links": np.where(guest | ~guest.any(), links, 0), "root": nodes[root], "reach": reach})

    return search


_FOUND = "node long, links long, root long, reach array<int>"


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", whole: bool = False) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept). Vectors of one label link at a cosine of ``threshold`` or more.

    Equal vectors of one label are one node. Each node joins the shards of its two nearest centroids;
    shards get robust-pruned graphs, a node's neighbours from all its shards are united, and a
    range-expanding greedy search from the shard's medoid looks for each node's links, which are then
    tested in double precision. Walks go on across shards: a node asks, as a guest, every further shard
    that a node linked to it belongs to, round by round until no link leads anywhere new. So a cloud that
    centroids cut is walked through, and where nothing is near nobody travels. A node counts the
    links to nodes whose nearest centroid is that of the shard, so each counts once.

    A shard above ``BLOCK`` nodes is dealt out in blocks, every two of
    which make a unit of their own, so no unit grows with the data and no two nodes of a shard fail
    to meet; guests meet every block. With ``whole`` all nodes of a label are in one shard, so that all its blocks meet. Recall is measured by
    ``audit_recall``; ``audited_vectors`` turns to whole labels where it is too low.

    A vector that is null, empty or zero, that holds null or non-finite components, or whose label is
    null links with nothing; vectors of different length neither. Null ids keep their rows and are
    nobody's component, unless all of it are null. Repeated ids and rows count as vectors of their own. An
    empty table gives an empty one. Other columns are not read. Nodes are known by 64-bit hashes of label and vector.
    """
    ok = usable(F.col(vec_col)) & F.col(label_col).isNotNull()
    vec = F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(ok, vec).alias("vec"))
    rows = rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = keep(nodes.withColumn("dim", F.size("vec")), "nodes")

    found = keep(_links(_placed(nodes, whole), threshold), "found")
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.select("node", "copies", "least").join(links, "node").join(components, "node", "left")
    of_node = of_node.withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = of_node.join(least, "component").select("node", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(of_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def audited_vectors(vectors: DataFrame, threshold: float = 0.98, least: float = 0.9, **columns: str) -> DataFrame:
    """The result of ``near_vectors`` with its audited ``recall``; below ``least`` that of whole labels, in which all blocks meet."""
    for whole in (False, True):
        out = keep(near_vectors(vectors, threshold, whole=whole, **columns), "near-vectors")
        recall = audit_recall(vectors, out, threshold, **columns)
        if recall >= least:
            break
    return out.withColumn("recall", F.lit(recall))


def _placed(nodes: DataFrame, whole: bool) -> DataFrame:
    """Nodes with the shards of their nearest (``home``) and next centroid (``second``)."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()  # a row per length of vector
    centroids = {r.dim: np.eye(1, r.dim) if whole else centroids_of(nodes, r.dim, r.n, min(MOST_CENTROIDS, max(2, math.ceil(2 * r.most / SHARD)))) for r in sizes}
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_CENTROIDS vectors of each length

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                c = shared.value[dim]
                order = np.argsort(-(_unit_rows(part["vec"]) @ c.T), axis=1)[:, :2]
                yield part.assign(home=order[:, 0], second=order[:, -1])

    placed = nodes.select("node", "label", "dim", "vec", "copies").mapInPandas(assign, "node long, label string, dim int, vec array<double>, copies long, home int, second int")
    return keep(placed, "placed")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("block")), F.col(blocks)).cast("int")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*_UNIT[:3]).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


def _links(placed: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, links, root, reach) of all units: first those of the shards, then those of guests in further shards."""
    members = placed.withColumn("shard", F.explode(F.array_distinct(F.array("home", "second"))))
    dealt = members.join(_blocks(members, "blocks"), _UNIT[:3]).withColumn("block", _block("blocks"))
    units = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    units = keep(units.drop("with", "blocks").withColumn("guest", F.lit(False)), "members")
    adjacency = units.groupBy(*_UNIT).applyInPandas(_build, "node long, edges array<long>")
    united = keep(adjacency.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "adjacency")
    found = keep(units.join(united, "node").groupBy(*_UNIT).applyInPandas(_search(threshold), _FOUND), "found")
    known = members.select("node", "shard")
    at_home = placed.join(united, "node").withColumn("shard", F.col("home"))
    at_home = at_home.join(_blocks(at_home, "blocks"), _UNIT[:3]).withColumn("block", _block("blocks")).withColumn("guest", F.lit(False))
    new = found
    while True:
        asked = new.select("node", F.explode("reach").alias("shard")).distinct().join(known, ["node", "shard"], "left_anti")
        asked = keep(asked, "guests")
        if asked.isEmpty():
            return found
        guests = asked.join(placed, "node")
        counts = guests.join(_blocks(guests, "asking"), _UNIT[:3]).join(at_home.select(*_UNIT[:3], "blocks").distinct(), _UNIT[:3])
        guests = counts.withColumn("i", _block("asking")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        guests = guests.withColumn("block", F.lit(-1)).withColumn("guest", F.lit(True)).withColumn("edges", F.lit(None).cast("array<long>"))
        hosts = at_home.join(counts.select(*_UNIT[:3], "asking").distinct(), _UNIT[:3])
        hosts = hosts.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)))
        columns = [*_UNIT, "node", "vec", "copies", "home", "second", "block", "guest", "edges"]
        new = keep(guests.select(*columns).unionByName(hosts.select(*columns)).groupBy(*_UNIT).applyInPandas(_search(threshold), _FOUND), "found")
        known, found = known.unionByName(asked), found.unionByName(new)


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = 2000) -> float:
    """Share of the true links found, over the vectors whose id is divisible by 20 as queries against all rows of their label, in blocks.

    Queries and rows of a label are dealt out in blocks, and every two blocks meet in one task.
    1.0 where there is no true link.
    """
    ok = usable(F.col(vec_col)) & F.col(label_col).isNotNull()
    vec = F.transform(vec_col, lambda x: x.cast("double"))
    rows = vectors.where(ok).select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"), F.monotonically_increasing_id().alias("row"))
    rows = keep(rows.withColumn("dim", F.size("vec")), "audited")
    asked = F.col("vec_id") % 20 == 0
    key = ["label", "dim"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count_if(asked) / block).cast("int").alias("asks"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = rows.join(sizes.where("asks > 0"), key)
    units, dealt = [*key, "ask", "block"], lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    queries = sized.where(asked).withColumn("ask", dealt(F.col("asks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    against = sized.withColumn("block", dealt(F.col("blocks"))).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))

    def count(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        near = _unit_rows(q["vec"]) @ _unit_rows(r["r_vec"]).T >= threshold if len(q) and len(r) else np.zeros((0, 0), bool)
        own = np.isin(q["row"], r["r_row"]).sum() if len(q) and len(r) else 0
        return pd.DataFrame({"n": [int(near.sum() - own)]})

    found = result.where(F.col(id_col) % 20 == 0).agg(F.sum("n_links")).first()[0] or 0
    named = [f"r_{c}" for c in (*units, "row", "vec")]
    against = against.select(*[F.col(c[2:]).alias(c) for c in named]).groupBy(*named[: len(units)])
    pairs = queries.select(*units, "row", "vec").groupBy(*units).cogroup(against).applyInPandas(count, "n long")
    true = pairs.agg(F.sum("n")).first()[0] or 0
    return found / true if true else 1.0
