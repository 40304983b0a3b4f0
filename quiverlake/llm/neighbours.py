"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Largest inner product is made a nearness on a sphere by one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm; queries have zero there. Graph and search compare vectors coded in one byte a coordinate;
what the search returns is scored on the original vectors in double precision.

NN-descent starts from random neighbours. In a round every node meets its ``degree`` neighbours and up to
``reverse`` nodes that have it as theirs; neighbours of neighbours meet there, in a join by node, and each
pair that would improve a list is sent to that list's node, which keeps the best. Rounds end when few lists
change. The search expands, round by round, each query's best unexpanded nodes, a join of the frontier with
the graph, and keeps the ``width`` best nodes met; it ends when those are all expanded. Queries that are
rows start at themselves.

Equal vectors are one node. A node's rows with the smallest ids, one more than are asked for, stand for it,
so a vector that a third of all rows share is one node too.

Defined results: vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, nor
do vectors whose length isn't the commonest one, nor rows with a null id; rows repeated with the same id
count once (the largest vector, if they differ); ties go to the smaller id; with fewer candidates than
asked for, all found are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_schema, count_rows, cut

DEGREE, REVERSE, SENT = 28, 18, 8
ROUNDS, STILL = 10, 0.02  # a round that changes a smaller part of the lists is the last
WIDTH, EXPANDED = 384, 64


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, v in double precision."""
    v = F.col(vector_col).cast("array<double>")
    fine = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return fine.where(F.size("v") == (sizes[0].n if sizes else -1)).groupBy("vec_id").agg(F.max("v").alias("v"))


def _coded(distinct: DataFrame, norm: float, as_query: bool) -> DataFrame:
    """(node, code): signed bytes of the vector on the sphere, scaled by its largest coordinate; unit length but for rounding."""
    schema = "node long, code binary"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True) if as_query else x / norm
            more = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))
            x = np.concatenate([x, more[:, None]], 1)
            scale = 127 / np.abs(x).max(1, keepdims=True)
            code = np.concatenate([np.rint(x * scale).astype(np.int8).view(np.uint8), (1 / scale).astype("<f4").view(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in code], pa.binary())], schema=wanted)

    return distinct.select("node", "v").mapInArrow(run, schema)


def _decoded(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, :-4].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, -4:]).view("<f4")


def _meet(meetings: DataFrame, sent: int) -> DataFrame:
    """(node, id, near) for pairs that improve node's list, at most ``sent`` from each meeting. meetings: (hub, members)."""
    schema = "node long, id long, near float"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column(1)
            flat = members.flatten()
            ids, least = flat.field("id").to_numpy(), flat.field("least").to_numpy()
            codes, at = flat.field("code").to_pylist(), members.offsets.to_numpy() - members.offsets[0].as_py()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, first = np.unique(ids[s:e], return_index=True)  # a neighbour both ways is one member
                if own.size < 2:
                    continue
                x = _decoded([codes[s + i] for i in first])
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                most = min(sent, own.size - 1)
                best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                value = np.take_along_axis(near, best, 1)
                better = value > least[s + first][:, None]
                rows = np.nonzero(better)[0]
                out.append((own[rows], own[best[better]], value[better]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), f.type) for k, f in enumerate(wanted)], schema=wanted)

    return meetings.mapInArrow(run, schema)


def _lists(pairs: DataFrame, degree: int) -> DataFrame:
    """(node, nbrs [(far, id)] nearest first, least): the ``degree`` best of (node, id, near)."""
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("near")).alias("far"), "id"))), 1, degree)
    listed = pairs.groupBy("node").agg(best.alias("nbrs"))
    return listed.withColumn("least", F.when(F.size("nbrs") < degree, F.lit(-2.0)).otherwise(-F.element_at("nbrs", -1).far).cast("float"))


def _reversed(edges: DataFrame, most: int, *carried: str) -> DataFrame:
    """(hub, id, ...): of the nodes that have hub as a neighbour up to ``most``, by a hash. edges: (node, id, ...)."""
    order = Window.partitionBy("id").orderBy(F.xxhash64("node", "id"), "node")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(F.col("id").alias("hub"), F.col("node").alias("id"), *carried)


def nn_descent(codes: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, sent: int = SENT, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """(node, nbrs) for (node, code)."""
    n = count_rows(codes)
    # Random neighbours: nodes are dealt to buckets of about 64 by a hash, and each asks three other random buckets.
    buckets = max(1, n // 64)
    place = codes.select("node", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(buckets)).alias("bucket"))
    asked = place.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.pmod(F.xxhash64("node", i + seed), F.lit(buckets)))).alias("bucket"))
    ranked = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node"))
    few = place.withColumn("r", ranked).where(F.col("r") <= degree).select("bucket", F.col("node").alias("id"))
    start = asked.join(few, "bucket").where("node <> id").select("node", "id", F.lit(-1.5).cast("float").alias("near")).distinct()
    listed = cut(_lists(start, degree), "start")
    for _ in range(rounds):
        state = cut(codes.join(listed, "node", "left").withColumn("least", F.coalesce("least", F.lit(-2.0).cast("float"))), "state")
        edges = state.where(F.col("nbrs").isNotNull()).select("node", "code", "least", F.explode("nbrs.id").alias("id"))
        forward = edges.select("node", "id").join(state.select(F.col("node").alias("id"), "code", "least"), "id").select(F.col("node").alias("hub"), "id", "code", "least")
        both = forward.unionByName(_reversed(edges, reverse, "code", "least"))
        meetings = both.groupBy("hub").agg(F.collect_list(F.struct("id", "code", "least")).alias("members"))
        found = cut(_meet(meetings, sent), "found")
        old = state.where(F.col("nbrs").isNotNull()).select("node", F.explode("nbrs").alias("x")).select("node", "x.id", (-F.col("x.far")).cast("float").alias("near"))
        # A start neighbour keeps its place until its nearness is known; then the better row is the one that counts.
        pairs = found.unionByName(old).groupBy("node", "id").agg(F.max("near").alias("near"))
        before = listed
        listed = cut(_lists(pairs, degree), "lists")
        moved = listed.join(before.select("node", F.col("nbrs.id").alias("was")), "node", "left").agg(F.sum(F.size(F.array_except(F.col("nbrs.id"), F.coalesce("was", F.array().cast("array<long>"))))).alias("n")).first().n or 0
        if moved <= STILL * n * degree:
            break
    return listed.select("node", "nbrs")


def _expand(frontier: DataFrame) -> DataFrame:
    """(q, ids, near): each frontier row's graph neighbours against its query."""
    schema = "q long, ids array<long>, near array<float>"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes = b.column("ids").to_pylist(), b.column("codes").to_pylist()
            near = [(_decoded(c) @ _decoded([q])[0]) for c, q in zip(codes, b.column("code").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("q"), pa.array(ids, wanted[1].type), pa.array(near, wanted[2].type)], schema=wanted)

    return frontier.select("q", "code", "ids", "codes").mapInArrow(run, schema)


def _merge(grouped: DataFrame, width: int, expanded: int) -> DataFrame:
    """(q, ids, near, done): the beam after a round, with the next nodes to expand in ``next`` and marked done."""
    schema = "q long, ids array<long>, near array<float>, done array<boolean>, next array<long>"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([np.asarray(p["ids"], np.int64) for p in parts])
                near = np.concatenate([np.asarray(p["near"], np.float32) for p in parts])
                done = np.concatenate([np.asarray(p["done"] or [False] * len(p["ids"]), bool) for p in parts])
                order = np.lexsort((~done, ids))  # a node once, its done row first
                order = order[np.concatenate([[True], np.diff(ids[order]) != 0])] if order.size else order
                order = order[np.lexsort((ids[order], -near[order]))][:width]
                ids, near, done = ids[order], near[order], done[order]
                now = np.flatnonzero(~done)[:expanded]
                done[now] = True
                out.append((q, ids, near, done, ids[now]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(wanted)], schema=wanted)

    return grouped.mapInArrow(run, schema)


def greedy_search(queries: DataFrame, codes: DataFrame, graph: DataFrame, reverse: int = REVERSE, width: int = WIDTH, expanded: int = EXPANDED) -> DataFrame:
    """(q, ids, near): the nodes found for each query, nearest first. queries: (q, code); q starts at the node of that number."""
    edges = graph.select("node", F.explode("nbrs.id").alias("id"))
    both = edges.select(F.col("node").alias("hub"), "id").unionByName(_reversed(edges, reverse)).distinct()
    adjacent = both.join(codes.select(F.col("node").alias("id"), "code"), "id").groupBy("hub").agg(F.collect_list("id").alias("ids"), F.collect_list("code").alias("codes"))
    adjacent = cut(adjacent, "adjacent").repartition("hub").persist()
    own = codes.select(F.col("node").alias("q"), F.array("node").alias("ids"))
    beam = queries.join(own, "q").select("q", "ids", F.array(F.lit(2.0)).cast("array<float>").alias("near"), F.array(F.lit(True)).alias("done"), F.col("ids").alias("next"))
    while True:
        beam = cut(beam, "beam")
        frontier = beam.select("q", F.explode("next").alias("hub"))
        if frontier.isEmpty():
            adjacent.unpersist()
            return beam.select("q", "ids", "near")
        met = _expand(frontier.join(queries, "q").join(adjacent, "hub")).withColumn("done", F.lit(None).cast("array<boolean>"))
        parts = met.unionByName(beam.drop("next")).groupBy("q").agg(F.collect_list(F.struct("ids", "near", "done")).alias("parts"))
        beam = _merge(parts, width, expanded)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **settings: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows with is_query(vec_id), the k nearest others found."""
    rows = cut(sound(vectors, id_col, vector_col), "rows")
    keyed = rows.withColumn("key", F.xxhash64("v"))
    distinct = cut(keyed.groupBy("key", "v").agg(F.min("vec_id").alias("node")), "distinct")
    member = cut(keyed.join(distinct, ["key", "v"]).select("vec_id", "node"), "members")
    norm = distinct.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0
    codes = cut(_coded(distinct, norm * (1 + 1e-9), False), "codes")
    asked = member.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "node")
    coded = cut(_coded(distinct.join(asked.select("node").distinct(), "node", "left_semi"), norm, True).withColumnRenamed("node", "q"), "queries")
    descent = {x: settings[x] for x in ("degree", "reverse", "sent", "rounds") if x in settings}
    graph = cut(nn_descent(codes, **descent), "graph")
    beams = greedy_search(coded, codes, graph, **{x: settings[x] for x in ("reverse", "width", "expanded") if x in settings})

    # Exact scores of what was found; then each node stands for its rows with the smallest ids.
    near = beams.select("q", F.explode("ids").alias("node"))
    scored = near.join(distinct.select("node", "v"), "node").join(distinct.select(F.col("node").alias("q"), F.col("v").alias("w")), "q")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = scored.select("q", "node", dot.alias("score"))
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))).where(F.col("place") <= k + 1)
    salted = Window.partitionBy("node", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    stand = member.withColumn("a", F.row_number().over(salted)).where(F.col("a") <= k + 1)
    stand = stand.withColumn("b", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("b") <= k + 1).select("node", "vec_id")
    listed = top.join(stand, "node").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    each = asked.join(lists, F.col("node") == F.col("q")).select("query_id", F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("found"))
    return each.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
