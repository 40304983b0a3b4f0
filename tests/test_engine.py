"""Search, filters, cells, indexes, storage and streams on small inputs."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.errors import DeserializeError, EncodeError, FilterError, IdMapError, IndexError_, NumericError, SearchError
from quiverlake.functions.codec import IndexSpec
from quiverlake.functions.random import Stream
from quiverlake.operators.encode import encode
from quiverlake.operators.filters import compile_filter
from quiverlake.operators.indexes import Collection, IdIndex, PositionalIndex, queries_frame
from quiverlake.operators.ivf import search_cells
from quiverlake.operators.search import exact, recall_at_k, search, two_stage
from quiverlake.operators.training import assign, kmeans, train_cells
from quiverlake.sources import binary
from quiverlake.sources.vectors import anisotropic, mixture, read_vecs

AXES = [[8.0 * (i // 2 == k) for i in range(8)] for k in range(4)]


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, vector array<double>")


def normal(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim))


def lists(found, id_col="id"):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r[id_col])
    return out


def asks(spark, x):
    return queries_frame(spark, x)


@pytest.mark.parametrize("metric", ["dot", "cosine", "euclidean"])
def test_search_is_brute_force_over_codes(spark, metric):
    from quiverlake.functions import codec, marginal

    x, q, spec = normal(60, 64, 1) * (1 + np.arange(60) % 7 * 0.3)[:, None], normal(5, 64, 2), IndexSpec(64, 3, metric)
    e, (framed, _) = codec.encode(x, spec), codec.query_frame(q, spec)
    s = marginal.codebook(64, 3).levels[e.codes] @ framed.T
    keys = codec.rank_key(metric, codec.value(metric, s, e.scale[:, None].astype(float), e.norm[:, None].astype(float), np.linalg.norm(q, axis=1)))
    want = {i: np.lexsort((np.arange(60), -keys[:, i]))[:8].tolist() for i in range(5)}
    codes = encode(frame(spark, x).repartition(3), spec)
    assert lists(search(codes, asks(spark, q), spec, 8)) == want
    assert lists(search(codes, asks(spark, q), spec, 8, block=2)) == want
    assert search(codes, asks(spark, q), spec, 100).count() == 300


@pytest.mark.parametrize(("dim", "bits", "floor"), [(64, 4, 0.88), (64, 3, 0.75), (64, 2, 0.55), (96, 4, 0.86)])
def test_recall(spark, dim, bits, floor):
    v, q = frame(spark, normal(500, dim, 424242 + dim)), asks(spark, normal(40, dim, 9 + dim))
    spec = IndexSpec(dim, bits)
    assert recall_at_k(search(encode(v, spec), q, spec, 10), exact(v, q, 10), 10).first().recall >= floor


def test_ties_go_to_the_smaller_id(spark):
    v = frame(spark, [AXES[0]] * 6 + [AXES[1]], [9, 4, 7, 1, 3, 8, 2]).repartition(3)
    spec = IndexSpec(8)
    assert lists(search(encode(v, spec), asks(spark, [AXES[0]]), spec, 4)) == {0: [1, 3, 4, 7]}
    assert lists(exact(v, asks(spark, [AXES[0]]), 4)) == {0: [1, 3, 4, 7]}
    assert lists(two_stage(encode(v, spec), asks(spark, [AXES[0]]), spec, 4)) == {0: [1, 3, 4, 7]}


def test_mask_and_empty(spark):
    spec = IndexSpec(8)
    codes, q = encode(frame(spark, AXES), spec), asks(spark, [AXES[0]])
    assert lists(search(codes, q, spec, 3, where=F.col("id") > 1)) and search(codes, q, spec, 3, where=F.lit(False)).count() == 0
    assert search(codes, q.where("false"), spec, 3).count() == 0
    assert search(codes.where("false"), q, spec, 3).count() == 0
    assert encode(frame(spark, AXES).where("false"), spec).count() == 0


def test_search_refusals(spark):
    spec = IndexSpec(8)
    codes, q = encode(frame(spark, AXES), spec), asks(spark, [AXES[0]])
    for k in (0, -1, 1.5, True):
        with pytest.raises(SearchError) as e:
            search(codes, q, spec, k)
        assert e.value.code == "INVALID_K"
    for bad, code in (([[0.0] * 8], "ZERO_QUERY"), ([[1.0] * 7], "INVALID_LENGTH"), ([[float("nan")] * 8], "INVALID_LENGTH")):
        with pytest.raises(SearchError) as e:
            search(codes, asks(spark, bad), spec, 1)
        assert e.value.code == code


def test_two_stage_overlaps(spark):
    v, q, spec = frame(spark, normal(500, 64, 10)), asks(spark, normal(10, 64, 11)), IndexSpec(64)
    a, b = lists(search(encode(v, spec), q, spec, 10)), lists(two_stage(encode(v, spec), q, spec, 10))
    assert np.mean([len(set(a[i]) & set(b[i])) / 10 for i in a]) > 0.8


# ---- filters

PAYLOADS = [(1, "docs", 2021, 1.0), (2, "blog", 2023, None), (3, "docs", 2024, float("nan")), (4, "docs", 2019, 4.0), (5, None, None, None)]


@pytest.mark.parametrize(
    ("filter_", "want"),
    [
        ({"must": [{"key": "tag", "match": "docs"}]}, {1, 3, 4}),
        ({"must_not": [{"key": "tag", "match": "docs"}]}, {2, 5}),
        ({"must": [{"key": "year", "range": {"gte": 2022}}]}, {2, 3}),
        ({"must": [{"key": "year", "range": {"gt": 2019, "lte": 2023}}]}, {1, 2}),
        ({"must": [{"key": "year", "range": {"gte": 2021, "lte": 2021}}]}, {1}),
        ({"must_not": [{"key": "year", "range": {"lt": 2022}}]}, {2, 3, 5}),
        ({"must": [{"hasId": [1, 3, 4]}], "must_not": [{"key": "tag", "match": "blog"}]}, {1, 3, 4}),
        ({"must": [{"key": "x", "range": {"gt": 0}}]}, {1, 4}),
        ({"must_not": [{"key": "x", "match": float("nan")}]}, {1, 2, 3, 4, 5}),
        ({"must": [{"key": "year", "match": "2021"}]}, set()),
        ({"must": [{"key": "year", "match": True}]}, set()),
        ({"must": [{"key": "tag", "range": {"gt": 0}}]}, set()),
        ({"must": [{"key": "gone", "match": 1}]}, set()),
        ({}, {1, 2, 3, 4, 5}),
        ({"must": [{"should": [{"key": "year", "match": 2021}, {"key": "year", "match": 2019}]}]}, {1, 4}),
        ({"must": [{"key": "tag", "match": "docs"}], "should": [{"key": "year", "match": 2024}, {"key": "x", "match": 4}], "must_not": [{"hasId": [4]}]}, {3}),
        ({"must": [{"key": "year", "range": {"gt": 1, "gte": 5, "lt": 3}}]}, set()),
    ],
)
def test_filters(spark, filter_, want):
    rows = spark.createDataFrame(PAYLOADS, "id long, tag string, year int, x double")
    assert {r.id for r in rows.where(compile_filter(filter_, rows.schema)).collect()} == want
    nested = rows.select("id", F.when(F.col("id") < 5, F.struct("tag", "year", "x")).alias("payload"))
    assert {r.id for r in nested.where(compile_filter(filter_, nested.schema, payload="payload")).collect()} == want


@pytest.mark.parametrize("bad", [{"hasId": []}, {"key": "year", "range": {}}, {"key": "y", "range": {"gt": 10, "lt": 5}}, {"key": "y", "range": {"gte": 10, "lt": 10}}, {"key": "y", "range": {"gt": 10, "lte": 10}}, {"bogus": 1}, 7])
def test_filter_refusals(spark, bad):
    rows = spark.createDataFrame(PAYLOADS, "id long, tag string, year int, x double")
    with pytest.raises(FilterError) as e:
        compile_filter({"must": [bad]}, rows.schema)
    assert e.value.code == "INVALID_CONDITION"


# ---- cells


def test_kmeans():
    x = np.concatenate([normal(30, 8, s) * 0.1 + 10 * np.eye(8)[s] for s in range(4)])
    centres, cell = kmeans(x, 4, Stream(1), False)
    assert len({tuple(cell[30 * s : 30 * s + 30]) for s in range(4)}) == 4 and np.bincount(cell).tolist() == [30] * 4
    again, _ = kmeans(x, 4, Stream(1), False)
    assert (centres == again).all()
    centres, cell = kmeans(np.ones((5, 8)), 3, Stream(1), True)
    assert np.bincount(cell, minlength=3).min() >= 1
    for k in (1, 6):
        with pytest.raises(NumericError):
            kmeans(np.ones((5, 8)), k, Stream(1), True)


def test_cells_search(spark):
    v = mixture(spark, 8, 25, 32, 10.0, 2)
    q = mixture(spark, 8, 1, 32, 10.0, 2).withColumnRenamed("id", "qid")
    spec = IndexSpec(32)
    centroids = train_cells(v, spec, 8, "id")
    codes = encode(assign(v, centroids, spec), spec)
    flat = lists(search(codes, q, spec, 10))
    assert lists(search_cells(codes, q, centroids, spec, 10, 8)) == flat
    some = lists(search_cells(codes, q, centroids, spec, 10, 3))
    assert np.mean([len(set(flat[i]) & set(some[i])) / 10 for i in flat]) > 0.8
    for bad in (0, 9, 1.5):
        with pytest.raises(IndexError_) as e:
            search_cells(codes, q, centroids, spec, 10, bad)
        assert e.value.code == "INVALID_NPROBE"


# ---- indexes


def test_positional(spark):
    index = PositionalIndex(spark, 8)
    with pytest.raises(IndexError_) as e:
        index.search(asks(spark, [AXES[0]]), 1)
    assert e.value.code == "EMPTY"
    index.add(frame(spark, AXES))
    for i, v in enumerate(AXES):
        assert lists(index.search(asks(spark, [v]), 1), "slot") == {0: [i]}
    index.add_one(AXES[0])
    assert index.size == 5 and lists(index.search(asks(spark, [AXES[0]]), 2), "slot") == {0: [0, 4]}
    index.swap_remove(1)
    assert index.size == 4 and lists(index.search(asks(spark, [AXES[0]]), 2), "slot") == {0: [0, 1]}
    for bad in (-1, 4, 1.5):
        with pytest.raises(IndexError_):
            index.swap_remove(bad)
    with pytest.raises(IndexError_) as e:
        index.add(frame(spark, [AXES[0], [0.0] * 8]))
    assert e.value.code == "INVALID_VECTOR" and index.size == 4
    again = PositionalIndex.from_bytes(spark, index.to_bytes())
    assert lists(again.search(asks(spark, AXES), 2), "slot") == lists(index.search(asks(spark, AXES), 2), "slot")
    with pytest.raises(IdMapError):
        IdIndex.from_bytes(spark, index.to_bytes())
    index.clear()
    assert index.size == 0


def test_slots_are_dense(spark):
    index = PositionalIndex(spark, 8)
    x = normal(200, 8, 3)
    index.add(frame(spark, x, range(1000, 1200)).repartition(7))
    index.add(frame(spark, x[:50]))
    assert [r.slot for r in index.codes.select("slot").orderBy("slot").collect()] == list(range(250))
    assert lists(index.search(asks(spark, [x[17]]), 1), "slot") == {0: [17]}


@pytest.mark.parametrize(("kind", "ids"), [("integer", [100, 200, 300, 400]), ("string", ["a", "b", "1", "ü"]), ("bigint", [10**20, 2, 3, 4]), ("number", [0.5, 2, 3, 4])])
def test_ids(spark, kind, ids):
    import decimal

    cast = {"integer": int, "string": str, "bigint": decimal.Decimal, "number": float}[kind]
    sql = {"integer": "long", "string": "string", "bigint": "decimal(38,0)", "number": "double"}[kind]
    points = spark.createDataFrame([(cast(i), v) for i, v in zip(ids, AXES, strict=True)], f"id {sql}, vector array<double>")
    index = IdIndex(spark, 8, id_kind=kind)
    index.add_with_ids(points)
    assert lists(index.search(asks(spark, AXES), 1)) == {i: [cast(x)] for i, x in enumerate(ids)}
    with pytest.raises(IdMapError) as e:
        index.add_with_ids(points.limit(1))
    assert e.value.code == "DUPLICATE_ID"
    again = IdIndex.from_bytes(spark, index.to_bytes())
    assert lists(again.search(asks(spark, AXES), 1)) == {i: [cast(x)] for i, x in enumerate(ids)}
    assert index.has(cast(ids[0]))
    index.remove(cast(ids[0]))
    assert not index.has(cast(ids[0])) and index.size == 3
    with pytest.raises(IdMapError) as e:
        index.remove(cast(ids[0]))
    assert e.value.code == "UNKNOWN_ID"


def test_id_refusals(spark):
    index = IdIndex(spark, 8)
    for rows, code in (([(1, AXES[0]), (1, AXES[1])], "DUPLICATE_ID"), ([(None, AXES[0])], "INVALID_ID_TYPE"), ([(1, AXES[0][:7])], "INVALID_LENGTH"), ([(1, [0.0] * 8)], "INVALID_VECTOR")):
        with pytest.raises(IdMapError) as e:
            index.add_with_ids(spark.createDataFrame(rows, "id long, vector array<double>"))
        assert e.value.code == code and index.size == 0
    with pytest.raises(IdMapError) as e:
        index.add_with_ids(spark.createDataFrame([("x", AXES[0])], "id string, vector array<double>"))
    assert e.value.code == "INVALID_ID_TYPE"


def test_collection(spark):
    schema = "id long, vector array<double>, payload struct<tag: string, year: int>"
    rows = [(1, AXES[0], ("docs", 2021)), (2, AXES[1], ("blog", 2023)), (3, AXES[2], ("docs", 2024)), (4, AXES[3], ("docs", 2019))]
    points = Collection(spark, 8)
    assert points.search_points(asks(spark, [AXES[0]])).count() == 0
    points.upsert(spark.createDataFrame(rows, schema))
    first = points.search_points(asks(spark, [AXES[2]]), limit=2).orderBy("rank").first()
    assert first.id == 3 and first.payload.year == 2024
    assert set(lists(points.search_points(asks(spark, [AXES[0]]), {"must": [{"key": "year", "range": {"gte": 2022}}]}))[0]) == {2, 3}
    assert points.search_points(asks(spark, [AXES[0]]), {"must": [{"key": "tag", "match": "none"}]}).count() == 0
    points.upsert(spark.createDataFrame([(2, AXES[2], ("updated", 2030))], schema))
    assert points.size == 4 and points.get(2) == {"id": 2, "payload": {"tag": "updated", "year": 2030}}
    assert set(lists(points.search_points(asks(spark, [AXES[2]]), limit=2))[0]) == {2, 3}
    before = lists(points.search_points(asks(spark, AXES)))
    for bad in ([(2, AXES[2], None), (5, [0.0] * 8, None)], [(2, AXES[2], None), (2, AXES[2], None)], [(2, AXES[2][:7], None)]):
        with pytest.raises(IdMapError):
            points.upsert(spark.createDataFrame(bad, schema))
        assert lists(points.search_points(asks(spark, AXES))) == before
    points.delete(2)
    points.delete([3, 99])
    assert points.size == 2 and points.get(3) is None
    points.upsert(spark.createDataFrame(rows, schema).select("id", "vector").where("id = 1"))
    assert points.get(1) == {"id": 1, "payload": None}


def test_calibration_gate_and_store(spark):
    x = normal(1200, 64, 1) * 0.2 ** (np.arange(64) / 64)
    small, large = PositionalIndex(spark, 64, 2, calibrate=True), PositionalIndex(spark, 64, 2, calibrate=True, cells=4, probes=4)
    small.add(frame(spark, x[:100]))
    small.add(frame(spark, x))
    large.add(frame(spark, x))
    assert small.spec.calibration is None and large.spec.calibration is not None and large.centroids is not None
    path = f"/tmp/quiverlake-test-{uuid.uuid4().hex}"
    large.save(path)
    again = PositionalIndex.load(spark, path)
    q = asks(spark, x[:5])
    assert lists(again.search(q, 5, probes=4), "slot") == lists(large.search(q, 5), "slot")
    other = PositionalIndex.from_bytes(spark, large.to_bytes())
    assert lists(other.search(q, 5), "slot") == lists(large.search(q, 5), "slot")


def test_binary_tampering():
    spec = IndexSpec(8, 2)
    good = binary.dumps(binary.Payload(spec, np.arange(16, dtype=np.uint8).reshape(2, 8) % 4, np.array([1.5, 1.75]), np.array([3.5, 4.0]), [1.0, "x"]))
    p = binary.loads(good)
    assert p.ids == [1.0, "x"] and p.codes.tolist() == (np.arange(16).reshape(2, 8) % 4).tolist() and p.scales.tolist() == [1.5, 1.75]

    def put(at, *values):
        return good[:at] + bytes(values) + good[at + len(values) :]

    cases = {"TOO_SHORT": good[:10], "BAD_MAGIC": put(0, 0), "BAD_VERSION": put(4, 9), "BAD_KIND": put(5, 7), "BAD_METRIC": put(6, 7), "BAD_BITS": put(7, 5), "BAD_DIM": put(8, 7), "BAD_LENGTH": good + b"x", "BAD_CALIBRATION": put(44, 2), "BAD_IVF": put(45, 2), "BAD_ID": put(46, 9)}
    for code, data in cases.items():
        with pytest.raises(DeserializeError) as e:
            binary.loads(data)
        assert e.value.code == code
    with pytest.raises(DeserializeError):
        binary.loads(put(12, 255, 255, 255, 255))
    for n in range(len(good)):
        with pytest.raises(DeserializeError):
            binary.loads(good[:n])


# ---- sources, streams


def test_vecs(spark, tmp_path):
    x = normal(10, 12, 1).astype("<f4")
    raw = b"".join(np.int32(12).tobytes() + r.tobytes() for r in x)
    (tmp_path / "a.fvecs").write_bytes(raw)
    got = read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("at").collect()
    assert np.allclose([r.vector for r in got], x)
    assert anisotropic(spark, 100, 16, 0.3, 1).collect() == anisotropic(spark, 100, 16, 0.3, 1).repartition(3).orderBy("id").collect()


def test_stream(spark, tmp_path):
    from quiverlake.streaming.encode import append_codes, rejected_stream, upsert_stream

    v = frame(spark, AXES + [[0.0] * 8])
    v.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    append_codes(stream, IndexSpec(8), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    spec = IndexSpec(8)
    want = sorted(encode(frame(spark, AXES), spec).collect())
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == want
    q = rejected_stream(stream, spec).writeStream.format("memory").queryName("rejected").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.reason for r in spark.table("rejected").collect()] == ["ZERO_VECTOR"]
    points = Collection(spark, 8)
    upsert_stream(stream.where("id < 4"), points, str(tmp_path / "c2")).awaitTermination()
    assert points.size == 4


def test_encode_refusals(spark):
    from quiverlake.operators.encode import validate

    for rows, code in (([(1, [0.0] * 8)], "ZERO_VECTOR"), ([(1, None)], "INVALID_LENGTH"), ([(1, [1.0] * 7)], "INVALID_LENGTH"), ([(1, [float("inf")] * 8)], "INVALID_LENGTH")):
        with pytest.raises(EncodeError) as e:
            validate(spark.createDataFrame(rows, "id long, vector array<double>"), 8)
        assert e.value.code == code


def test_zero_vectors_take_no_hit(spark):
    rows = [(i, [0.0, 0.0] if i == 3 else [1.0, float(i)]) for i in range(6)]
    q = queries_frame(spark, [[1.0, 2.0]])
    found = exact(spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1), q, 1, "cosine").collect()
    assert [r.id for r in found] == [2]


def test_saved_collection(spark, tmp_path):
    points = Collection(spark, 8, id_kind="string")
    points.upsert(spark.createDataFrame([(f"p{i}", [float(i), 1.0, 2.0, 0.5] * 2, (i,)) for i in range(5)], "id string, vector array<double>, payload struct<n: int>"))
    points.save(str(tmp_path / "saved"))
    again = Collection.load(spark, str(tmp_path / "saved"))
    assert again.id_kind == "string" and again.get("p3") == {"id": "p3", "payload": {"n": 3}}
    again.clear()
    assert again.get("p3") is None and again.payloads is None


def test_cell_queries_are_checked(spark):
    index = PositionalIndex(spark, 8, cells=2, probes=1)
    index.add(spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3), 0.5] * 2) for i in range(40)], "id long, vector array<double>"))
    with pytest.raises(SearchError) as e:
        index.search(queries_frame(spark, [[0.0] * 8]), 3).collect()
    assert e.value.code == "ZERO_QUERY"


def _points(spark, rows, payload):
    """rows: (id, payload values); each point's vector follows from its id."""
    made = [(i, [float((i * 7 + j * 3) % 11 - 5.5) for j in range(16)], p) for i, p in rows]
    return spark.createDataFrame(made, f"id long, vector array<double>, payload {payload}")


def test_payloads_of_any_shape(spark, tmp_path):
    points = Collection(spark, 16)
    points.upsert(_points(spark, [(1, (2020,)), (2, (2021,))], "struct<year: int>"))
    points.upsert(_points(spark, [(3, ("a", (1,))), (4, (None, None))], "struct<tag: string, more: struct<x: int>>"))
    points.upsert(_points(spark, [(5, ("2021", (2.5, True)))], "struct<year: string, more: struct<x: double, y: boolean>>"))
    points.upsert(_points(spark, [(6, (True,))], "struct<year: boolean>"))

    def check(held):
        q = queries_frame(spark, [[1.0] * 16])

        def ids(*must):
            return sorted(r.id for r in held.search_points(q, {"must": list(must)}).collect())

        assert ids({"key": "year", "match": 2021}) == [2]
        assert ids({"key": "year", "match": "2021"}) == [5]
        assert ids({"key": "year", "match": True}) == [6]
        assert ids({"key": "year", "range": {"gte": 2020}}) == [1, 2]
        assert ids({"key": "tag", "match": "a"}) == [3]
        assert held.get(2)["payload"] == {"year": 2021}
        assert held.get(3)["payload"] == {"tag": "a", "more": {"x": 1}}
        assert held.get(4)["payload"] == {}
        assert held.get(5)["payload"] == {"year": "2021", "more": {"x": 2.5, "y": True}}

    check(points)
    points.save(str(tmp_path / "points"))
    check(Collection.load(spark, str(tmp_path / "points")))


def test_failed_upsert_changes_nothing(spark, monkeypatch):
    from quiverlake.sources import tables

    points = Collection(spark, 16)
    points.upsert(_points(spark, [(i, (i,)) for i in range(5)], "struct<year: int>"))
    before = sorted(map(tuple, points.points().select("id", "slot", "codes", "payload.year").collect()))
    whole = tables.materialize

    for at in ("codes", "payloads", "batch"):

        def failing(df, name="table", partition_by=None, at=at):
            if name == at:
                raise OSError("disk")
            return whole(df, name, partition_by)

        monkeypatch.setattr(tables, "materialize", failing)
        with pytest.raises(OSError):
            points.upsert(_points(spark, [(1, (99,)), (7, (7,))], "struct<year: int>"))
        monkeypatch.setattr(tables, "materialize", whole)
        assert sorted(map(tuple, points.points().select("id", "slot", "codes", "payload.year").collect())) == before
        assert points.size == 5 and points.get(1)["payload"] == {"year": 1}


def test_appends_write_few_rows_again(spark, monkeypatch):
    from quiverlake.sources import tables

    written, whole = [], tables.materialize

    def counted(df, name="table", partition_by=None):
        out = whole(df, name, partition_by)
        if name == "codes":
            written.append(out.count())
        return out

    monkeypatch.setattr(tables, "materialize", counted)
    one = PositionalIndex(spark, 16)
    for i in range(9):
        one.add_one([float((i * 7 + j * 3) % 11 - 5.5) for j in range(16)])
    assert one.size == 9 and len(one.parts) <= 4 and sum(written) <= 9 * 4
    at_once = PositionalIndex(spark, 16)
    at_once.add(_points(spark, [(i, (i,)) for i in range(9)], "struct<year: int>"))
    rows = [sorted(map(tuple, x.codes.select("slot", "codes", "scale").collect())) for x in (one, at_once)]
    assert rows[0] == rows[1]


def test_has_id_is_strict_about_types(spark):
    points = Collection(spark, 16)
    points.upsert(_points(spark, [(i, (i,)) for i in range(3)], "struct<year: int>"))
    q = queries_frame(spark, [[1.0] * 16])

    def ids(*wanted):
        return sorted(r.id for r in points.search_points(q, {"must": [{"hasId": list(wanted)}]}).collect())

    assert ids(1, 2.0) == [1, 2]
    assert ids("1", "abc", True, 1.5, 2**70) == []
    assert sorted(r.id for r in points.search_points(q, {"must_not": [{"hasId": ["1", 0]}]}).collect()) == [1, 2]
