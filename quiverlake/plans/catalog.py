"""The registered queries of the vector engine, with the SQL that each must agree with.

Queries are the rows of ``embeddings`` whose vec_id is divisible by 20, against all rows. Row j is scaled by
1 + (j % 7) * 0.3, so that the three metrics rank differently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, columns
from ..functions.codec import METRICS, Calibration, IndexSpec
from ..functions.marginal import BITS, codebook, coord_quantile
from ..functions.rotation import Rotation
from ..operators import training
from ..operators.encode import encode
from ..operators.filters import compile_filter
from ..operators.indexes import Collection, PositionalIndex
from ..operators.ivf import probes_of, search_cells
from ..operators.search import compression, exact, pool_size, recall_at_k, search, two_stage
from ..sources import tables

DIM, DENSE, K = 64, 56, 10
Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql if isinstance(sql, str) else sql()
        return f

    return add


# ---- inputs


def vectors(spark: SparkSession, sf_dir: str, dim: int = DIM, scaled: bool = True) -> DataFrame:
    """(id, vector double)"""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.slice(F.col("embedding").cast("array<double>"), 1, dim)
    v = F.transform(v, lambda x: x * (1 + (F.col("vec_id") % 7) * 0.3)) if scaled else v
    return e.select(F.col("vec_id").alias("id"), v.alias("vector"))


def asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vector")


def rounded(found: DataFrame, *more: str) -> DataFrame:
    return found.select("qid", "rank", F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 5).alias("score"), *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload columns by id: documents, and labels where there are any."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return d.join(labels, "id", "left")


def spec(bits: int = 4, metric: str = "cosine", dim: int = DIM, calibration: Calibration | None = None) -> IndexSpec:
    return IndexSpec(dim, bits, metric, 0, calibration)


# ---- the same in SQL


def _list(x) -> str:
    return "([" + ", ".join(repr(float(v)) for v in np.asarray(x).ravel()) + "]::DOUBLE[])"


def _table(m: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in m) + "]::DOUBLE[][]"


def v_sql(dim: int = DIM) -> str:
    return f"v AS (SELECT vec_id AS id, list_transform(embedding[1:{dim}]::DOUBLE[], lambda x: x * (1 + (vec_id % 7) * 0.3)) AS v FROM embeddings)"


@lru_cache
def _matrix(dim: int) -> np.ndarray:
    return Rotation(dim, 0).matrix()


def turned_sql(dim: int = DIM) -> str:
    q = f"(SELECT {_table(_matrix(dim))} AS q)"
    return f"{v_sql(dim)}, t AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n, list_transform(q, lambda row: list_dot_product(row, v)) AS r FROM v, {q})"


def codes_sql(bits: int, dim: int = DIM, calibrated: str | None = None) -> str:
    """c(id, v, n, r, code, rec, scale, norm). calibrated: a CTE of (shift, factor), lists."""
    book = codebook(dim, bits)
    shifted = "x / n" if calibrated is None else "(x / n + shift[i]) * factor[i]"
    back = f"{_list(book.levels)}[code[i] + 1]"
    level = back if calibrated is None else f"{back} / factor[i] - shift[i]"
    return f"""{turned_sql(dim)}{"" if calibrated is None else ", " + calibrated},
k AS (SELECT t.*{"" if calibrated is None else ", shift, factor"}, list_transform(r, lambda x, i: len(list_filter({_list(book.inner)}, lambda b: {shifted} >= b))) AS code FROM t{"" if calibrated is None else ", cal"}),
c AS (SELECT *, (n * n / list_dot_product(r, list_transform(code, lambda z, i: {level})))::FLOAT::DOUBLE AS scale, n::FLOAT::DOUBLE AS norm,
      list_transform(code, lambda z: {_list(book.levels)}[z + 1]) AS rec FROM k)"""


VALUE = {
    "dot": "c.scale * s",
    "cosine": "c.scale * s / (q.n * c.norm)",
    "euclidean": "q.n * q.n + c.norm * c.norm - 2 * c.scale * s",
}


def top_sql(metric: str, where: str = "true", k: int = K, s: str = "list_dot_product(c.rec, q.r)", join: str = "", more: str = "") -> str:
    """SELECT of the k best of c for each q among t; s: the projection."""
    order = "ASC" if metric == "euclidean" else "DESC"
    return f"""
, p AS (SELECT q.id AS qid, c.id AS vec_id, {VALUE[metric].replace(" s", f" ({s})")} AS value{more} FROM c JOIN t q ON q.id % 20 = 0 {join} WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value {order}, vec_id) AS rank FROM p)
SELECT qid, rank, vec_id, round(value::FLOAT::DOUBLE, 5) AS score FROM ranked WHERE rank <= {k}"""


# ---- exact search, norms, rotations

EXACT = {"dot": "list_dot_product(a.v, b.v)", "cosine": "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"}
EXACT["euclidean"] = "list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v)"


def _exact_sql(metric: str) -> str:
    order = "ASC" if metric == "euclidean" else "DESC"
    return f"""WITH {v_sql()}, p AS (SELECT a.id AS qid, b.id AS vec_id, {EXACT[metric]} AS value FROM v a, v b WHERE a.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(value, 12) {order}, vec_id) AS rank FROM p)
SELECT qid, rank, vec_id, round(value, 6) + 0.0 AS score FROM r WHERE rank <= {K}"""


for _m in METRICS:

    @query(f"exact_knn_{_m}", _exact_sql(_m))
    def _exact(spark: SparkSession, sf_dir: str, metric: str = _m) -> DataFrame:
        v = vectors(spark, sf_dir)
        found = exact(v, asked(v), K, metric)
        return found.select("qid", "rank", F.col("id").alias("vec_id"), (F.round(F.abs("score") if metric == "euclidean" else F.col("score"), 6) + 0.0).alias("score"))


@query("vec_norms", f"WITH {v_sql()} SELECT id AS vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM v")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(columns.norm(F.col("vector")), 6).alias("norm"))


@query("normalize_sum", f"WITH {v_sql()}, n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v) SELECT id AS vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) + 0.0 AS total FROM n")
def normalize_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("n", columns.norm(F.col("vector")))
    return v.select(F.col("id").alias("vec_id"), (F.round(columns.total(columns.normalized(F.col("vector"), F.col("n"))), 6) + 0.0).alias("total"))


def _coordinates(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("vec_id"), F.posexplode("rotated").alias("coord", "x")).select("vec_id", "coord", (F.round("x", 6) + 0.0).alias("x"))


def _turned_sql(dim: int) -> str:
    return f"WITH {turned_sql(dim)}, u AS (SELECT id, unnest(range(len(r))) AS coord, unnest(r) AS x FROM t) SELECT id AS vec_id, coord, round(x, 6) + 0.0 AS x FROM u"


@query("rotate_hadamard", lambda: _turned_sql(DIM))
def rotate_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(training.rotated(vectors(spark, sf_dir), spec(), unit=False))


@query("rotate_dense56", lambda: _turned_sql(DENSE))
def rotate_dense56(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(training.rotated(vectors(spark, sf_dir, DENSE), spec(dim=DENSE), unit=False))


@query("rotate_inverse", f"WITH {v_sql()}, u AS (SELECT id, unnest(range(len(v))) AS coord, unnest(v) AS x FROM v) SELECT id AS vec_id, coord, round(x, 6) + 0.0 AS x FROM u")
def rotate_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = training.rotated(vectors(spark, sf_dir), spec(), unit=False).withColumnRenamed("rotated", "vector")
    return _coordinates(training.rotated(there, spec(), inverse=True, unit=False))


@query("rotate_catalyst", lambda: _turned_sql(DIM))
def rotate_catalyst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation as Catalyst expressions over a literal matrix."""
    return _coordinates(vectors(spark, sf_dir).select("id", columns.product(_matrix(DIM), F.col("vector")).alias("rotated")))


# ---- codes


def _unpacked(codes: DataFrame, s: IndexSpec) -> DataFrame:
    """(id, code) for each coordinate of packed codes."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(s.dim - 1)), lambda i: _code_at(i, s.bits))
    return codes.select("id", F.explode(raw).alias("code"))


def _code_at(i, bits: int):
    """Code i of the packed bytes: two neighbouring bytes, shifted and masked."""
    byte = lambda n: F.coalesce(F.conv(F.substring(F.hex("codes"), n * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(0))
    at = (i * bits / 8).cast("int")
    two = byte(at) + byte(at + 1) * 256
    return F.call_function("shiftright", two, (i * bits) % 8).bitwiseAND(F.lit((1 << bits) - 1))


for _b in BITS:

    @query(f"codes_{_b}bit", f"WITH {codes_sql(_b)}, u AS (SELECT unnest(code) AS code FROM c) SELECT code, count(*) AS n FROM u GROUP BY code")
    def _codes(spark: SparkSession, sf_dir: str, bits: int = _b) -> DataFrame:
        s = spec(bits)
        return _unpacked(encode(vectors(spark, sf_dir), s), s).groupBy(F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("encode_scale_norm", f"WITH {codes_sql(4)} SELECT id AS vec_id, round(scale, 4) AS scale, round(norm, 4) AS norm FROM c")
def encode_scale_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(vectors(spark, sf_dir), spec()).select(F.col("id").alias("vec_id"), *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("scale", "norm")))


@query("quantize_catalyst", f"WITH {codes_sql(3)}, u AS (SELECT id, unnest(range(len(code))) AS coord, unnest(code) AS code FROM c) SELECT id AS vec_id, coord, code FROM u")
def quantize_catalyst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the rotated unit vectors as Catalyst expressions."""
    turned = training.rotated(vectors(spark, sf_dir), spec(3))
    inner = codebook(DIM, 3).inner
    return turned.select(F.col("id").alias("vec_id"), F.posexplode(F.transform("rotated", lambda x: columns.cell_of(x, inner))).alias("coord", "code"))


@query("pack_roundtrip", f"WITH {codes_sql(3)}, u AS (SELECT id, unnest(range(len(code))) AS coord, unnest(code) AS code FROM c) SELECT id AS vec_id, sum(code * (coord + 1))::BIGINT AS weighed FROM u GROUP BY id")
def pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec(3)
    raw = F.transform(F.sequence(F.lit(0), F.lit(s.dim - 1)), lambda i: _code_at(i, 3) * (i + 1))
    return encode(vectors(spark, sf_dir), s).select(F.col("id").alias("vec_id"), F.aggregate(raw, F.lit(0).cast("long"), lambda t, x: t + x).alias("weighed"))


# ---- search over codes

for _b in BITS:
    for _m in METRICS:

        @query(f"knn_quant_{_b}_{_m}", f"WITH {codes_sql(_b)}{top_sql(_m)}")
        def _knn(spark: SparkSession, sf_dir: str, bits: int = _b, metric: str = _m) -> DataFrame:
            v = vectors(spark, sf_dir)
            return rounded(search(encode(v, spec(bits, metric)), asked(v), spec(bits, metric), K))


@query("knn_dense56", f"WITH {codes_sql(4, DENSE)}{top_sql('cosine')}")
def knn_dense56(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, DENSE)
    return rounded(search(encode(v, spec(dim=DENSE)), asked(v), spec(dim=DENSE), K))


@query("knn_single", f"WITH {codes_sql(4)}{top_sql('cosine', 'q.id = 0')}")
def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(search(encode(v, spec()), asked(v).where("qid = 0"), spec(), K))


@query("knn_masked", f"WITH {codes_sql(4)}{top_sql('cosine', 'c.id % 2 = 0')}")
def knn_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(search(encode(v, spec()), asked(v), spec(), K, where=F.col("id") % 2 == 0))


@query("knn_hasid", f"WITH {codes_sql(4)}{top_sql('dot', 'c.id IN (1, 5, 9, 77, 123)')}")
def knn_hasid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    codes = encode(v, spec())
    return rounded(search(codes, asked(v), spec(), K, "dot", compile_filter({"must": [{"hasId": [1, 5, 9, 77, 123]}]}, codes.schema)))


@query("knn_subset", f"WITH {codes_sql(4)}{top_sql('cosine', 'c.id IN (SELECT doc_id FROM labels WHERE quality = 1)')}")
def knn_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only given slots: a semi-join before the scan."""
    v = vectors(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    return rounded(search(encode(v, spec()).join(good, "id", "left_semi"), asked(v), spec(), K))


@query("knn_threshold_k_over_n", f"WITH {codes_sql(2)}{top_sql('euclidean', 'c.id < 7', 50)}")
def knn_threshold_k_over_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k above the number of rows returns them all."""
    v = vectors(spark, sf_dir)
    return rounded(search(encode(v, spec(2)), asked(v), spec(2), 50, "euclidean", F.col("id") < 7))


# ---- collection filters

FILTERS = {
    "match": ({"must": [{"key": "lang", "match": "en"}]}, "lang = 'en'"),
    "match_number": ({"must": [{"key": "quality", "match": 1}]}, "coalesce(quality = 1, false)"),
    "match_type_strict": ({"must_not": [{"key": "n_chars", "match": "1000"}]}, "true"),
    "range": ({"must": [{"key": "n_chars", "range": {"gte": 500, "lt": 2000}}]}, "n_chars >= 500 AND n_chars < 2000"),
    "should": ({"should": [{"key": "lang", "match": "de"}, {"key": "source", "match": "src3"}]}, "lang = 'de' OR source = 'src3'"),
    "must_not": ({"must_not": [{"key": "toxic", "match": 0}]}, "NOT coalesce(toxic = 0, false)"),
    "nested": (
        {"must": [{"should": [{"key": "lang", "match": "fr"}, {"must": [{"key": "lang", "match": "en"}, {"key": "n_chars", "range": {"gt": 3000}}]}]}], "must_not": [{"hasId": [40, 60]}]},
        "(lang = 'fr' OR (lang = 'en' AND n_chars > 3000)) AND c.id NOT IN (40, 60)",
    ),
    "missing_key": ({"must_not": [{"key": "colour", "match": "red"}]}, "true"),
}
PAYLOAD_SQL = "LEFT JOIN (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) pay ON pay.doc_id = c.id"


def collection(spark: SparkSession, sf_dir: str) -> Collection:
    v = vectors(spark, sf_dir)
    payload = F.struct("lang", "source", "n_chars", "quality", "toxic")
    out = Collection(spark, DIM, 4, "cosine", 0)
    out.upsert(v.join(documents(spark, sf_dir), "id", "left").select("id", "vector", F.when(F.col("lang").isNotNull(), payload).alias("payload")))
    return out


for _n, (_f, _w) in FILTERS.items():

    @query(f"collection_{_n}", f"WITH {codes_sql(4)}{top_sql('cosine', _w, join=PAYLOAD_SQL)}")
    def _filtered(spark: SparkSession, sf_dir: str, filter_: dict = _f) -> DataFrame:
        v = vectors(spark, sf_dir)
        rows = encode(v, spec()).join(documents(spark, sf_dir), "id", "left")
        return rounded(search(rows, asked(v), spec(), K, where=compile_filter(filter_, rows.schema)))


@query("collection_payload")
def collection_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their payload, joined after the search."""
    found = collection(spark, sf_dir).search_points(asked(vectors(spark, sf_dir)))
    return rounded(found.select("*", F.col("payload.lang").alias("lang"), F.col("payload.n_chars").alias("n_chars")), "lang", "n_chars")


_sql["collection_payload"] = (
    f"WITH {codes_sql(4)}" + top_sql("cosine").replace("SELECT qid, rank", ", hits AS (SELECT qid, rank") + ") SELECT hits.*, lang, n_chars FROM hits LEFT JOIN documents d ON d.doc_id = hits.vec_id"
)

# ---- cells


def first_cells(spark: SparkSession, sf_dir: str, n: int = 16) -> np.ndarray:
    """Fixed centroids: the unit vectors of the first n ids."""
    rows = vectors(spark, sf_dir).where(F.col("id") < n).orderBy("id").collect()
    x = np.array([r.vector for r in rows])
    return x / np.sqrt((x**2).sum(1, keepdims=True))


CELLS_SQL = "cen AS (SELECT id AS cell, list_transform(v, lambda x: x / n) AS u FROM t WHERE id < 16)"
PROBES_SQL = "pr AS (SELECT qid, cell, place FROM (SELECT q.id AS qid, cell, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, u) DESC, cell) - 1 AS place FROM t q, cen WHERE q.id % 20 = 0) WHERE place < 4)"
ASSIGN_SQL = "own AS (SELECT id, cell FROM (SELECT t.id, cell, row_number() OVER (PARTITION BY t.id ORDER BY list_dot_product(t.v, u) DESC, cell) AS o FROM t, cen) WHERE o = 1)"


@query("ivf_assign", f"WITH {turned_sql()}, {CELLS_SQL}, {ASSIGN_SQL} SELECT id AS vec_id, cell FROM own")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.assign(vectors(spark, sf_dir), first_cells(spark, sf_dir), spec()).select(F.col("id").alias("vec_id"), F.col("cell").cast("long").alias("cell"))


@query("ivf_probe", f"WITH {turned_sql()}, {CELLS_SQL}, {PROBES_SQL} SELECT qid, cell, place FROM pr")
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes_of(asked(vectors(spark, sf_dir)), first_cells(spark, sf_dir), spec(), 4).select("qid", F.col("cell").cast("long").alias("cell"), F.col("place").cast("long").alias("place"))


def _cells(spark: SparkSession, sf_dir: str, probes: int) -> DataFrame:
    v, centroids = vectors(spark, sf_dir), first_cells(spark, sf_dir)
    codes = encode(training.assign(v, centroids, spec()), spec())
    return rounded(search_cells(codes, asked(v), centroids, spec(), K, probes))


@query("ivf_search", f"WITH {codes_sql(4)}, {CELLS_SQL}, {PROBES_SQL}, {ASSIGN_SQL}{top_sql('cosine', join='JOIN own ON own.id = c.id JOIN pr ON pr.qid = q.id AND pr.cell = own.cell')}")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, 4)


@query("ivf_full_probe", f"WITH {codes_sql(4)}{top_sql('cosine')}")
def ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, 16)


@query("ivf_kmeans_search")
def ivf_kmeans_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells trained by k-means."""
    v = vectors(spark, sf_dir)
    index = PositionalIndex(spark, DIM, 4, "cosine", 0, cells=8, probes=4)
    index.add(v)
    return rounded(index.search(asked(v), K).withColumnRenamed("slot", "id"))


# ---- calibration


def _calibration_sql() -> str:
    lo, hi = coord_quantile(codec.P_LOW, DIM), coord_quantile(codec.P_HIGH, DIM)
    return f"""x AS (SELECT coord, x, row_number() OVER (PARTITION BY coord ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY coord) AS m
      FROM (SELECT unnest(range(len(r))) AS coord, unnest(list_transform(r, lambda y: (y / n)::FLOAT)) AS x FROM t)),
e AS (SELECT coord, max(x) FILTER (WHERE place = floor({codec.P_LOW} * (m - 1)))::DOUBLE AS low, max(x) FILTER (WHERE place = floor({codec.P_HIGH} * (m - 1)))::DOUBLE AS high FROM x GROUP BY coord),
f AS (SELECT coord, low, high, CASE WHEN high - low < {codec.FLAT} THEN 1.0 ELSE {hi - lo!r} / (high - low) END AS factor FROM e),
g AS (SELECT coord, low, high, factor, CASE WHEN high - low < {codec.FLAT} THEN 0.0 ELSE {lo!r} / factor - low END AS shift FROM f),
cal AS (SELECT list(shift::FLOAT::DOUBLE ORDER BY coord) AS shift, list(factor::FLOAT::DOUBLE ORDER BY coord) AS factor FROM g)"""


@query("calibration_fit", lambda: f"WITH {turned_sql()}, {_calibration_sql()} SELECT coord, round(shift, 6) + 0.0 AS shift, round(factor, 5) AS scale FROM g")
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = training.fit_calibration(vectors(spark, sf_dir), spec())
    rows = [(i, round(s, 6) + 0.0, round(f, 5)) for i, (s, f) in enumerate(zip(fitted.shift, fitted.scale, strict=True))]
    return spark.createDataFrame(rows, "coord long, shift double, scale double")


_sql["calibration_fit"] = _sql["calibration_fit"].replace("round(shift, 6)", "round(shift::FLOAT::DOUBLE, 6)").replace("round(factor, 5)", "round(factor::FLOAT::DOUBLE, 5)")


@query(
    "knn_calibrated",
    lambda: f"WITH {codes_sql(4, calibrated=_calibration_sql())}"
    + top_sql("cosine", s="list_dot_product(c.rec, list_transform(q.r, lambda x, i: x / c.factor[i])) - list_dot_product(q.r, c.shift)"),
)
def knn_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    s = spec(calibration=training.fit_calibration(v, spec()))
    return rounded(search(encode(v, s, strict=False), asked(v), s, K))


# ---- mutations, storage

REPLACED = "id % 10 = 3"


def _changed_sql(where: str, bits: int = 4) -> str:
    return f"WITH {codes_sql(bits)}{top_sql('cosine', where)}"


@query("upsert_replace", f"WITH {codes_sql(4)}{top_sql('cosine')}".replace("list_transform(embedding[1:64]::DOUBLE[], lambda x:", "list_transform(CASE WHEN vec_id % 10 = 3 THEN list_reverse(embedding[1:64]::DOUBLE[]) ELSE embedding[1:64]::DOUBLE[] END, lambda x:"))
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth point is replaced by its vector reversed."""
    v = vectors(spark, sf_dir)
    points = Collection(spark, DIM, 4, "cosine", 0)
    points.upsert(v)
    points.upsert(v.where(REPLACED).withColumn("vector", F.reverse("vector")))
    now = v.withColumn("vector", F.when(F.expr(REPLACED), F.reverse("vector")).otherwise(F.col("vector")))
    return rounded(points.search_points(asked(now), limit=K))


@query("delete_ids", _changed_sql("c.id NOT IN (2, 3, 5, 7, 11, 100)"))
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    points = Collection(spark, DIM, 4, "cosine", 0)
    points.upsert(v)
    points.delete([2, 3, 5, 7, 11, 100, 10**12])
    return rounded(points.search_points(asked(v), limit=K))


@query("swap_remove", "SELECT CASE WHEN vec_id = (SELECT max(vec_id) FROM embeddings) THEN 4 ELSE vec_id END AS slot, vec_id FROM embeddings WHERE vec_id <> 4")
def swap_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots after slot 4 is removed: the last row takes it. Rows are told by their norms' order."""
    index = PositionalIndex(spark, DIM, 4, "cosine", 0)
    v = vectors(spark, sf_dir)
    index.add(v)
    index.swap_remove(4)
    coded = encode(v, spec()).select(F.col("id").alias("vec_id"), "codes", "scale", "norm")
    return index.codes.join(coded, ["codes", "scale", "norm"]).select("slot", "vec_id")


@query("store_roundtrip", _changed_sql("true", 3))
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as Parquet, read again, searched."""
    import uuid

    v = vectors(spark, sf_dir)
    index = PositionalIndex(spark, DIM, 3, "cosine", 0)
    index.add(v)
    path = f"{tables.shared_dir(spark)}/quiverlake/{uuid.uuid4().hex}/index"
    index.save(path)
    return rounded(PositionalIndex.load(spark, path).search(asked(v), K).withColumnRenamed("slot", "id"))


@query("binary_roundtrip", _changed_sql("true", 2))
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the binary form and back, searched."""
    v = vectors(spark, sf_dir)
    index = PositionalIndex(spark, DIM, 2, "cosine", 0)
    index.add(v)
    return rounded(PositionalIndex.from_bytes(spark, index.to_bytes()).search(asked(v), K).withColumnRenamed("slot", "id"))


# ---- two stages, reports


def _two_stage_sql() -> str:
    levels = _list(codebook(DIM, 4).levels)
    top = min(255, 65535 // DIM)
    return f"""WITH {codes_sql(4)},
q8 AS (SELECT id, n, r, list_transform(r, lambda x: list_transform({levels}, lambda y: (x * y)::FLOAT::DOUBLE)) AS lut FROM t WHERE id % 20 = 0),
q9 AS (SELECT *, list_min(flatten(lut)) AS lo, list_max(flatten(lut)) - list_min(flatten(lut)) AS span FROM q8),
q10 AS (SELECT id, n, r, lo, span, list_transform(lut, lambda row: list_transform(row, lambda y: greatest(0, least({top}, floor((y - lo) * ({top} / span) + 0.5))))) AS small FROM q9),
pool AS (SELECT * FROM (SELECT q.id AS qid, c.id AS vec_id, row_number() OVER (PARTITION BY q.id ORDER BY
         c.scale * (list_sum(list_transform(c.code, lambda z, i: q.small[i][z + 1])) * (q.span / {top}) + {DIM} * q.lo) / (q.n * c.norm) DESC, c.id) AS o FROM c, q10 q) WHERE o <= {pool_size(K)})
{top_sql('cosine', join='JOIN pool ON pool.qid = q.id AND pool.vec_id = c.id')}"""


@query("fastscan_two_stage", _two_stage_sql)
def fastscan_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(two_stage(encode(v, spec()), asked(v), spec(), K))


def _recall_sql() -> str:
    found = f"WITH {codes_sql(4)}{top_sql('cosine')}"
    return f"SELECT round(avg(r), 6) AS recall FROM (SELECT a.qid, count(b.vec_id) / count(*) AS r FROM ({_exact_sql('cosine')}) a LEFT JOIN ({found}) b ON a.qid = b.qid AND a.vec_id = b.vec_id GROUP BY a.qid)"


@query("recall_at_k", _recall_sql)
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    found = search(encode(v, spec()), asked(v), spec(), K)
    return recall_at_k(found, exact(v, asked(v), K), K).select(F.round("recall", 6).alias("recall"))


@query("compression", "SELECT bits, round(256 / (64 * bits / 8 + 8), 6) AS ratio, (64 * bits / 8 + 8)::BIGINT AS bytes_per_vector FROM (VALUES (2), (3), (4)) b(bits)")
def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {b: compression(spec(b)) for b in BITS}
    return spark.createDataFrame([(b, round(m["ratio"], 6), int(m["bytes_per_vector"])) for b, m in made.items()], "bits int, ratio double, bytes_per_vector long")


@query("stream_encode", f"WITH {codes_sql(4)} SELECT id AS vec_id, round(scale, 4) AS scale, round(norm, 4) AS norm FROM c")
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch encoder over a file stream, appended to a table."""
    import uuid

    from ..streaming.encode import append_codes

    at = f"{tables.shared_dir(spark)}/quiverlake/{uuid.uuid4().hex}"
    batch = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    batch.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{at}/in")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + (F.col("vec_id") % 7) * 0.3))
    append_codes(stream.select("vec_id", v.alias("vector")), spec(), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("vec_id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("scale", "norm")))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

