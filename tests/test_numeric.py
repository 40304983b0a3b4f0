"""Known answers and invariants of the numeric core."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiverlake.errors import EncodeError, IndexError_, NumericError, SearchError
from quiverlake.functions import codec, marginal
from quiverlake.functions.codec import Calibration, IndexSpec
from quiverlake.functions.random import Stream
from quiverlake.functions.rotation import Rotation, dense_matrix, next_power_of_two, walsh_hadamard


def test_stream_words():
    # The published stream of the generator for two seeds.
    assert [Stream(42).u32() for _ in range(1)] == [360188718]
    s = Stream(42)
    assert [s.u32() for _ in range(8)] == [360188718, 1627707782, 2920764210, 3971525959, 4259765375, 3306005809, 3089192069, 3650758467]
    s = Stream(0x1234567890ABCDEF)
    assert [s.u32() for _ in range(8)] == [4164784269, 692000174, 2390434984, 1948683672, 1805871221, 546424444, 1456522348, 1035992171]
    with pytest.raises(NumericError):
        Stream(math.inf)
    assert Stream(3.9).u32() == Stream(3).u32()


def test_normals():
    x = Stream(1).normals(20000)
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03


def test_codebooks():
    b = marginal.codebook(8, 2)
    assert np.allclose(b.levels, [-0.5048246226, -0.1579220992, 0.1579220992, 0.5048246226], atol=1e-6)
    assert np.allclose(b.boundaries, [-1, -0.3313733609, 0, 0.3313733609, 1], atol=1e-6)
    b = marginal.codebook(64, 3)
    assert np.allclose(b.levels[4:], [0.0304691789, 0.0938322632, 0.1661678589, 0.2639139308], atol=1e-6)
    assert np.allclose(b.boundaries[4:], [0, 0.0621507211, 0.1300000611, 0.2150408949, 1], atol=1e-6)
    for bits in (2, 3, 4):
        assert marginal.distortion(64, bits) * 64 < math.pi * math.sqrt(3) / 2 / 4**bits
    for bad in ((7, 2), (0, 2), (8, 5)):
        with pytest.raises(NumericError):
            marginal.codebook(*bad)


def test_beta():
    assert marginal.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-9)
    assert marginal.beta_cdf(0.5, 0.5, 0.5) == pytest.approx(0.5, abs=1e-9)
    assert marginal.beta_cdf(0.25, 1, 1) == pytest.approx(0.25, abs=1e-12)
    assert marginal.beta_cdf(-1, 2, 2) == 0 and marginal.beta_cdf(2, 2, 2) == 1
    for q in (0.001, 0.05, 0.4, 0.95):
        assert marginal.beta_cdf(marginal.beta_quantile(q, 31.5, 31.5), 31.5, 31.5) == pytest.approx(q, abs=1e-9)
    assert marginal.coord_quantile(0.5, 64) == pytest.approx(0, abs=1e-9)
    assert marginal.integrate(np.vectorize(lambda x: marginal.coord_pdf(float(x), 64)), -1, 1) == pytest.approx(1, abs=1e-9)
    with pytest.raises(NumericError):
        marginal.beta_cdf(0.5, 0, 1)


@pytest.mark.parametrize("dim", [8, 56, 64, 96, 128])
def test_rotations(dim):
    r = Rotation(dim, 5)
    m = r.matrix()
    assert np.allclose(m @ m.T, np.eye(dim), atol=1e-6)
    x = np.random.default_rng(0).normal(size=(7, dim))
    assert np.allclose(r.invert(r.apply(x)), x, atol=1e-5)
    assert np.allclose(r.apply(x), x @ m.T, atol=1e-9)
    assert not np.allclose(m, Rotation(dim, 6).matrix())
    with pytest.raises(NumericError):
        r.apply(x[:, :-1])


def test_transform():
    x = np.random.default_rng(1).normal(size=(3, 16))
    assert np.allclose(walsh_hadamard(walsh_hadamard(x)), 16 * x)
    with pytest.raises(NumericError):
        walsh_hadamard(np.zeros(12))
    assert [next_power_of_two(n) for n in (1, 2, 3, 64, 65)] == [1, 2, 4, 64, 128]
    q, r = np.linalg.qr(Stream(2).normals(24, 24))
    assert np.allclose(np.abs(dense_matrix(24, 2)), np.abs(q), atol=1e-6)


@given(st.integers(2, 4), st.integers(1, 6), st.integers(1, 12), st.randoms(use_true_random=False))
@settings(max_examples=40, deadline=None)
def test_pack(bits, rows, eights, rnd):
    codes = np.array([[rnd.randrange(1 << bits) for _ in range(8 * eights)] for _ in range(rows)], np.uint8)
    packed = codec.pack(codes, bits)
    assert packed.shape == (rows, eights * bits)
    assert (codec.unpack(packed, bits, 8 * eights) == codes).all()
    number = int.from_bytes(packed[0].tobytes(), "little")
    assert [number >> bits * i & (1 << bits) - 1 for i in range(8 * eights)] == codes[0].tolist()


def test_pack_errors():
    with pytest.raises(NumericError) as e:
        codec.pack(np.array([[4]], np.uint8), 2)
    assert e.value.code == "INVALID_CODE"
    with pytest.raises(NumericError):
        codec.unpack(np.zeros((1, 3), np.uint8), 2, 8)


def test_quantize_edges():
    inner = marginal.codebook(64, 2).inner
    assert codec.quantize(np.array([-2.0, 2.0, inner[0], np.nextafter(inner[0], -1)]), 64, 2).tolist() == [0, 3, 1, 0]


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_unbiased(bits):
    """The estimate of a product is right on average over queries, and its error what the distortion says."""
    rng = np.random.default_rng(bits)
    spec = IndexSpec(64, bits)
    v, q = rng.normal(size=(200, 64)), rng.normal(size=(2000, 64))
    e = codec.encode(v, spec)
    framed, _ = codec.query_frame(q, spec)
    error = (framed @ (e.scale[:, None] * marginal.codebook(64, bits).levels[e.codes]).T - q @ v.T) / e.norm
    d = 64 * marginal.distortion(64, bits)
    assert abs(error.mean()) < 0.02 and error.std() == pytest.approx(math.sqrt(d / (1 - d)), rel=0.1)


def test_calibration():
    m = 1000
    columns = np.stack([np.linspace(-1, 1, m), np.full(m, 0.25), np.linspace(-0.1, 0.1, m), (np.arange(m) * 2654435761 % m) / m - 0.5] * 2, 1).astype(np.float32)
    s = np.sort(columns, 0)
    c = Calibration.from_quantiles(s[math.floor(0.05 * (m - 1))].astype(float), s[math.floor(0.95 * (m - 1))].astype(float))
    lo, hi = marginal.coord_quantile(0.05, 8), marginal.coord_quantile(0.95, 8)
    assert c.shift[1] == 0 and c.scale[1] == 1
    for i in (0, 2, 3):
        assert (s[49, i] + c.shift[i]) * c.scale[i] == pytest.approx(lo, abs=1e-5)
        assert (s[949, i] + c.shift[i]) * c.scale[i] == pytest.approx(hi, abs=1e-5)
    x = np.random.default_rng(0).normal(size=(5, 64))
    plain, same = codec.encode(x, IndexSpec(64)), codec.encode(x, IndexSpec(64, calibration=Calibration.identity(64)))
    assert (plain.codes == same.codes).all() and np.allclose(plain.scale, same.scale)


def test_degenerate():
    rng = np.random.default_rng(3)
    u = rng.normal(size=16)
    spec = IndexSpec(16)
    near = spec.rotation.apply((u + rng.normal(size=(256, 16)) * 1e-4) / np.linalg.norm(u))
    s = np.sort(near, 0)
    spec = IndexSpec(16, calibration=Calibration.from_quantiles(s[12], s[242]))
    assert codec.encode(-u[None], spec).degenerate.all()


def test_refusals():
    with pytest.raises(EncodeError) as e:
        codec.encode(np.zeros((1, 8)), IndexSpec(8))
    assert e.value.code == "ZERO_VECTOR"
    for bad in (np.full((1, 8), np.nan), np.ones((1, 7))):
        with pytest.raises(EncodeError) as e:
            codec.encode(bad, IndexSpec(8))
        assert e.value.code == "INVALID_LENGTH"
    for args, code in (((7,), "INVALID_DIM"), ((8, 5), "INVALID_BITS"), ((8, 4, "cosine", math.nan), "INVALID_SEED")):
        with pytest.raises(IndexError_) as e:
            IndexSpec(*args)
        assert e.value.code == code
    with pytest.raises(SearchError):
        IndexSpec(8, 4, "manhattan")


def test_coarse_projection_is_near():
    rng = np.random.default_rng(4)
    spec = IndexSpec(64)
    e, (framed, _) = codec.encode(rng.normal(size=(50, 64)), spec), codec.query_frame(rng.normal(size=(3, 64)), spec)
    levels = marginal.codebook(64, 4).levels
    assert np.corrcoef(codec.coarse_projection(framed, e.codes, levels)[:, 0], (levels[e.codes] @ framed.T)[:, 0])[0, 1] > 0.999
