"""Errors that carry a code, by the part of the library that raises them."""

from __future__ import annotations


class QuiverError(Exception):
    codes: frozenset[str] = frozenset()

    def __init__(self, code: str, message: str):
        assert code in self.codes, code
        self.code = code
        super().__init__(f"{code}: {message}")


def _kind(name: str, codes: str) -> type[QuiverError]:
    return type(name, (QuiverError,), {"codes": frozenset(codes.split()), "__module__": __name__})


# The codes that callers match on.
IndexError_ = _kind("IndexError_", "INVALID_DIM INVALID_BITS INVALID_SEED INVALID_LENGTH INVALID_VECTOR INVALID_INDEX INVALID_NLIST INVALID_NPROBE EMPTY WRONG_KIND")
IdMapError = _kind("IdMapError", "INVALID_LENGTH INVALID_VECTOR COUNT_MISMATCH INVALID_ID_TYPE DUPLICATE_ID UNKNOWN_ID EMPTY WRONG_KIND")
EncodeError = _kind("EncodeError", "INVALID_DIM INVALID_BITS INVALID_LENGTH ZERO_VECTOR MISMATCH DEGENERATE")
SearchError = _kind("SearchError", "INVALID_K INVALID_DIM INVALID_LENGTH MISMATCH ZERO_QUERY INVALID_MASK INVALID_SLOT INVALID_METRIC")
DeserializeError = _kind("DeserializeError", "TOO_SHORT BAD_MAGIC BAD_VERSION BAD_KIND BAD_METRIC BAD_BITS BAD_DIM BAD_SEED BAD_LENGTH BAD_ID BAD_CALIBRATION BAD_IVF")
FilterError = _kind("FilterError", "INVALID_CONDITION")
NumericError = _kind("NumericError", "INVALID_ARGUMENT INVALID_DIM INVALID_LENGTH INVALID_K INVALID_CODE INVALID_SEED NO_CONVERGENCE")
