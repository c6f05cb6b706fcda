"""Metrics and index parameters, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

#: Scores of padded places: the largest float32 for L2, its negative for inner product.
FLOAT32_MAX = 3.4028234663852886e38


class Metric(Enum):
    """L2: Euclidean distance, ascending. INNER_PRODUCT: dot product, descending."""

    L2 = "L2"
    INNER_PRODUCT = "InnerProduct"

    @classmethod
    def of(cls, name: str | Metric | None) -> Metric:
        """The metric of a stored name; unknown and null names raise ValueError."""
        if isinstance(name, Metric):
            return name
        for m in cls:
            if name == m.value:
                return m
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(m.value for m in cls)}")

    @property
    def pad_score(self) -> float:
        return FLOAT32_MAX if self is Metric.L2 else -FLOAT32_MAX

    def natural(self, key: float) -> float:
        return max(key, 0.0) ** 0.5 if self is Metric.L2 else -key


def check_dim(dim: int) -> int:
    if isinstance(dim, bool) or not isinstance(dim, int) or dim < 1:
        raise ValueError(f"dim must be a positive integer, not {dim!r}")
    return dim


def check_k(k: int) -> int:
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")
    return k


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 0x5EED

    def __post_init__(self) -> None:
        if self.m < 2:
            raise ValueError("m must be at least 2")
        if self.ef_construction < 1 or self.ef_search < 1:
            raise ValueError("ef_construction and ef_search must be at least 1")

    @property
    def m_max0(self) -> int:
        """Most links of a node on the bottom layer."""
        return 2 * self.m


@dataclass(frozen=True)
class PqParams:
    m: int = 8
    nbits: int = 8
    train_iters: int = 25
    train_sample: int = 50_000
    seed: int = 0x5EED

    def __post_init__(self) -> None:
        if self.m < 1:
            raise ValueError("m must be at least 1")
        if not 1 <= self.nbits <= 8:
            raise ValueError("nbits must be in 1..8")
        if self.train_iters < 0 or self.train_sample < 0:
            raise ValueError("train_iters and train_sample must not be negative")

    @property
    def codes(self) -> int:
        return 1 << self.nbits

    def sub_dim(self, dim: int) -> int:
        if check_dim(dim) % self.m:
            raise ValueError(f"dim {dim} isn't divisible by m {self.m}")
        return dim // self.m

    def sample_rows(self, rows: int) -> int:
        """Training rows: all where train_sample is 0 or not less than the rows."""
        if rows < self.codes:
            raise ValueError(f"training needs at least {self.codes} rows, not {rows}")
        return rows if self.train_sample == 0 else min(max(self.train_sample, self.codes), rows)
