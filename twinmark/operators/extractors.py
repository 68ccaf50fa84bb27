"""Pair features in user Python code (X1): Arrow batches in, a declared number of named columns out.

A registered extractor is one struct-valued Arrow UDF, so a task hands whole batches to Python once however
many columns come back.  What every extractor needs is done here: null rows, the declared width, and that each
value is finite.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import features as X

NULLS = ("null", "zero", "pass")


def checked(values, width: int, rows: int, name: str) -> list[np.ndarray]:
    """``values`` as ``width`` float columns of ``rows`` values; wrong widths, lengths and values that are not finite raise."""
    out = [np.asarray(v, np.float64) for v in values]
    if len(out) != width or any(v.shape != (rows,) for v in out):
        raise ValueError(f"extractor {name!r} returned columns of {[v.shape for v in out]}; declared are {width} of {rows} rows")
    bad = [i for i, v in enumerate(out) if not np.isfinite(v).all()]
    if bad:
        raise ValueError(f"extractor {name!r} returned values that are not finite in columns {bad}")
    return out


@dataclass(frozen=True)
class PythonExtractor:
    """``function`` gets an Arrow array for each input column, and returns one sequence of numbers for each output.

    ``nulls`` says what a row with a null input gives: null outputs, zeros, or whatever ``function`` makes
    of it ("pass"); with the first two ``function`` never sees such a row.
    """

    name: str
    outputs: tuple[str, ...]
    function: Callable[..., Sequence]
    inputs: tuple[str, ...] = ("s1", "s2")
    nulls: str = "null"

    def __post_init__(self):
        if not self.outputs or len(set(self.outputs)) != len(self.outputs):
            raise ValueError("outputs need distinct names, one at least")
        if self.nulls not in NULLS:
            raise ValueError(f"nulls is one of {NULLS}")

    def batch(self, *arrays: pa.Array) -> pa.Array:
        """One batch: a struct array of the outputs."""
        rows, width = len(arrays[0]), len(self.outputs)
        seen = np.ones(rows, bool)
        if self.nulls != "pass":
            for a in arrays:
                seen &= a.is_valid().to_numpy(zero_copy_only=False)
        some = arrays if seen.all() else [a.filter(pa.array(seen)) for a in arrays]
        n = int(seen.sum())
        values = checked(self.function(*some), width, n, self.name) if n else [np.zeros(0)] * width
        columns = []
        for v in values:
            whole = np.zeros(rows)
            whole[seen] = v
            columns.append(pa.array(whole, mask=~seen if self.nulls == "null" else None))
        return pa.StructArray.from_arrays(columns, list(self.outputs))

    def columns(self) -> list[Column]:
        """The outputs as columns; Spark runs the UDF once for all of them."""
        udf = _struct_udf(self.batch, len(self.inputs), self.outputs)
        value = udf(*[F.col(c) for c in self.inputs])
        return [value[x].alias(x) for x in self.outputs]


def _struct_udf(batch, width: int, outputs):
    kind = "struct<" + ", ".join(f"`{x}`: double" for x in outputs) + ">"
    if width == 1:
        @F.arrow_udf(kind)
        def one(a: pa.Array) -> pa.Array:
            return batch(a)
        return one
    if width == 2:
        @F.arrow_udf(kind)
        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return batch(a, b)
        return two
    raise ValueError("an extractor reads one or two columns")


def register_python(name: str, outputs: Sequence[str], function: Callable[..., Sequence], inputs: Sequence[str] = ("s1", "s2"), nulls: str = "null") -> X.Extractor:
    """Add a Python extractor to the registry; ``pair_features`` and ``extract`` then know it by name."""
    made = PythonExtractor(name, tuple(outputs), function, tuple(inputs), nulls)
    return X.register(name, len(made.outputs), made.columns)


def extract(pairs, keys: list[str], names: Sequence[str]):
    """The named extractors' columns beside the keys, straight from the pair table (no tokens are made)."""
    unknown = [n for n in names if n not in X.REGISTRY]
    if unknown:
        raise KeyError(f"unknown features: {unknown}")
    return pairs.select(*keys, *[c for n in names for c in X.REGISTRY[n].columns()])


# ------------------------------------------------------------------------- a feature of this kind

def jaro(a: str, b: str) -> float:
    """Jaro similarity: shared characters within half the longer string, and how many of them are out of order."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                first.append(x)
                break
    m = len(first)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(first, (y for y, t in zip(b, taken) if t))) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_columns(a: pa.Array, b: pa.Array) -> list[np.ndarray]:
    """Jaro, and Jaro-Winkler: a tenth of the rest for each of at most four equal first characters, above 0.7."""
    pairs = list(zip(a.to_pylist(), b.to_pylist()))
    plain = np.array([jaro(x, y) for x, y in pairs])
    same = np.array([next((i for i, (p, q) in enumerate(zip(x[:4], y[:4])) if p != q), min(4, len(x), len(y))) for x, y in pairs], float)
    return [plain, np.where(plain > 0.7, plain + same * 0.1 * (1 - plain), plain)]


register_python("Jaro", ("jaro", "jaro_winkler"), jaro_columns)
