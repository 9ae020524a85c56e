"""Fingerprints of prompts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def prompt_hash(text: Column) -> Column:
    """Identifies a prompt without storing it: ``h = h * 33 + unit`` over its UTF-16 units,
    from 5381, modulo 2**32, as plain hex.

    All texts of a batch are one array of units.  33 has an inverse modulo 2**32,
    so one product with its powers and a sum for each text give all
    fingerprints; unsigned arithmetic wraps around as wanted.  Runs on Arrow
    batches, as a row-wise fold over characters is several times slower.  The
    function is local, so it travels with the query and the executors need not
    have this package.
    """
    modulus, most = 1 << 32, 1 << 20
    inverse = pow(33, -1, modulus)

    def of_units(parts: list[bytes]) -> list[str]:
        units = np.frombuffer(b"".join(parts), dtype="<u2").astype(np.uint32)
        sizes = np.array([len(p) // 2 for p in parts])
        starts = np.cumsum(sizes) - sizes
        powers = np.cumprod(np.r_[1, np.full(max(len(units) - 1, 0), inverse)].astype(np.uint32), dtype=np.uint32)
        sums, filled = np.zeros(len(parts), np.uint32), sizes > 0
        if filled.any():
            sums[filled] = np.add.reduceat(units * powers[: len(units)], starts[filled], dtype=np.uint32)
        return [
            f"{(5381 * pow(33, n, modulus) + (s * pow(33, at + n - 1, modulus) if n else 0)) % modulus:x}"
            for s, n, at in zip(sums.tolist(), sizes.tolist(), starts.tolist())
        ]

    def hashed(texts: pd.Series) -> pd.Series:
        out: list[str] = []
        parts: list[bytes] = []
        size, given = 0, texts.notna()
        for value in texts[given]:
            parts.append(value.encode("utf-16-le", "surrogatepass"))
            size += len(parts[-1])
            if size > most:
                out, parts, size = out + of_units(parts), [], 0
        out += of_units(parts)
        result = pd.Series([None] * len(texts), dtype=object)
        result[given.to_numpy()] = out
        return result

    return F.pandas_udf(hashed, "string")(text)


def audit_id(ts: Column, key: Column) -> Column:
    """Base-36 milliseconds and four base-36 digits that depend on the row only."""
    digits = F.lower(F.conv(F.substring(F.md5(key), 1, 12), 16, 36))
    return F.concat(F.lower(F.conv(F.unix_millis(ts).cast("string"), 10, 36)), F.right(F.concat(F.lit("0000"), digits), F.lit(4)))
