"""Arrow-batched (pandas) UDFs. This module keeps real type hints (no
postponed annotations) because Spark infers the UDF kind from them."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

_TABLE = None


def init_vectors_udf(dim: int, row_offset: int):
    """T1 lookup: the generator's 65536 states are one table built by its
    rule per worker; a vector is a vectorised lookup, normalised with the
    norm summed element by element in order (as the SQL form sums)."""
    from sphaera.functions.initgen import MOD, state_table

    def init(rows: pd.Series) -> pd.Series:
        global _TABLE
        if _TABLE is None:
            _TABLE = state_table()
        flat = (rows.to_numpy(dtype=np.int64)[:, None] + row_offset) * dim + np.arange(dim, dtype=np.int64)[None, :]
        x = _TABLE[flat % MOD].astype(np.float64)
        v = (x / float(MOD) - 0.5) / float(dim)
        n2 = np.zeros(len(v))
        for j in range(dim):
            n2 = n2 + v[:, j] * v[:, j]
        out = (v / np.sqrt(n2)[:, None]).astype(np.float32)
        return pd.Series(list(out))

    return F.pandas_udf(init, "array<float>")


def dots_udf(words, dim: int, role: str):
    """``f`` and ``h`` of triples: the products of the vectors of center words
    ``p`` and noise words ``n``, which the broadcast ``words`` holds, with that
    of the anchor ``a``: the word of that id in ``role`` ``v``, else the vector
    itself. Null where there is no vector."""

    def dots(a: pa.Array, p: pa.Array, n: pa.Array) -> pa.Array:
        w = words.value
        found, rows = [], []
        for r, ids in (("u", p), ("u", n), *([("v", a)] if role == "v" else [])):
            ids, table = ids.fill_null(-1).to_numpy(zero_copy_only=False), w.vec[r]
            there = (ids >= 0) & (ids < len(table))
            at = np.where(there, ids, 0)
            if w.there[r] is not None:
                there &= w.there[r][at]
            found.append(there)
            rows.append(table.take(at, 0).astype(np.float64))
        anchor = rows[2] if role == "v" else a.flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        missing = ~np.logical_and.reduce(found)
        f, h = (pa.array(np.einsum("ij,ij->i", x, anchor), mask=missing) for x in rows[:2])
        return pa.StructArray.from_arrays([f, h], names=["f", "h"])

    return F.arrow_udf(dots, "f double, h double")


def vectors_udf(words, role: str):
    """The vector of each id, null where there is none."""

    def look(ids: pa.Array) -> pa.Array:
        table, there = words.value.vec[role], words.value.there[role]
        x = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        ok = (x >= 0) & (x < len(table))
        at = np.where(ok, x, 0)
        if there is not None:
            ok &= there[at]
        vec = table.take(at, 0)
        ends = np.arange(len(x) + 1, dtype=np.int32) * table.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(vec.ravel()), mask=pa.array(~ok))

    return F.arrow_udf(look, "array<float>")
