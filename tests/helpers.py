"""What several test modules share."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"


def canonical(frame):
    """Rows as sorted tuples of text, floats at six digits."""
    import numpy as np
    import pandas as pd

    def one(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6g}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False, name=None))
