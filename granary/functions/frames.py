"""Small helpers for pandas frames that go back to Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """The frame with text columns of plain Python objects: a joined text column may else be in pieces."""
    text = {c: "object" for c in df.columns if isinstance(df[c].dtype, pd.StringDtype)}
    return df.astype(text) if text else df


def emit(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The frame, if it has rows: an empty text column does not always become one Arrow array."""
    if len(df):
        yield plain(df)
