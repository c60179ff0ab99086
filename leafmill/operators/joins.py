"""How tables of the store meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_key(rows: DataFrame) -> DataFrame:
    """rows for a join that moves both sides by key and never broadcasts, so that no table passes through the driver.

    Spark judges tables by the size of their files; in a store's, texts that many rows share are kept once, and millions of rows seem small.
    """
    return rows.hint("merge")
