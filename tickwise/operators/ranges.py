"""Integer ranges as rows, without ever holding a long range in one array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def explode_range(
    df: DataFrame, low: str, high: str, out: str, keep: Sequence[str], spread: Sequence[str] | None = None
) -> DataFrame:
    """One row per integer from ``low`` to ``high`` (columns, both inclusive, ``low <= high``).

    The range is cut into blocks first and a block is expanded at a time. ``spread`` names key
    columns by which, together with the block, rows are redistributed in between: for inputs in
    which single ranges make up much of the output.
    """
    block = F.explode(F.expr(f"sequence({low} div {BLOCK}, {high} div {BLOCK})"))
    needed = list(dict.fromkeys([*keep, low, high]))
    blocks = df.select(*needed, block.alias("_block"))
    if spread:
        blocks = blocks.repartition(*spread, "_block")
    inside = F.expr(
        f"sequence(greatest({low}, _block * {BLOCK}), least({high}, (_block + 1) * {BLOCK} - 1))"
    )
    return blocks.select(*keep, F.explode(inside).alias(out))
