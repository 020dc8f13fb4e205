"""Episode labels: 1 is failure, 0 is success. All adapters run on the held (aligned) rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalars import to_number
from tickwise.operators.align import fill_both
from tickwise.operators.lookup import join_facts, with_group_facts
from tickwise.operators.ordered import HotKeys, order_value, quoted
from tickwise.schema import DATASET, LABEL, SEQ, TIME, spec_for


def label_bool_topic(
    df: DataFrame, failure_columns: Sequence[str], success_column: str | None, keys: Sequence[str], time: str,
    out: str = LABEL, hot: HotKeys | None = None,
) -> DataFrame:
    """Label from a flag topic, filled forward and then backward.

    The first failure column present in the schema wins; failing that, the success column
    with inverted polarity; failing that, every row is a success. A flag that never has a
    value counts as "not above one half".
    """
    present = [c for c in failure_columns if c in df.columns]
    inverted = not present and success_column in df.columns
    if not present and not inverted:
        return df.withColumn(out, F.lit(0.0))
    source = present[0] if present else success_column
    flag = df.withColumn("_flag", to_number(quoted(source)))
    filled = fill_both(flag, keys, [time], {"_flag": "_flag"}, hot)
    above = F.when(F.col("_flag") > 0.5, 1.0).otherwise(0.0)
    return filled.withColumn(out, F.lit(1.0) - above if inverted else above).select(*map(quoted, df.columns), out)


def label_metadata(
    df: DataFrame, catalog: DataFrame, on: str, successful: str, out: str = LABEL, hot: HotKeys | None = None
) -> DataFrame:
    """Label from one boolean per sequence; absent means success."""
    flags = catalog.select(on, F.col(successful).cast("boolean").alias("_ok"))
    failed = F.when(F.coalesce(F.col("_ok"), F.lit(True)), 0.0).otherwise(1.0)
    return join_facts(df, flags, [on], "left", hot).select(*map(quoted, df.columns), failed.alias(out))


def _reward_facts(order: Sequence[str], reward: str, terminal: str | None) -> dict[str, Column]:
    """Reward at the last row, and at the last row whose terminal flag is set (null if none is)."""
    value, at = F.coalesce(to_number(quoted(reward)), F.lit(0.0)), order_value(order)
    flagged = F.lit(False)
    if terminal is not None:
        flagged = F.coalesce(to_number(quoted(terminal)), F.lit(0.0)) != 0.0
    return {"_last": F.max_by(value, at), "_ended": F.max_by(value, F.when(flagged, at))}


def final_reward(
    df: DataFrame, seq: str, order: Sequence[str], reward: str, terminal: str | None
) -> DataFrame:
    """Reward at the last row whose terminal flag is set, else at the last row; missing is 0."""
    facts = _reward_facts(order, reward, terminal)
    ends = df.groupBy(seq).agg(*[e.alias(o) for o, e in facts.items()])
    return ends.select(seq, F.coalesce("_ended", "_last").alias("final_reward"))


def label_terminal(
    df: DataFrame, seq: str, order: Sequence[str], reward: str | None, terminal: str | None, out: str = LABEL,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Episode label from the terminal reward: above 0 is success; no reward column is success."""
    if reward is None or reward not in df.columns:
        return df.withColumn(out, F.lit(0.0))
    has_terminal = terminal if terminal in df.columns else None
    ends = with_group_facts(df, [seq], _reward_facts(order, reward, has_terminal), hot)
    failed = F.when(F.coalesce("_ended", "_last") > 0, 0.0).otherwise(1.0)
    return ends.select(*map(quoted, df.columns), failed.alias(out))


def sequence_label(df: DataFrame, keys: Sequence[str], label: str, out: str = "seq_label") -> DataFrame:
    """One row per sequence: 1 if any tick is a failure."""
    return df.groupBy(*keys).agg(F.when(F.max(label) > 0.5, 1).otherwise(0).alias(out))


LabelAdapter = Callable[[DataFrame], DataFrame]


def label_dispatch(df: DataFrame, adapters: Mapping[str, LabelAdapter], dataset: str, datasets: Sequence[str]) -> DataFrame:
    """Label each listed dataset with its adapter and put the rows back together."""
    unknown = [d for d in datasets if d not in adapters]
    if unknown:
        raise ValueError(f"no label adapter is registered for {unknown[0]!r}; there are {sorted(adapters)}")
    parts = [adapters[d](df.where(F.col(dataset) == d)) for d in datasets]
    return reduce(DataFrame.unionByName, parts)


# Label columns of the three public recordings.
FLAG_COLUMNS = ("/grasp_failure_label.boolean.data", "/grasp_failure_label.data")
SUCCESS_COLUMN = "/grasp_failure_label.segment_info.success"
SUCCESS_METADATA = "is_episode_successful"
REWARD_PREFIX = "/step/reward"
TERMINAL_PREFIX = "/step/is_terminal"
# End of fixed values.


def _data_column(df: DataFrame, prefix: str) -> str | None:
    return next((c for c in df.columns if c.startswith(prefix) and c.endswith(".data")), None)


def metadata_flag(c: Column) -> Column:
    """A flag kept as text; only ``true`` / ``1`` are true, as written by any of the loaders."""
    return F.when(c.isNotNull(), F.lower(c).isin("true", "1", "1.0"))


def default_adapters(catalog: DataFrame | None, hot: HotKeys | None = None) -> dict[str, LabelAdapter]:
    """Adapters of the three public recordings. The catalog is needed for metadata labels."""

    def from_metadata(df: DataFrame) -> DataFrame:
        flags = catalog.select(SEQ, metadata_flag(F.col("user_metadata")[SUCCESS_METADATA]).alias("_ok_text"))
        return label_metadata(df, flags, SEQ, "_ok_text", hot=hot)

    return {
        "reassemble": lambda df: label_bool_topic(df, FLAG_COLUMNS, SUCCESS_COLUMN, [SEQ], TIME, hot=hot),
        "droid": from_metadata,
        "fractal_rt1": lambda df: label_terminal(
            df, SEQ, [TIME], _data_column(df, REWARD_PREFIX), _data_column(df, TERMINAL_PREFIX), hot=hot
        ),
    }


def label(
    df: DataFrame, dataset_id: str, catalog: DataFrame | None = None, hot: HotKeys | None = None
) -> DataFrame:
    """Add the label column to the aligned rows of one registered dataset."""
    spec_for(dataset_id)
    adapters = default_adapters(catalog, hot)
    if dataset_id not in adapters:
        raise ValueError(f"no label adapter is registered for {dataset_id!r}; there are {sorted(adapters)}")
    return adapters[dataset_id](df)


def with_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    """Tag rows with their dataset."""
    return df.withColumn(DATASET, F.lit(dataset_id))
