"""From recorded topic streams to a feature table: select, align, label, project, derive, encode.

Topics of a dataset come as one DataFrame each, with ``sequence_name``, ``timestamp_ns`` and
the flattened payload columns ``<topic>.<ontology>.<field>``. Everything after the union is
keyed by sequence, so the whole chain shuffles the samples once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.operators.align import grid_hot_keys, hold_resample_wide, step_seconds
from tickwise.operators.features import (
    add_derived, drop_incomplete, project_canonical, union_datasets,
)
from tickwise.operators.labels import label
from tickwise.operators.lookup import with_group_facts
from tickwise.operators.ordered import HotKeys, quoted
from tickwise.operators.scoring import encode_payloads
from tickwise.schema import (
    DATASET, EXTENDED, GRID_HZ, INSTRUCTION, INSTRUCTION_DIM, LABEL, RESIDUAL, SEQ, TICK, TIME, spec_for,
)
from tickwise.session import staged
from tickwise.sources.tables import incremental_todo

IMAGE_TIME, INSTRUCTION_TIME, TOLD_TIME = "_image_t", "_instruction_t", "_told_t"


def sparse_frame(dataset_id: str, streams: Mapping[str, DataFrame], images: DataFrame | None = None) -> DataFrame | None:
    """Requested topics that exist, as one wide sparse frame; ``None`` if there is none.

    Image bytes and instruction vectors stay out of it. An image contributes the time of the
    frame, an instruction its time if it has the right length and -1 if not; both are looked
    up by (sequence, time) later.
    """
    spec = spec_for(dataset_id)
    parts = []
    for topic in spec.topics:
        part = streams.get(topic)
        if part is None:
            continue
        if spec.instruction in part.columns:
            valid = F.size(quoted(spec.instruction)) == INSTRUCTION_DIM
            part = part.select(SEQ, TIME, F.when(valid, F.col(TIME)).otherwise(-1).alias(INSTRUCTION_TIME))
        parts.append(part)
    if parts and images is not None:
        parts.append(images.select(SEQ, TIME, F.col(TIME).alias(IMAGE_TIME)))
    return union_datasets(parts) if parts else None


def aligned(
    dataset_id: str, streams: Mapping[str, DataFrame], images: DataFrame | None = None, hz: float = GRID_HZ
) -> DataFrame | None:
    """All topics of a dataset on the grid."""
    sparse = sparse_frame(dataset_id, streams, images)
    if sparse is None:
        return None
    values = [c for c in sparse.columns if c not in (SEQ, TIME)]
    return hold_resample_wide(sparse, SEQ, TIME, values, step_seconds(hz))


def features_of(
    dense: DataFrame, dataset_id: str, catalog: DataFrame | None, hot: HotKeys | None = None
) -> DataFrame:
    """Label, project, drop incomplete ticks, then differentiate: one row per remaining tick."""
    labelled = label(dense, dataset_id, catalog, hot)
    if INSTRUCTION_TIME in dense.columns:
        # The instruction of a sequence is that of its first tick holding a valid one.
        valid = F.when(F.col(INSTRUCTION_TIME) >= 0, F.col(TICK))
        labelled = with_group_facts(labelled, [SEQ], {TOLD_TIME: F.min_by(INSTRUCTION_TIME, valid)}, hot)
    carried = [c for c in (IMAGE_TIME, TOLD_TIME) if c in labelled.columns]
    complete = drop_incomplete(project_canonical(labelled, dataset_id, [SEQ, TICK, TIME, LABEL, *carried]))
    derived = add_derived(complete, [SEQ], TIME, hot=hot)
    kin = [*EXTENDED, *([RESIDUAL] if RESIDUAL in derived.columns else [])]
    return derived.select(
        F.lit(dataset_id).alias(DATASET), SEQ, TICK, TIME,
        F.array(*kin).cast("array<float>").alias("kin"), F.col(LABEL).cast("float").alias("label"), *carried,
    )


def materialise(
    dataset_id: str,
    streams: Mapping[str, DataFrame],
    catalog: DataFrame,
    done: DataFrame | None = None,
    images: DataFrame | None = None,
    encoder_factory: Callable[[], Callable[[list[bytes]], np.ndarray]] | None = None,
    hz: float = GRID_HZ,
    force: bool = False,
) -> DataFrame | None:
    """The rows of :func:`materialise_with_failures` alone; a payload that cannot be encoded ends the job."""
    return _materialise(dataset_id, streams, catalog, done, images, encoder_factory, hz, force, None)[0]


def materialise_with_failures(
    dataset_id: str,
    streams: Mapping[str, DataFrame],
    catalog: DataFrame,
    done: DataFrame | None = None,
    images: DataFrame | None = None,
    encoder_factory: Callable[[], Callable[[list[bytes]], np.ndarray]] | None = None,
    hz: float = GRID_HZ,
    force: bool = False,
) -> tuple[DataFrame | None, DataFrame]:
    """Feature rows of what could be built, and (sequence, error) of the sequences that could not.

    A sequence with a payload that the encoder rejects fails as a whole and has no rows; the
    others are not touched by it. Descriptors are written to the shared folder once, since both
    results need them.
    """
    none = catalog.sparkSession.createDataFrame([], f"{SEQ} string, error string")
    rows, failed = _materialise(dataset_id, streams, catalog, done, images, encoder_factory, hz, force, "_error")
    return rows, none if failed is None else failed


def _materialise(
    dataset_id: str, streams: Mapping[str, DataFrame], catalog: DataFrame, done: DataFrame | None, images: DataFrame | None,
    encoder_factory: Callable[[], Callable[[list[bytes]], np.ndarray]] | None, hz: float, force: bool, error: str | None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """Feature rows of the sequences of a dataset that are not in ``done`` yet.

    ``images`` has ``sequence_name``, ``timestamp_ns`` and ``data``. Frames are encoded where
    they are read, so no bytes are shuffled, and the descriptors are joined to the ticks that
    hold them; ticks before the first frame get the descriptor of an empty payload.
    """
    spec = spec_for(dataset_id)
    names = catalog.where(F.col(DATASET) == dataset_id).select(DATASET, SEQ)
    todo = incremental_todo(names, done, [DATASET, SEQ], force).select(SEQ).distinct()
    chosen = {t: s.join(todo, SEQ, "left_semi") for t, s in streams.items()}
    frames = images.join(todo, SEQ, "left_semi") if images is not None else None
    dense = aligned(dataset_id, chosen, frames, hz)
    if dense is None:
        return None, None
    # Grid lengths follow from the first and last samples, so the grid itself is not counted.
    hot = grid_hot_keys(sparse_frame(dataset_id, chosen).select(SEQ, TIME), SEQ, TIME, step_seconds(hz))
    rows = features_of(dense, dataset_id, catalog, hot)
    told = next((s for s in chosen.values() if spec.instruction in s.columns), None)
    if told is not None:
        vector = quoted(spec.instruction)
        vectors = (
            told.where(F.size(vector) == INSTRUCTION_DIM)
            .groupBy(SEQ, F.col(TIME).alias(TOLD_TIME))
            .agg(F.max(vector).alias(INSTRUCTION))
        )
        rows = rows.join(vectors, [SEQ, TOLD_TIME], "left").drop(TOLD_TIME)
    if images is None or encoder_factory is None:
        return rows.drop(IMAGE_TIME), None
    encoded = encode_payloads(frames.select(SEQ, F.col(TIME).alias(IMAGE_TIME), "data"), "data", encoder_factory, "_cnn", error)
    failed = None
    if error is not None:
        encoded = staged(encoded, "descriptors")
        failed = encoded.where(F.col(error).isNotNull()).groupBy(SEQ).agg(F.min(error).alias("error"))
        rows = rows.join(failed.select(SEQ), SEQ, "left_anti")
    encoded = encoded.groupBy(SEQ, IMAGE_TIME).agg(F.max("_cnn").alias("_cnn"))
    empty = F.array(*[F.lit(float(x)) for x in np.asarray(encoder_factory()([b""]), float)[0]])
    described = (
        rows.join(encoded, [SEQ, IMAGE_TIME], "left")
        .withColumn("cnn", F.coalesce("_cnn", empty).cast("array<float>"))
        .drop("_cnn", IMAGE_TIME)
    )
    return described, failed


def status_of(
    catalog: DataFrame, rows: DataFrame, dataset_id: str, done: DataFrame | None, failed: DataFrame | None = None
) -> DataFrame:
    """Outcome per sequence (ok, empty, skip, fail) with its frames, for the ingest counters."""
    sizes = rows.groupBy(SEQ).agg(F.count(F.lit(1)).alias("frames"))
    names = catalog.where(F.col(DATASET) == dataset_id).select(DATASET, SEQ).join(sizes, SEQ, "left")
    if done is None:
        skipped = names.withColumn("_done", F.lit(None).cast("int"))
    else:
        skipped = names.join(done.select(SEQ).distinct().withColumn("_done", F.lit(1)), SEQ, "left")
    if failed is None:
        skipped = skipped.withColumn("_failed", F.lit(None).cast("int"))
    else:
        skipped = skipped.join(failed.select(SEQ).distinct().withColumn("_failed", F.lit(1)), SEQ, "left")
    state = (
        F.when(F.col("_failed").isNotNull(), "fail").when(F.col("frames").isNotNull(), "ok")
        .when(F.col("_done").isNotNull(), "skip").otherwise("empty")
    )
    return skipped.select(DATASET, SEQ, state.alias("state"), F.coalesce("frames", F.lit(0)).alias("frames"))
