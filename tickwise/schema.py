"""Feature names, struct types and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

# Feature names, their order, and the sizes results depend on.
CANONICAL = (
    "ee_pos_x", "ee_pos_y", "ee_pos_z",
    "ee_rot_qx", "ee_rot_qy", "ee_rot_qz", "ee_rot_qw",
    "gripper_state",
)
# Derived feature <- the canonical one it differentiates; qw has none.
DERIVED = {
    "ee_vel_x": "ee_pos_x", "ee_vel_y": "ee_pos_y", "ee_vel_z": "ee_pos_z",
    "ee_rot_vel_x": "ee_rot_qx", "ee_rot_vel_y": "ee_rot_qy", "ee_rot_vel_z": "ee_rot_qz",
    "gripper_vel": "gripper_state",
}
EXTENDED = (*CANONICAL, *DERIVED)
RESIDUAL = "gripper_residual"
INSTRUCTION = "nl_emb"
LABEL = "grasp_failure"
GRID_HZ = 50
CHUNK_SECONDS = 5
WINDOW_TICKS = 50
INSTRUCTION_DIM = 512
TAIL_FRACTION = 0.30
WARM_UP_WINDOWS = 2
MIN_TICKS, MAX_TICKS, MIN_WINDOWS = 300, 900, 4
# End of fixed values.

SEQ, DATASET, TIME, TICK = "sequence_name", "dataset_id", "timestamp_ns", "tick"

POSITION = T.StructType([T.StructField(a, T.DoubleType()) for a in "xyz"])
ORIENTATION = T.StructType([T.StructField(a, T.DoubleType()) for a in "xyzw"])
POSE = T.StructType([T.StructField("position", POSITION), T.StructField("orientation", ORIENTATION)])

CATALOG = T.StructType([
    T.StructField(SEQ, T.StringType(), False),
    T.StructField(DATASET, T.StringType(), False),
    T.StructField("user_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("topics", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class SourceSpec:
    """How one recorded source maps onto the canonical schema.

    ``pose`` names the topic of the tool pose, ``gripper`` the gripper column, and
    ``gripper_reduce`` how its cell becomes a scalar (``mean``, ``first`` or ``scalar``).
    ``columns`` overrides single canonical columns by source column name. ``label`` is a
    function ``DataFrame -> DataFrame`` adding the label.
    """

    dataset_id: str
    topics: tuple[str, ...]
    pose: str
    gripper: str
    gripper_reduce: str
    gripper_threshold: float
    image_topic: str | None = None
    commanded: str | None = None
    sensed: str | None = None
    instruction: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    extra: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)


_SPECS: dict[str, SourceSpec] = {}


def register_source(spec: SourceSpec) -> SourceSpec:
    """Add a source, or replace the one with the same id."""
    _SPECS[spec.dataset_id] = spec
    return spec


def spec_for(dataset_id: str) -> SourceSpec:
    """The registered source; an unknown id is an error on the driver."""
    if dataset_id not in _SPECS:
        raise ValueError(f"no source is registered as {dataset_id!r}; there are {sorted(_SPECS)}")
    return _SPECS[dataset_id]


def known_sources() -> list[str]:
    """Ids of all registered sources."""
    return list(_SPECS)


# Topic and column names of the three public recordings, and their thresholds.
register_source(SourceSpec(
    dataset_id="reassemble",
    topics=("/robot_state/pose", "/robot_state/end_effector", "/grasp_failure_label"),
    pose="/robot_state/pose",
    gripper="/robot_state/end_effector.end_effector.positions",
    gripper_reduce="mean",
    gripper_threshold=0.025,
    image_topic="/hand",
))
register_source(SourceSpec(
    dataset_id="droid",
    topics=("/observation/state/cartesian_position", "/observation/state/gripper_position"),
    pose="/observation/state/cartesian_position",
    gripper="/observation/state/gripper_position.end_effector.positions",
    gripper_reduce="first",
    gripper_threshold=0.5,
    image_topic="/observation/images/wrist_left",
))
register_source(SourceSpec(
    dataset_id="fractal_rt1",
    topics=(
        "/step/observation/base_pose_tool_reached",
        "/step/observation/gripper_closed",
        "/step/observation/gripper_closedness_commanded",
        "/step/observation/natural_language_embedding",
        "/step/reward",
        "/step/is_terminal",
    ),
    pose="/step/observation/base_pose_tool_reached",
    gripper="/step/observation/gripper_closed.floating32.data",
    gripper_reduce="scalar",
    gripper_threshold=0.5,
    image_topic="/step/observation/image",
    commanded="/step/observation/gripper_closedness_commanded.floating32.data",
    sensed="/step/observation/gripper_closed.floating32.data",
    instruction="/step/observation/natural_language_embedding.text_embedding.values",
))
