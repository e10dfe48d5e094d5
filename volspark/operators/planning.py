"""Which models and labels a task needs, from class maps (kind, owner, idx, name)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models of the task total, the crop model, spacings in millimetres, steps between tiles.
PARTS, CROP = (291, 292, 293, 294, 295), 298
TASKS = {
    "total": ((1.5, 1.5, 1.5), 0.8),
    "liver_segments": ((0.8046879768371582, 0.8046879768371582, 1.5), 0.5),
    "liver_vessels": ((0.0, 0.0, 0.0), 0.5),
}
SINGLE = {"liver_segments": 570, "liver_vessels": 8}
MARGIN_MM = 20.0


def class_map(lines: DataFrame) -> DataFrame:
    """(kind, owner, idx, name) of lines `task <task> <idx> <name>` and `part <model> <idx> <name>`; others are skipped."""
    w = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value").rlike(r"^(task|part)\s+\S+\s+\d+\s+\S+")).select(w[0].alias("kind"), w[1].alias("owner"), w[2].cast("int").alias("idx"), w[3].alias("name"))


def part_to_task(classes: DataFrame, task: str) -> DataFrame:
    """(part, label, task_label) of every part model's classes by name; a class that the task lacks is an error."""
    own = classes.where((F.col("kind") == "task") & (F.col("owner") == task)).select("name", F.col("idx").alias("task_label"))
    parts = classes.where("kind = 'part'").select(F.col("owner").cast("int").alias("part"), F.col("idx").alias("label"), "name")
    label = F.coalesce("task_label", F.raise_error(F.concat(F.lit("no such class: "), F.col("name"))).cast("int"))
    return parts.join(own, "name", "left").select("part", "label", label.alias("task_label"))


def models_of(classes: DataFrame, roi: list[str]) -> DataFrame:
    """(part): models that hold a structure of the regions of interest; all without any."""
    parts = classes.where("kind = 'part'")
    if roi:
        parts = parts.where(F.col("name").isin(roi))
    return parts.select(F.col("owner").cast("int").alias("part")).distinct()


@dataclass
class Plan:
    task: str
    spacing: tuple[float, float, float]
    step: float
    models: list[int]
    crop: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)

    def model_ids(self) -> list[int]:
        """Models in the order in which they run, each once."""
        return list(dict.fromkeys([*([CROP] if self.crop else []), *self.models]))


def plan(task: str, roi: list[str], classes: DataFrame) -> Plan:
    """The task's stages. `total` runs the part models that hold a region and crops to the regions; the liver tasks crop to the
    liver; `custom:<model>[:<region>+<region>]` runs one model, cropped if regions are named."""
    if task.startswith("custom:"):
        _, model, *crop = task.split(":")
        named = [r for r in (crop[0].split("+") if crop else []) if r not in ("", "-")]
        return Plan(task, (0.0, 0.0, 0.0), 0.5, [int(model)], named, list(roi))
    if task not in TASKS:
        raise ValueError(f"unsupported task: {task}")
    spacing, step = TASKS[task]
    if task in SINGLE:
        return Plan(task, spacing, step, [SINGLE[task]], ["liver"], list(roi))
    have = {r["part"] for r in models_of(classes, roi).collect()}  # a handful of model numbers
    models = [m for m in PARTS if m in have]
    if not models:
        raise ValueError("no model holds a region of interest")
    return Plan(task, spacing, step, models, list(roi), list(roi))


def margin_voxels(zooms) -> tuple[int, ...]:
    """The crop's margin in whole voxels of each axis."""
    return tuple(int(MARGIN_MM / z) for z in zooms)


def mesh_options(names: DataFrame) -> DataFrame:
    """names (name) with kind: the settings class of a structure's surface: thin trees, trunks of vessels, organs."""
    tree = F.col("name").isin("liver_vessels", "portal_vein_intrahepatic", "hepatic_veins")
    trunk = F.lit(False)
    for word in ("vein", "vena", "arter", "aorta"):
        trunk = trunk | F.col("name").contains(word)
    kind = F.when(tree, "tree").when(trunk, "trunk").otherwise("organ")
    taubin = F.when(tree, 30).when(trunk, 20)
    return names.select("name", kind.alias("kind"), taubin.alias("taubin_iterations"), F.when(tree | trunk, 0.03).otherwise(0.0).alias("min_piece_ml"))
