"""Undo and redo of a volume's edits, from a log of what a user did.

An action is (vol_id, seq, action, n): action is edit, undo or redo, n the voxels that an edit changed. Edits keep their
voxels in a table of their own (vol_id, seq, i, j, k, label), which the history never reads.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.operators.labels import PLACE

#: Edits and bytes that the undo history keeps, and the bytes of one changed voxel.
STEPS, BYTES, VOXEL_BYTES = 50, 600_000_000, 6
OUT = "vol_id long, seq long, action string, target long, undos long, redos long"


def walked(actions: DataFrame, steps: int = STEPS, most_bytes: int = BYTES) -> DataFrame:
    """(vol_id, seq, action, target, undos, redos) of every action, in the order of seq within a volume.

    target: the edit that the action made, undid or redid; null where there was nothing to undo or redo. undos, redos: what can be undone
    and redone afterwards. A new edit drops all that was undone, and the oldest edits while there are over `steps` or over
    `most_bytes` of them, but never itself; dropped edits stay in the map. Rows with a null volume, seq or action, and other actions, are left out; of
    rows with one seq all count, edits first, then redo, then undo.

    A stack has no relational form, as each step needs the one before. Its state is at most `steps` edits, so sorted
    partitions are walked in batches and a volume with many actions is never gathered.
    """

    def walk(batches):
        vol, undos, redos, size = None, deque(), [], 0
        for batch in batches:
            out = []
            for v, seq, action, n in zip(batch["vol_id"], batch["seq"], batch["action"], batch["n"], strict=True):
                if v != vol:
                    vol, undos, redos, size = v, deque(), [], 0
                target = None
                if action == "edit":
                    target, redos = seq, []
                    undos.append((seq, VOXEL_BYTES * n))
                    size += VOXEL_BYTES * n
                    while len(undos) > 1 and (len(undos) > steps or size > most_bytes):
                        size -= undos.popleft()[1]
                elif action == "undo" and undos:
                    redos.append(undos.pop())
                    size -= redos[-1][1]
                    target = redos[-1][0]
                elif action == "redo" and redos:
                    undos.append(redos.pop())
                    size += undos[-1][1]
                    target = undos[-1][0]
                out.append((v, seq, action, target, len(undos), len(redos)))
            yield pd.DataFrame(out, columns=["vol_id", "seq", "action", "target", "undos", "redos"]).astype({"target": "Int64"})

    rows = actions.select(F.col("vol_id").cast("long").alias("vol_id"), F.col("seq").cast("long").alias("seq"), "action", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    rows = rows.where("vol_id is not null and seq is not null and action in ('edit', 'undo', 'redo')")
    return rows.repartition("vol_id").sortWithinPartitions("vol_id", "seq", "action", "n").mapInPandas(walk, OUT)


def intervals(steps: DataFrame) -> DataFrame:
    """(vol_id, edit, since, until): when each edit of walked actions counts, from a seq up to but without another; null: to the end."""
    moves = steps.where("target is not null").select("vol_id", F.col("target").alias("edit"), "seq", (F.col("action") != "undo").alias("on"))
    ends = moves.withColumn("until", F.lead("seq").over(Window.partitionBy("vol_id", "edit").orderBy("seq")))
    return ends.where("on").select("vol_id", "edit", F.col("seq").alias("since"), "until")


def _counts(at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return (F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at))


def edited_voxels(edits: DataFrame, spans: DataFrame, at: int | None = None) -> DataFrame:
    """(vol_id, i, j, k, label, edit): voxels as the last edit that counts leaves them, at a seq or (None) at the end.

    As only the last edit can be undone, the later of two edits that count is the one that was made later.
    """
    now = spans.where(F.col("until").isNull() if at is None else _counts(at)).select("vol_id", "edit")
    rows = edits.select(*PLACE, "label", F.col("seq").alias("edit")).join(now, ["vol_id", "edit"], "left_semi")
    last = rows.groupBy(*PLACE).agg(F.max(F.struct("edit", "label")).alias("m"))
    return last.select(*PLACE, "m.label", "m.edit")


def replayed(lab: DataFrame, edits: DataFrame, spans: DataFrame, at: int | None = None) -> DataFrame:
    """lab with the edits that count; voxels that only an edit has come in."""
    new = edited_voxels(edits, spans, at).select(*PLACE, F.col("label").alias("new"))
    return lab.select(*PLACE, "label").join(new, PLACE, "full").select(*PLACE, F.coalesce("new", "label").alias("label"))
