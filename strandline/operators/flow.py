"""Flow paths over directions and the migration of patches along them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patches import grouped
from .terrain import FLOW_CODES

_STEPS = {k: d for d, k in FLOW_CODES.items()}


def next_cells(directions: DataFrame, keys=("tid",)) -> DataFrame:
    """keys, r, c, r2, c2: where each cell's direction leads."""
    step = F.create_map(*(x for k, (a, b) in _STEPS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")))))[F.col("code")]
    return directions.select(*keys, "r", "c", (F.col("r") + step["dr"]).alias("r2"), (F.col("c") + step["dc"]).alias("c2"))


def flow_path(step: dict[tuple[int, int], tuple[int, int]], start: tuple[int, int], stop: set[tuple[int, int]] = frozenset()) -> list[tuple[int, int]]:
    """Cells from start on until there is no direction, a cell comes again, or one of `stop` is reached (included)."""
    path, seen, at = [], set(), start
    while at not in seen:
        path.append(at)
        seen.add(at)
        if at in stop or at not in step:
            break
        at = step[at]
    return path


def _steps(pdf: pd.DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    moves = pdf.loc[pdf["code"].notna(), ["r", "c", "code"]]
    return {(r, c): (r + _STEPS[int(k)][0], c + _STEPS[int(k)][1]) for r, c, k in moves.itertuples(index=False)}


def flow_reach(directions: DataFrame, keys=("tid",)) -> DataFrame:
    """keys, r, c, end_r, end_c, n_steps: the last cell of the path of every cell, by pointer doubling in arrays.

    Directions go strictly down, so that no path comes back; a direction that leads beyond the cells ends its path.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        at = {x: i for i, x in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
        step = _steps(pdf)
        to = np.array([at.get(step.get(x, x), at[x]) for x in at])
        n = (to != np.arange(len(to))).astype(np.int64)
        while True:
            far = to[to]
            if (far == to).all():
                break
            n, to = n + n[to], far
        return pd.DataFrame({"r": r, "c": c, "end_r": r[to], "end_c": c[to], "n_steps": n})

    return grouped(directions.select(*keys, "r", "c", "code"), list(keys), kernel, "r int, c int, end_r int, end_c int, n_steps long")


def _pseudo(seed: int, x: int) -> int:
    return (((seed * 65536 + x) * 1103515245 + 12345) % 2147483648) >> 10


def migration(cells: DataFrame, end_to_left: bool, keys=("tid",), n_rows: int = 50, n_cols: int = 64, margin: int = 2, seed: int = 1) -> DataFrame:
    """keys, patch_id, n_cells, good_border, y_border, bad_border, good_paths, bad_paths, keeps.

    cells has r, c, patch_id (null: not of the type) and code (null: no flow).  The good border is the side where the
    type comes from: left for a type that ends to the right, right for one that ends to the left.

    A type that ends to the right: patches on the left border are good.  Of the others, three to six cells (a twentieth
    between) flow down; a path that ends at the left border is good, one that ends at another border is bad.
    A type that ends to the left: paths start at every cell of the upper and lower borders; a patch that any crosses is
    bad.  Patches off the good border that touch an upper or lower border, or have a bad path and are the target of a
    successful one, are removed; so are, again and again, the next patches on paths whose target is removed.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        step = _steps(pdf)
        held = pdf[pdf["patch_id"].notna()]
        patch = {(r, c): int(p) for r, c, p in held[["r", "c", "patch_id"]].itertuples(index=False)}
        of: dict[int, list[tuple[int, int]]] = {}
        for x, p in patch.items():
            of.setdefault(p, []).append(x)
        left, right, top, low = 1 + margin, n_cols - margin, 1 + margin, n_rows - margin
        good_side = (lambda x: x[1] >= right) if end_to_left else (lambda x: x[1] <= left)
        bad_side = (lambda x: x[1] <= left) if end_to_left else (lambda x: x[1] >= right)
        y_side = lambda x: x[0] <= top or x[0] >= low
        rows = {p: {"patch_id": p, "n_cells": len(v), "good_border": any(map(good_side, v)), "y_border": any(map(y_side, v)), "bad_border": any(map(bad_side, v)), "good_paths": 0, "bad_paths": 0} for p, v in of.items()}
        chains: list[list[int]] = []  # patches along successful paths, the target first
        if end_to_left:
            for start in sorted({(r, c) for r, c in pdf[["r", "c"]].itertuples(index=False) if y_side((r, c))}):
                path = flow_path(step, start)
                crossed = list(dict.fromkeys(patch[x] for x in path if x in patch))
                for p in crossed:
                    rows[p]["bad_paths"] += 1
                if crossed:
                    chains.append(crossed)
        else:
            for p in sorted(of):
                if rows[p]["good_border"]:
                    continue
                members = sorted(of[p])
                n = min(len(members), min(6, max(3, round(0.05 * len(members)))))
                for start in sorted(members, key=lambda x: (_pseudo(seed, x[0] * n_cols + x[1]), x))[:n]:
                    path = flow_path(step, start)
                    end = path[-1]
                    if good_side(end):
                        rows[p]["good_paths"] += 1
                    elif bad_side(end) or y_side(end):
                        rows[p]["bad_paths"] += 1
                        chains.append(list(dict.fromkeys(patch[x] for x in reversed(path) if x in patch)))
        targets = {c[0] for c in chains}
        removed = {p for p, x in rows.items() if not x["good_border"] and (x["y_border"] or (x["bad_paths"] and p in targets))}
        changed = True
        while changed:
            changed = False
            for chain in chains:
                if chain and chain[0] in removed:
                    chain.pop(0)
                    changed = True
                    if chain and not rows[chain[0]]["good_border"]:
                        removed.add(chain[0])
        columns = ["patch_id", "n_cells", "good_border", "y_border", "bad_border", "good_paths", "bad_paths", "keeps"]
        return pd.DataFrame([x | {"keeps": p not in removed} for p, x in sorted(rows.items())], columns=columns)

    schema = "patch_id int, n_cells long, good_border boolean, y_border boolean, bad_border boolean, good_paths long, bad_paths long, keeps boolean"
    return grouped(cells.select(*keys, "r", "c", "patch_id", "code"), list(keys), kernel, schema)


def without_bad_migration(labelled: DataFrame, judged: DataFrame, keys=("tid",)) -> DataFrame:
    """Cells of the patches that stay."""
    return labelled.join(judged.where("not keeps").select(*keys, "patch_id"), [*keys, "patch_id"], "left_anti")


def migration_tally(judged: DataFrame, keys=("tid",)) -> DataFrame:
    kept = F.col("keeps")
    return judged.groupBy(*keys).agg(
        F.count(F.when(kept, 1)).alias("good_patches"), F.count(F.when(~kept, 1)).alias("bad_patches"), F.avg(kept.cast("double")).alias("good_fraction"),
        (F.sum(F.when(kept, F.col("n_cells")).otherwise(0)) / F.sum("n_cells")).alias("good_area_fraction"), F.sum(F.col("good_paths") + F.col("bad_paths")).alias("paths_tested"),
    )
