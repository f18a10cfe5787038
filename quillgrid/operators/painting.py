"""The operators of a page's description, walked in order: what is painted, in which state."""

import math

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .perpage import per_page

EVENT = "idx long, event string, obj_id string, ctm array<double>, opacity double, blended boolean, subtype string, size double"
NORMAL = ("source-over", "Normal", "Compatible")


def _times(a: list[float], b: list[float]) -> list[float]:
    """The matrix product: b is applied first."""
    lead = [(a[0], a[2]), (a[1], a[3])]
    out = [x * b[2 * c] + y * b[2 * c + 1] for c in range(3) for x, y in lead]
    return [*out[:4], out[4] + a[4], out[5] + a[5]]


def walk(ops: DataFrame, page: list[str]) -> DataFrame:
    """The page's columns and EVENT: images and masks that are painted, fonts that are set, groups that begin and end, with the state they meet.

    ops: the page's columns, idx, op, matrix (transform, form), alpha and blend (state; null: as it is), subtype (group), obj_id (image, mask), size (font). save, form and group
    put the state away, restore, form_end and group_end take it back; without one put away it stays. A group begins solid and unblended; what its surroundings
    have multiplies in. Opacity is null where it is 1. Other operators change nothing. A page is one task's walk.
    """
    schema = StructType([ops.schema[c] for c in page] + _parse_datatype_string(EVENT).fields)
    columns = ["idx", "op", "matrix", "alpha", "blend", "subtype", "obj_id", "size"]

    def work(t: dict[str, list]) -> list[tuple]:
        where = tuple(t[c][0] for c in page)
        ctm, alpha, blended = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 1.0, False
        kept, groups, out = [], [], []
        for idx, op, matrix, a, mode, subtype, obj_id, size in zip(*(t[c] for c in columns), strict=True):
            if op in ("save", "form", "group"):
                kept.append((ctm, alpha, blended))
            if op in ("transform", "form") and matrix is not None:
                ctm = _times(ctm, matrix)
            elif op == "state":
                alpha = alpha if a is None else a
                blended = blended if mode is None else mode not in NORMAL
            elif op == "group":
                groups.append((subtype, alpha, blended))
                alpha, blended = 1.0, False
                out.append((*where, idx, "group", None, None, None, False, subtype, None))
            elif op in ("restore", "form_end", "group_end"):
                if op == "group_end":
                    ended = groups.pop()[0] if groups else None
                    out.append((*where, idx, "group_end", None, None, None, False, ended, None))
                old = kept.pop() if kept else (ctm, alpha, blended)
                ctm, alpha, blended = old if op != "group_end" else (ctm, *old[1:])
            elif op == "font":
                out.append((*where, idx, "font", obj_id, None, None, False, None, (size or 0.0) * (math.hypot(ctm[0], ctm[1]) or 1.0)))
            elif op in ("image", "mask"):
                opacity = alpha * math.prod(g[1] for g in groups)
                out.append((*where, idx, op, obj_id, ctm, opacity if opacity < 1 else None, blended or any(g[2] for g in groups), groups[-1][0] if groups else None, None))
        return out

    return per_page(ops.select(*page, *columns), page, ["idx"], schema, work)


def rows_of(elements: DataFrame, page: list[str]) -> DataFrame:
    """elements (the page's columns, idx, x, y, w, h) with row, from 0 at the top: from the top down and then from the left, each joins the first row
    with a member that it overlaps in height, or begins one; rows are numbered by their highest member."""
    schema = StructType([*elements.schema.fields, StructField("row", _parse_datatype_string("long"))])
    names = elements.columns

    def work(t: dict[str, list]) -> list[tuple]:
        y, top = t["y"], [a + b for a, b in zip(t["y"], t["h"], strict=True)]
        order = sorted(range(len(y)), key=lambda k: (-top[k], t["x"][k]))
        rows: list[list[int]] = []
        for k in order:
            row = next((r for r in rows if any(min(top[k], top[m]) - max(y[k], y[m]) > 0 for m in r)), None)
            if row is None:
                rows.append([k])
            else:
                row.append(k)
        rows.sort(key=lambda r: -max(top[k] for k in r))
        of = {k: n for n, r in enumerate(rows) for k in r}
        return [(*(t[c][k] for c in names), of[k]) for k in range(len(y))]

    return per_page(elements, page, ["idx"], schema, work)
