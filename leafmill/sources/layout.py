"""Lines of a page from text items with places, as page descriptions have them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def layout_lines(items: DataFrame, key: list[str] | None = None, gap: float = 3.0) -> DataFrame:
    """(doc_id, page, line_no, line, y, height) from items (doc_id, page, x, y, h, text), y upwards.

    Items go from the top down and from left to right. One whose y is `gap` or more away from the first item of its line
    begins a new one; a line is as high as its highest item. Which item is the first depends on all before it, so each
    page, a bounded set, is done in one call.
    """
    key = key or ["doc_id", "page"]

    def run(page: pa.Table) -> pa.Table:
        rows: list[list] = []
        x, y, h = (page.column(c).to_numpy().astype(float) for c in "xyh")
        order = np.lexsort((x, -y))
        texts = page.column("text").to_pylist()
        for i, x_, y_, h_ in zip(order.tolist(), x[order].tolist(), y[order].tolist(), h[order].tolist(), strict=True):
            if not rows or abs(rows[-1][0] - y_) >= gap:
                rows.append([y_, [], h_])
            rows[-1][1].append((x_, texts[i] or ""))
            rows[-1][2] = max(rows[-1][2], h_)
        joined = [" ".join(" ".join(t for _, t in sorted(row, key=lambda t: t[0])).split()) for _, row, _ in rows]
        first = pa.array([0] * len(rows), pa.int64())
        columns = [*(page.column(k).combine_chunks().take(first) for k in key), pa.array(range(len(rows)), pa.int32()), pa.array(joined, pa.string()), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())]
        return pa.Table.from_arrays(columns, names=[*key, "line_no", "line", "y", "height"])

    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in key)
    return items.groupBy(*key).applyInArrow(run, f"{kinds}, line_no int, line string, y double, height double")
