"""Windows of lines around targets, merged and shrunk until they fit a budget."""

from __future__ import annotations

from itertools import accumulate, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many lines around a target are tried, and how many of the top are kept besides `signature`, in this order.
REACHES, TOPS = (20, 15, 10, 7, 5, 3, 2, 1, 0), (3, 2, 1)


def excerpt(text: str, ats: list[int], budget: int, signature: int) -> tuple[str, int | None, int | None]:
    """(excerpt, top, reach) of one text around its lines `ats`, numbered from 0; those outside do not count."""
    lines = text.removesuffix("\n").split("\n") if text else []
    total = len(lines)
    until = [0, *accumulate(map(len, lines))]
    places = sorted({x for x in ats if x is not None and 0 <= x < total}) or [min(signature, total - 1)]
    omitted = "    ... [{} lines omitted] ...".format
    for top, reach in product(sorted({signature, *TOPS}, reverse=True), REACHES) if total else ():
        islands = [[0, min(top, total) - 1]]
        for x in places:
            a, b = max(0, x - reach), min(total - 1, x + reach)
            if a > islands[-1][1] + 1:
                islands.append([a, b])
            else:
                islands[-1][1] = max(islands[-1][1], b)
        gaps = [a - b - 1 for (a, _), (_, b) in zip([*islands[1:], (total, 0)], islands)]
        size = sum(until[b + 1] - until[a] + b - a + 1 + (len(omitted(gap)) + 1 if gap else 0) for (a, b), gap in zip(islands, gaps)) - 1
        if size // 4 <= budget:
            parts = [x for (a, b), gap in zip(islands, gaps) for x in (*lines[a : b + 1], *([omitted(gap)] if gap else []))]
            return "\n".join(parts), top, reach
    return text if len(text) // 4 <= budget else text[: budget * 4], None, None


def centred(bodies: DataFrame, targets: DataFrame, budget: int, signature: int = 5) -> DataFrame:
    """Bodies (id, text, start) to id, excerpt, top, reach: the lines around each body's targets (id, line) that fit `budget` tokens.

    A body's first lines stay, and the lines within a reach of each target; windows that overlap or touch are one, and a mark
    says how many lines each gap leaves out. The widest reach that fits is taken, with as many first lines as possible.
    Targets are line numbers of the file that the body begins in at `start`; one outside does not count, and a body without
    any is centred below its first lines. If nothing fits, the text is cut at four characters a token (top and reach are null).

    A body's targets are one array, so each body is worked out in its own row by `excerpt`, and its text travels once.
    """
    aims = targets.groupBy("id").agg(F.collect_set("line").alias("aims"))
    rows = bodies.select("id", "start", "text").join(aims.hint("merge"), "id", "left")
    shown = rows.withColumn("ats", F.transform("aims", lambda x: x - F.col("start"))).select("id", F.coalesce("text", F.lit("")).alias("text"), "ats")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [excerpt(text.as_py(), ats.as_py() or [], budget, signature) for text, ats in zip(batch.column(1), batch.column(2))]
            columns = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32())))], names=["id", "excerpt", "top", "reach"])

    return shown.mapInArrow(run, f"id {bodies.schema['id'].dataType.simpleString()}, excerpt string, top int, reach int")
