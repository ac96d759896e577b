"""Packing units into token-budgeted batches, and reading numbered answers back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a batch at most, the end mark of an answer, and its item heads (a line ends at \n only).
MAX_UNITS = 256
END = "---END---"
ITEM = r"(?md)^\[(\d+)\][ \t]*"


def budgets(context: int, most_output: int) -> tuple[int, int]:
    """Input and output tokens that a batch may take, with margins for what surrounds it."""
    if not 0 < most_output < context:
        raise ValueError("the output must be positive and smaller than the context")
    room = context - most_output
    margin_in = min(4096, max(32, context // 100), max(1, room // 4))
    margin_out = min(512, max(8, most_output // 20), max(1, most_output // 4))
    return room - margin_in, most_output - margin_out


def _packed(batches: Iterator[pd.DataFrame], overhead: int, most_in: int, most_out: int) -> Iterator[pd.DataFrame]:
    """Rows in order, a path's together: batch numbers by the longest prefix that fits; the state is one batch's sums."""
    path, number, n, used, said = None, 0, 0, 0, 0
    for rows in batches:
        out = []
        for p, cost_in, cost_out in zip(rows["relative_path"], rows["input_tokens"], rows["output_tokens"], strict=True):
            if p != path:
                path, number, n, used, said = p, 0, 0, overhead, 0
            full = n == MAX_UNITS or used + cost_in > most_in or -(-6 * (said + cost_out) // 5) > most_out
            if n and full:
                number, n, used, said = number + 1, 0, overhead, 0
            n, used, said = n + 1, used + cost_in, said + cost_out
            alone = used > most_in or -(-6 * said // 5) > most_out
            out.append((number, n - 1, bool(alone)))
        yield pd.concat([rows[["relative_path", "ordinal"]].reset_index(drop=True), pd.DataFrame(out, columns=["batch", "place", "over"])], axis=1)


def pack(units: DataFrame, overhead: int, most_in: int, most_out: int) -> DataFrame:
    """relative_path, ordinal, batch, place, over of units (relative_path, ordinal, input_tokens, output_tokens).

    Each batch is the longest run of its file, in order, whose tokens fit; answers may be a fifth longer than their sources. A unit
    that fits nowhere is a batch alone, marked `over`. Rows stream through sorted partitions: no file is held whole.
    """
    held = units.select("relative_path", "ordinal", "input_tokens", "output_tokens").repartition("relative_path").sortWithinPartitions("relative_path", "ordinal")
    return held.mapInPandas(lambda b: _packed(b, overhead, most_in, most_out), "relative_path string, ordinal long, batch long, place long, over boolean")


def parse_answer(text: Column, expected: Column, finish: Column) -> Column:
    """struct(error, translations): the items of an answer, numbered 1 to `expected` and ended by END; error says why not, or is null."""
    body = F.regexp_replace(F.substring_index(text, END, 1), r"(?U)\s+$", "")
    numbers = F.transform(F.regexp_extract_all(body, F.lit(ITEM), F.lit(1)), lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))
    wanted = F.when(expected > 0, F.transform(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), lambda i: i.cast("string")))
    pieces = F.split(body, ITEM, -1)
    items = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    error = F.when(F.coalesce(finish, F.lit("")) == "length", "truncated").when(~F.coalesce(F.contains(text, F.lit(END)), F.lit(False)), "no end mark")
    error = error.when(F.size(numbers) == 0, "no items").when(~F.coalesce(numbers == wanted, F.lit(False)), "wrong numbering").when(F.exists(items, lambda x: x == ""), "empty item")
    return F.struct(error.alias("error"), F.when(error.isNull(), items).alias("translations"))
