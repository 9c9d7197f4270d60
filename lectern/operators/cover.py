"""Greedy set cover within groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def greedy(rows: DataFrame, group: str, member: str, element: str, most: int) -> DataFrame:
    """group, member, step, gain: members that add most new elements, ties to the smaller name, until none adds any or
    `most` are picked. A group's rows, the members of one record and their elements, are held in one task."""
    schema = T.StructType([rows.schema[group], rows.schema[member], T.StructField("step", T.IntegerType()), T.StructField("gain", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = pdf.groupby(member)[element].agg(set).to_dict()
        covered: set = set()
        out = []
        while sets and len(out) < most:
            best = min(sets, key=lambda m: (-len(sets[m] - covered), m))
            gain = len(sets.pop(best) - covered)
            if gain == 0:
                break
            covered |= set(pdf.loc[pdf[member] == best, element])
            out.append((pdf[group].iloc[0], best, len(out), gain))
        return pd.DataFrame(out, columns=schema.names)

    return rows.select(group, member, element).groupBy(group).applyInPandas(run, schema)
