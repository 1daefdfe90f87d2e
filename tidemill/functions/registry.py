"""Functions for SQL: a table function that cuts text into chunks. An example of extension; ``text.pack_chunks`` is the native one."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import udtf

MOST = 180


def units(text: str) -> list[str]:
    """As ``text.split_units`` does: list items whole, other lines by sentence."""
    out = []
    for line in filter(None, (x.strip() for x in (text or "").split("\n"))):
        if re.match(r"(?:[-*]|\d+\.)\s", line):
            out.append(line)
        elif re.search("[。！？；]", line):
            out += [s for s in (x.strip() for x in re.findall("[^。！？；]+[。！？；]?", line)) if s]
        else:
            out += [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", line)) if s]
    return out


@udtf(returnType=T.StructType([T.StructField("i", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("chunk", T.StringType())]))
class ChunkText:
    """Chunks of a text, as ``text.pack_chunks`` makes them."""

    def eval(self, text: str):
        done, held = 0, ""
        for unit in units(text):
            if held and len(held) + 1 + len(unit) > MOST:
                yield done, len(held), held
                done, held = done + 1, unit
            else:
                held = f"{held}\n{unit}" if held else unit
        if held:
            yield done, len(held), held


def register(spark: SparkSession) -> None:
    """Make it known to the session's SQL: ``tidemill_chunks(text)``."""
    spark.udtf.register("tidemill_chunks", ChunkText)
