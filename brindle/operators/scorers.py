"""Model scorers as an interface: a function from a DataFrame to one with score columns.

No model weights come with the library. A scorer is loaded once in each Python worker and sees Arrow batches; the two
here are deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of a text that each kind of model reads.
READ_CHARS = {"toxicity": 512, "sentiment": 512, "intent": 1024, "local": 2000, "remote": 3000}
Scorer = Callable[[DataFrame], DataFrame]


def batch_scorer(load: Callable[[], Callable[[list], list]], text: str, out: str, kind: str, chars: int | None = None) -> Scorer:
    """A scorer that adds the column ``out`` of SQL type ``kind``; ``load`` makes the model, which maps texts to values."""

    def score(df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c != out]
        read = F.substring(text, 1, chars) if chars else F.col(text)
        rows = df.select(*names, read.alias("_text"))
        field = StructType.fromDDL(f"{out} {kind}").fields[0]
        schema = StructType([*df.select(*names).schema.fields, field])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            model = load()
            for b in batches:
                values = pa.array(model(b.column(len(names)).to_pylist()), to_arrow_type(field.dataType))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], values], names=[*names, out])

        return rows.mapInArrow(run, schema)

    return score


def column_scorer(**columns) -> Scorer:
    """A scorer that adds the given expressions."""
    return lambda df: df.withColumns(columns)
