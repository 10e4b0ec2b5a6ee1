"""Embedding as batch inference.

Two kinds of embedder share one interface:

* ``HashEmbedder`` - native column expression, no Python in the task.
* ``ModelEmbedder`` - an injected model (``texts -> vectors``), run through
  an iterator pandas UDF so the model is built once per Python worker and
  fed Arrow batches of ``batch_size`` texts.
"""


from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import cap, col_
from issuelens.functions.vector import hash_embed


class HashEmbedder:
    def __init__(self, dim: int = 64):
        self.dim = dim

    def name(self) -> str:
        return f"hash-md5-{self.dim}"

    def column(self, text: Column | str) -> Column:
        return hash_embed(text, self.dim)


class ModelEmbedder:
    """Wraps ``factory() -> model`` where ``model(list[str]) -> list[list[float]]``."""

    def __init__(self, factory: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]],
                 model_name: str, batch_size: int = C.BATCH_SIZE):
        self.factory = factory
        self.model_name = model_name
        self.batch_size = batch_size

    def name(self) -> str:
        return self.model_name

    def column(self, text: Column | str) -> Column:
        factory, batch = self.factory, self.batch_size

        @F.pandas_udf("array<double>")
        def _embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for s in it:
                texts = s.fillna("").tolist()
                out: list = []
                for i in range(0, len(texts), batch):
                    got = list(model(texts[i:i + batch]))
                    if len(got) != len(texts[i:i + batch]):
                        raise ValueError("embedding model returned a wrong number of vectors")
                    out.extend(got)
                yield pd.Series([list(map(float, v)) if v is not None else None for v in out])

        return _embed(col_(text))


def embed(df: DataFrame, embedder, text_col: str = "text",
          max_chars: int | None = C.EMBED_MAX_CHARS, out_col: str = "embedding") -> DataFrame:
    """Cap the text, embed it, fail on missing vectors, tag the model."""
    vec = embedder.column(cap(text_col, max_chars))
    checked = F.when(F.coalesce(F.size(vec), F.lit(0)) > 0, vec).otherwise(
        F.raise_error(F.lit(f"embedder {embedder.name()} returned no embedding")).cast("array<double>"))
    return df.withColumn(out_col, checked).withColumn("embed_model", F.lit(embedder.name()))


def check_model(collection: DataFrame, embedder) -> Column:
    """Predicate that every row was embedded with ``embedder``."""
    return F.col("embed_model") == F.lit(embedder.name())
