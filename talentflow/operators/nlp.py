"""Token-level NLP operators (C8b lemma lookup)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lemmatize(df: DataFrame, id_cols: list[str], tokens: str, lemmas: DataFrame,
              form: str = "form", lemma: str = "lemma") -> DataFrame:
    """Replace every token that has an entry in ``lemmas`` (form -> lemma).

    Tokens are exploded with their position, left-joined to the lemma table
    (AQE broadcasts it when its measured size is small, otherwise a shuffle
    join), and re-assembled per row in position order. A row's token list is
    bounded by that row's text. Rows without tokens keep an empty list.
    """
    lem = lemmas.select(F.col(form).alias("__w"), F.col(lemma).alias("__l")).dropDuplicates(["__w"])
    ex = df.select(*id_cols, F.posexplode(tokens).alias("__p", "__w"))
    j = ex.join(lem, "__w", "left")
    agg = (j.groupBy(*id_cols)
            .agg(F.array_sort(F.collect_list(F.struct("__p", F.coalesce("__l", "__w").alias("w"))))
                 .alias("__s")))
    out = df.join(agg, id_cols, "left")
    return (out.withColumn(tokens, F.coalesce(F.transform("__s", lambda s: s["w"]),
                                              F.array().cast("array<string>")))
               .drop("__s"))
