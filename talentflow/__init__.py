"""talentflow: column-parameterised Spark operators for recruitment-style data.

Sub-packages
------------
functions   Column -> Column helpers (type coercion, text cleaning, extraction).
operators   DataFrame -> DataFrame operators (resolve, profile, dedup, TF-IDF,
            matching, ML).
sources     readers and sinks (CSV/Parquet/JSON/text), schemas.
plans       analytic queries, recruitment presets, end-to-end pipelines and
            the bindings of every operator to the driver's test tables.
streaming   the stateless Column functions applied to a streaming DataFrame.
"""

from talentflow.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
