"""mailguard: e-mail threat analytics as Spark DataFrame jobs.

Sub-packages
------------
functions   Column -> Column expressions (headers, content, URLs, IP math, text).
operators   DataFrame -> DataFrame jobs (feature plan, lookups, profiles,
            data-set building, metrics, text mining, clustering, ML stages).
sources     Readers and writers (driver tables, fixture view, .eml corpus, CSV,
            Parquet, legacy JSON, model files).
plans       Named queries with DuckDB oracle SQL (used by ``__spark_entry__``).
streaming   Structured Streaming scoring and monitoring jobs.
"""

__version__ = "0.1.0"
