"""Public-transport analytics as Spark DataFrame jobs.

Raw files land in bronze tables (``streaming``), are flattened and normalised
(``operators``), and become filtered datasets, KPIs, distributions, rankings and
a delay model (``operators``, ``plans``). Everything takes and returns lazy
DataFrames.
"""

__version__ = "0.1.0"
