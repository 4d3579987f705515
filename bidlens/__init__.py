"""bidlens — procurement integrity-risk analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   – readers / normalisers for landed inputs (OCDS releases,
                  sanctions sheets, project pages, web pages, media payloads,
                  parquet tables).
* ``functions`` – column expressions (text keys, date parsing, scores).
* ``operators`` – DataFrame -> DataFrame operators (features, graph, model,
                  scoring, evaluation, reports, run log).
* ``plans``     – end-to-end jobs and the test-table adapters.
* ``streaming`` – the row-wise scoring operators wired to Structured Streaming.
"""

from bidlens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
