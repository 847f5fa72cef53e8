"""I/O telemetry analytics as PySpark DataFrame operators.

``sources``    raw benchmark results, device captures and logs -> typed tables
``functions``  Column helpers (units, rounding, percent, text, labels)
``operators``  DataFrame-in / DataFrame-out analysis steps
``streaming``  the sample summaries on Structured Streaming
``plans``      end-to-end reports and the registered queries
"""
