"""usage_trace: where a value is used, directly and through names, across source code, in Spark.

    from usage_trace import trace
    trace(hits, lines)        # one relation of nine columns, as a DataFrame
"""

from usage_trace.plans.trace import trace  # noqa: F401
