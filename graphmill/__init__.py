"""graphmill: analytics over graphs of source symbols and the text around them, on Spark.

Relations in, relations out: every operator takes DataFrames and returns a
DataFrame, so Catalyst sees the plan; the few iterative operators write their
rounds to the shared checkpoint folder (:mod:`graphmill.workspace`).
"""

__version__ = "0.1.0"
