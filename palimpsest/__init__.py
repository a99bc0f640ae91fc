"""Analytics over coding-agent transcripts and telemetry, as Spark DataFrames."""
