"""Quality analytics over transcript streams, telemetry and corpora, on Spark DataFrames."""
