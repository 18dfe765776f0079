"""marlstone: catalogue, event-log and corpus operators on Spark DataFrames."""
