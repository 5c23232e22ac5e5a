"""quarry: agent-session analytics and evaluation statistics on Spark DataFrames."""
