"""Set-at-a-time triage of cloud security findings on Spark DataFrames."""
