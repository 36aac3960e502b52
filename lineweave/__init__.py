"""Program-to-table lineage over large archives of job scripts, on Spark DataFrames."""
