"""Named queries over a folder of Parquet tables."""
