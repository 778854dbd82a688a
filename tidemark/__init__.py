"""tidemark: Spark jobs that turn change-data-capture streams into trusted tables.

Change records land as immutable Parquet, each landing date is published as a
validated run, and published records are parsed into history and current state.
"""
