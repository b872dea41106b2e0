"""Readers and writers of the file formats; all go through Spark, so any store that Spark reads will do."""
