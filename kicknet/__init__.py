"""Scoring of benthic macroinvertebrate samples as Spark jobs."""
