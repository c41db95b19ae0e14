"""Sequence mining, curation and assembly as DataFrame-to-DataFrame functions on Spark."""
