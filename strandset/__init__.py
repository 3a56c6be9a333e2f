"""Duplicate marking for sequencing alignments, declared as Spark plans."""
