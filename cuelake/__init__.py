"""Timed-text analytics on Spark: transcripts, subtitle cues, text stages and audits as DataFrames."""
