"""Readers and writers of waveform containers and feature tables, on Spark's own file listing."""
