"""Packet-capture and training-data analytics expressed as Spark DataFrame jobs."""
