"""Structured Streaming jobs: traffic, flow sessions, alerts, drift, scoring."""
