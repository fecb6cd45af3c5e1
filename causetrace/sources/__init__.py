"""Readers of telemetry payloads, and report sinks."""
