"""Structured Streaming: arriving pay files, business-key dedup, windowed KPI."""
