"""Metering of event streams: sliding limits, daily budgets and windowed series."""
