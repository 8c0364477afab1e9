"""Reusable DataFrame operators: kernels, bridge, date dimension, profiling, quality."""
