"""Streams. Each function takes and returns streaming frames; ``run`` writes one out.

A watermark delay is an argument everywhere (default one minute); rows that come later
than that are dropped.
"""
