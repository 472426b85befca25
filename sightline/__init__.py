"""sightline: camera stream analytics on Spark.

Frame events are parsed, filtered and reduced to the newest frame per
camera, sampled per detector, scored by pluggable vectorised scorers, and
turned into per-frame results (labels, summary text, top-k classes, rolling
feature windows, as-of predictions, box overlays), as batch DataFrames and
as Structured Streaming queries. See README.md for the operator map.
"""

__version__ = "0.1.0"
