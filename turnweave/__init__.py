"""turnweave: labelled-time-segment analytics on Spark DataFrames.

operators/  interval, frame, metric, clustering and metadata operators
sources/    readers, writers and adapters of the sample tables
functions/  column expressions (hamming, cosine, half-even rounding, ...)
plans/      multi-operator pipelines (activity detection, diarization, benchmark)
streaming/  Structured Streaming forms of the ordered operators
"""

__version__ = "0.1.0"
