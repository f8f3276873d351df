"""strideframe: a Spark-native warehouse and analytics library for wearable-sensor data.

Layers (all lazy DataFrames, planned by Catalyst):
    sources   -> text-typed landing files (or a binding derived from driver tables)
    operators -> staging casts, cleaning rules + audit, marts, insight queries,
                 dashboard slices, statistics, profiling, persona model, checks
    plans     -> the warehouse build and the query catalogue
"""
from strideframe.config import StudyConfig

__all__ = ["StudyConfig"]
__version__ = "0.1.0"
