"""tagloom: corpus topics, tags and their evaluation as Spark DataFrame jobs.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame. Nothing is collected to the driver except bounded, size-checked
scalars (e.g. a vocabulary-independent count or a small centroid table).
"""

__version__ = "0.1.0"
