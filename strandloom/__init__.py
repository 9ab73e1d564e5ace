"""Pose-pool analytics on Spark.

A *pose* is one discretised placement of a library fragment: a conformer, a
rotamer of that conformer and an integer grid translation.  A *pool* is a bag
of poses with a canonical total order whose position is the pose id.  Everything
in this package takes and returns Spark DataFrames.
"""

__version__ = "0.1.0"
