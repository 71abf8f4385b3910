"""hubflow — Spark-native analytics for freight corridor and hub networks.

Every public operator is a pure function: DataFrame(s) and parameters in,
DataFrame out.  Nothing is collected to the driver except one-row
parameter frames that steer iterative graph loops.
"""

__version__ = "0.1.0"
