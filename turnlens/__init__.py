"""turnlens — match-telemetry analytics as Spark DataFrame operators.

Every public function takes DataFrames plus column names and returns a
DataFrame; nothing is collected to the driver except tiny, bounded scalars.
"""

__version__ = "0.1.0"
