"""twinlake: table comparison, read-only SQL gateway and catalog tools on Spark."""

__version__ = "0.1.0"
