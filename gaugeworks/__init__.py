"""gaugeworks: DataFrame operators for meter, sensor, host, listing and event data."""

__version__ = "0.1.0"
