"""GPS pings -> trips -> final approach -> matched streets -> cruising flags, as Spark DataFrames."""
from curbloop.params import Params, REGIONS

__all__ = ["Params", "REGIONS"]
