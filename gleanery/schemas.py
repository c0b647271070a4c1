"""The tables' types. Item texts use '' for missing, never null; ``seq`` carries the order that first-wins rules need."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM_TEXTS = (
    "stockId stock url website dealerId title style year make model color vin primaryImage price vehicleListPrice mileage engine cylinders horsepower torque "
    "transmission transmissionType driveType fuelType fuelCapacity fuelEconomy milesPerGallon milesPerLiter cityMPG highwayMPG cityMPL highwayMPL bodyType "
    "seatInfo passengerCapacity tireInfo frontTire rearTire wheelInfo frontWheel rearWheel"
).split()
ITEM_ARRAYS = ("images", "photoURLs")
ITEM = T.StructType([*[T.StructField(n, T.StringType()) for n in ITEM_TEXTS], *[T.StructField(n, T.ArrayType(T.StringType())) for n in ITEM_ARRAYS]])
PAGE = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("page_seq", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("run_id", "code", "message", "itemUrl")])
