"""Explicit schemas, so that no read infers types (ids must stay strings)."""

COORDS = "array<struct<lon:double,lat:double>>"

TRIPS = (
    "tripID string, duration int, travelDis double, speed double, smooth double, slow double, "
    "congested double, verycongested double, unknown double, toll_distance int, tolls int, "
    "traffic_lights int, strategy string"
)

STEPS = (
    "tripID string, instruction string, orientation string, road string, distance int, "
    "tolls int, toll_distance int, toll_road string, duration int, action string, "
    "assistant_action string"
)

POI = "OD int, o string, d string, lon_0 double, lat_0 double, lon_1 double, lat_1 double"

SEGMENT = "lcode string, distance string, status string, polyline string"
STEP = (
    "instruction string, orientation string, road string, distance string, duration string, "
    "tolls string, toll_distance string, toll_road string, action string, "
    f"assistant_action string, polyline string, tmcs array<struct<{SEGMENT}>>"
)
PATH = (
    "distance string, duration string, strategy string, tolls string, toll_distance string, "
    f"traffic_lights string, steps array<struct<{STEP}>>"
)
ROUTE = f"route struct<paths array<struct<{PATH}>>>"

FEATURES = (
    "type string, features array<struct<type string, "
    "properties struct<id int, bridge string>, "
    "geometry struct<type string, coordinates array<array<array<array<double>>>>>>>"
)
