"""Calendar, names, codes and polygons the results depend on."""

# Report order of the eleven cities.
CITY_ORDER = [
    "Hong Kong", "Macao", "Guangzhou", "Shenzhen", "Zhuhai", "Foshan",
    "Huizhou", "Dongguan", "Zhongshan", "Jiangmen", "Zhaoqing",
]

# Period boundaries used by the analysis, and the slightly
# different set the trip consolidation uses.
ANALYSIS_PERIODS = [
    "2019-03-02 12:00:00", "2019-04-02 11:50:00", "2020-05-05 13:50:00",
    "2020-05-15 08:50:00", "2021-12-30 09:00:00",
]
INGEST_PERIODS = [
    "2019-03-02 12:00:00", "2019-04-02 12:00:00", "2020-05-05 14:00:00",
    "2020-05-15 09:00:00", "2021-12-30 09:00:00",
]

# Holiday dates, and the window shown as an extra period.
HOLIDAYS = ["2019-04-04", "2019-04-05"]
HOLIDAY_WINDOW = ("2019-04-04 12:00:00", "2019-04-08 09:00:00")

# Bridge ids, names, and the text that names each bridge.
BRIDGE_NAMES = {1: "Humen bridge", 2: "Nanshan bridge", 3: "HZMB"}
BRIDGE_PATTERNS = [("虎门大桥", 1), ("南沙大桥", 2), ("港珠澳大桥", 3)]

# Traffic status texts and their codes; any other text is 0.
STATUS_CODES = {"畅通": 1, "缓行": 2, "拥堵": 3, "非常拥堵": 4}

# Bridge outlines, longitude and latitude of each ring vertex.
BRIDGE_RINGS = {
    1: [
        (113.595817820213227, 22.786362971811002),
        (113.61763934677569, 22.800750791522518),
        (113.61763934677569, 22.800750791522518),
        (113.620157215225206, 22.797753329082617),
        (113.598575485657932, 22.783485407868699),
        (113.595817820213227, 22.786362971811002),
    ],
    2: [
        (113.554512787791424, 22.888636390260341),
        (113.572977156421203, 22.885219283078857),
        (113.572497562430812, 22.882041972892562),
        (113.55409314304984, 22.885758826318039),
        (113.554512787791424, 22.888636390260341),
    ],
    3: [
        (113.726874291662483, 22.28557963879479),
        (113.811490469956453, 22.286401155088907),
        (113.811490469956453, 22.278733669677155),
        (113.72577893660366, 22.279555185971272),
        (113.726874291662483, 22.28557963879479),
    ],
}

EARTH_RADIUS_KM = 6371.0088
ROUTE_RADIUS_KM = 6371.0

# Attribute order of a finished step row.
STEP_COLUMNS = [
    "OD", "step_id", "tripID", "instruction", "orientation", "road", "distance",
    "tolls", "toll_distance", "toll_road", "duration", "action",
    "assistant_action", "fid", "date", "t",
]

# Names cut to ten characters by the line-feature format.
SHORT_NAMES = {
    "traffic_lig": "traffic_lights",
    "toll_distan": "toll_distance",
    "verycongest": "verycongested",
}
