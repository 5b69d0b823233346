"""Vocabularies and fixed tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The vocabularies that grades, labels and reads are published in.
RELIABILITY_LABELS = {
    "A": "completely reliable",
    "B": "usually reliable",
    "C": "fairly reliable",
    "D": "not usually reliable",
    "E": "unreliable",
    "F": "reliability cannot be judged",
}
CREDIBILITY_LABELS = {
    1: "confirmed by other sources",
    2: "probably true",
    3: "possibly true",
    4: "doubtful",
    5: "improbable",
    6: "truth cannot be judged",
}
TONES = {1: "confirmed", 2: "corroborated", 3: "corroborated", 4: "unclear", 5: "doubtful"}
#: In the order that breaks ties, with the hours in which attention halves and the phrases that tell.
# Issue types with their half-lives and phrases.
ISSUES: dict[str, tuple[int, tuple[str, ...]]] = {
    "flooding": (3, ("flood", "flooding", "flooded", "surface water", "water over", "water is over", "water up", "water across",
                     "water right across", "water is pouring", "water pouring", "under water", "underwater", "submerged",
                     "storm surge", "awash", "inundat", "storm water", "stormwater", "river level", "stream at", "waves",
                     "driftwood", "breach", "burst bank", "drains not coping", "overflow")),
    "fire": (4, ("fire", "smoke", "burning", "alight", "ablaze", "fenz")),
    "slip": (12, ("slip", "landslide", "landslip", "slumped", "debris flow", "rockfall", "bank collapse")),
    "wind": (4, ("gale", "gust", "wind damage", "severe wind", "high wind", "blown", "blew", "storm force", "roofing metal",
                 "roof iron", "sheeting", "torn loose")),
    "tree_down": (12, ("tree down", "trees down", "tree across", "tree on the", "branches everywhere", "large tree")),
    "road_closure": (6, ("road closed", "closure", "closed to traffic", "blocked", "detour", "cordon", "impassable", "gridlock",
                         "backed up", "one lane")),
    "power_outage": (6, ("power out", "power is out", "power cut", "off supply", "outage", "no power", "blackout", "lines down",
                         "wellington electricity")),
    "water_supply": (8, ("water main", "no water", "burst main", "boil water", "water supply", "wellington water")),
    "structural_damage": (48, ("collapse", "cracked", "structural", "roof off", "roof came off", "roof has come off",
                               "building damage", "unsafe building", "red stickered", "facade", "wall down")),
    "injury": (6, ("injured", "injury", "trapped", "casualt", "ambulance", "hurt", "rescue")),
}
OTHER_ISSUE = "other"
OTHER_HALF_LIFE = 12
#: Official sources graded A from the start: (id, kind).
# The sources that are registered from the start.
REGISTRY = (
    ("metservice", "official"),
    ("geonet", "official"),
    ("nzta", "official"),
    ("wcc", "official"),
    ("wcc-duty-officer", "official"),
    ("wremo", "official"),
    ("fenz-media", "official"),
    ("police-media", "official"),
    ("gw-hilltop", "sensor"),
    ("aro-gauge-01", "sensor"),
    ("miramar-anemometer", "sensor"),
)
#: Default map frame: west, south, east, north.
CITY_FRAME = (174.62, -41.36, 174.94, -41.14)
CBD = (174.7762, -41.2865)


def seed_registry(spark: SparkSession) -> DataFrame:
    """The registry as it starts: official feeds and instruments, all A; relays and newsrooms are left out on purpose."""
    return spark.createDataFrame([(s, "A", k) for s, k in REGISTRY], "source string, reliability string, kind string")
