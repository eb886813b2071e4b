"""Catalogs of the request domain.

The values below are fixed values: results only match when they are these.
"""

from __future__ import annotations

RECORD_GEOGRAPHIES = ("borough", "community_district")
BOUNDARY_LAYERS = (
    "borough", "community_district", "council_district", "neighborhood_tabulation_area", "census_tract", "zcta",
)
DATASET_IDENTIFIER = "erm2-nwe9"
BOROUGHS = ("BRONX", "BROOKLYN", "MANHATTAN", "QUEENS", "STATEN ISLAND")
BOROUGH_ALIASES = {
    "bronx": "BRONX", "bx": "BRONX",
    "brooklyn": "BROOKLYN", "bk": "BROOKLYN", "kings": "BROOKLYN",
    "manhattan": "MANHATTAN", "mn": "MANHATTAN", "new york": "MANHATTAN", "new york county": "MANHATTAN",
    "queens": "QUEENS", "qn": "QUEENS",
    "staten island": "STATEN ISLAND", "si": "STATEN ISLAND", "richmond": "STATEN ISLAND",
}
LATITUDE_RANGE = (40.4, 41.0)
LONGITUDE_RANGE = (-74.3, -73.6)

#: complaint type -> ordered (topic, keywords); the first rule that matches wins
TOPIC_RULES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "Noise - Residential": (
        ("party_music", ("party", "music", "speakers", "stereo", "bass", "television")),
        ("construction", ("construction", "drilling", "jackhammer")),
        ("pet_noise", ("dog", "barking", "pet")),
        ("banging", ("banging", "thumping", "shaking", "arguing", "hammering")),
    ),
    "Illegal Parking": (
        ("hydrant_blocking", ("hydrant", "fire hydrant")),
        ("crosswalk_blocking", ("crosswalk",)),
        ("bus_stop_blocking", ("bus stop",)),
        ("double_parked", ("double parked", "double parking")),
    ),
    "Blocked Driveway": (
        ("commercial_driveway", ("commercial van", "delivery truck", "truck")),
        ("overnight_blocking", ("overnight", "all night")),
        ("residential_driveway", ("residential driveway", "driveway", "garage")),
    ),
    "Rodent": (
        ("extermination_request", ("exterminator", "extermination", "infestation")),
        ("rats_seen", ("rats", "rat", "trash bags")),
        ("mouse_condition", ("mouse", "mice", "droppings")),
    ),
    "HEAT/HOT WATER": (
        ("no_heat", ("no heat", "without heat", "radiator cold", "heat not working")),
        ("no_hot_water", ("no hot water", "without hot water", "hot water not working")),
        ("intermittent_heat", ("intermittent heat", "heat comes and goes", "heat inconsistent")),
    ),
    "Street Condition": (
        ("pothole", ("pothole", "potholes")),
        ("cave_in", ("cave in", "cave-in", "sinkhole", "collapsed roadway")),
        ("rough_road", ("uneven", "rough road", "broken asphalt", "road surface")),
    ),
    "Noise - Street/Sidewalk": (
        ("construction", ("construction", "drilling", "jackhammer")),
        ("loud_vehicle", ("car alarm", "engine idling", "horn", "vehicle", "muffler")),
        ("bar_noise", ("bar", "club", "restaurant", "patrons", "crowd")),
    ),
    "UNSANITARY CONDITION": (
        ("garbage", ("garbage", "trash", "refuse", "debris")),
        ("sewage", ("sewage", "feces", "human waste", "overflow")),
        ("pest_waste", ("rodent", "rat", "mouse", "droppings", "animal waste")),
    ),
    "Abandoned Vehicle": (
        ("derelict_vehicle", ("abandoned", "derelict", "stripped", "wrecked")),
        ("unlicensed_vehicle", ("no plate", "no registration", "expired registration")),
    ),
}


def supported_topic_queries() -> tuple[str, ...]:
    """Complaint types with built-in topic rules, in alphabetical order."""
    return tuple(sorted(TOPIC_RULES))
