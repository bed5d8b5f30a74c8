"""Fixed values of the domain: limits, names and texts that results depend on."""

# Coordinates are centimetres on a square map; both ends belong to it.
COORD_MIN, COORD_MAX = 0.0, 816_000.0
MAP_EXTENT_M = 8_160
CM_PER_M = 100

MAPS = ("ERANGEL", "MIRAMAR")
CAUSES = ("Falling", "Drown")

# Classes of weapons by name.
WEAPON_CLASSES = {
    "Shotgun": ("S686", "S1897", "S12K"),
    "SMG": ("Micro UZI", "UMP9", "Vector", "Tommy Gun"),
    "AR": ("AKM", "M16A4", "M416", "SCAR-L", "AUG", "Groza"),
    "DMR": ("Mini 14", "SKS", "Mk14", "VSS"),
    "SR": ("Kar98k", "M24", "AWM", "Win94"),
    "LMG": ("DP-28", "M249"),
    "Pistol": ("P18C", "P1911", "P92", "R1895", "R45"),
    "Special": ("Crossbow",),
}
# Classes in the order of reports; others come last.
CLASS_ORDER = ("Shotgun", "SMG", "AR", "DMR", "SR", "LMG", "Pistol", "Special")
DISTANCE_MAX_M = 2_000.0
MIN_WEAPON_EVENTS = 10_000

# Short codes and names in reports.
MAP_CODES = {"ERANGEL": "ERA", "MIRAMAR": "MIR"}
MAP_NAMES = {"ERANGEL": "에란겔", "MIRAMAR": "미라마"}
CAUSE_CODES = {"Drown": "DRO", "Falling": "FAL"}
CAUSE_NAMES = {"Drown": "익사", "Falling": "추락"}

# Names of the quality rules, in order.
RULE_NAMES = (
    "DQ-FINAL-ELIGIBILITY-001",
    "DQ-EVENT-ID-001",
    "DQ-MAP-001",
    "DQ-MATCH-001",
    "DQ-COORD-NULL-001",
    "DQ-COORD-002",
    "DQ-COORD-001",
    "DQ-DATE-001",
    "DQ-CAUSE-001",
    "DQ-DUP-001",
)
RULE_VERSION = "1.0.0"
