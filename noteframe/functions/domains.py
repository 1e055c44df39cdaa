"""Domain model constants.

Fixed values (must equal the annotation guideline for results to match):
the canonical domain order, the level scales and the tag names of the
current, week-14 and pilot tag sets.
"""

from __future__ import annotations

# --- fixed values: canonical domain order (positions in the label vector) ---
DOMAINS = ["ADM", "ATT", "BER", "ENR", "ETN", "FAC", "INS", "MBW", "STM"]

# --- fixed values: top of each level scale (top = no problem) ---
LEVEL_MAX = {"ADM": 4, "ATT": 4, "BER": 4, "ENR": 4, "ETN": 4, "FAC": 5,
             "INS": 5, "MBW": 4, "STM": 4}

LEVEL_COLS = [f"{d}_lvl" for d in DOMAINS]
FLAG_COLS = ["disregard", "target", "background", "plus"]

# --- fixed values: tag names of the current tag set, in file order ---
TAGSET_CURRENT = [
    ".B140: ATT", ".B152: STM", ".B440: ADM", ".B455: INS", ".B530: MBW",
    ".D550: ETN", ".B1300: ENR", ".D450: FAC", ".D840-D859: BER",
    "att0", "att1", "att2", "att3", "att4",
    "stm0", "stm1", "stm2", "stm3", "stm4",
    "adm0", "adm1", "adm2", "adm3", "adm4",
    "ins0", "ins1", "ins2", "ins3", "ins4", "ins5",
    "mbw0", "mbw1", "mbw2", "mbw3", "mbw4",
    "etn0", "etn1", "etn2", "etn3", "etn4",
    "enr0", "enr1", "enr2", "enr3", "enr4",
    "fac0", "fac1", "fac2", "fac3", "fac4", "fac5",
    "ber0", "ber1", "ber2", "ber3", "ber4",
    "mbw_plus", "other_disregard_file", "other_target", "other_background",
]

# --- fixed values: week-14 tag set (has MBW, lacks ETN), in file order ---
TAGSET_WEEK14 = [
    ".B140: ATT", ".B152: STM", ".B440: ADM", ".B455: INS", ".B530: MBW",
    ".B1300: ENR", ".D450-D469: FAC", ".D840-D859: BER",
    "att0", "att1", "att2", "att3", "att4",
    "stm0", "stm1", "stm2", "stm3", "stm4",
    "adm0", "adm1", "adm2", "adm3", "adm4",
    "ins0", "ins1", "ins2", "ins3", "ins4", "ins5",
    "mbw0", "mbw1", "mbw2", "mbw3", "mbw4",
    "enr0", "enr1", "enr2", "enr3", "enr4",
    "fac0", "fac1", "fac2", "fac3", "fac4", "fac5",
    "ber0", "ber1", "ber2", "ber3", "ber4",
    "mbw_plus", "other_disregard_file", "other_target", "other_background",
]

# --- fixed values: pilot tag set, in file order ---
TAGSET_PILOT = [
    ".B152: Stemming", ".B455: Inspanningstolerantie",
    ".D450: Lopen en zich verplaatsen", ".D840-859: Beroep en werk",
    "BER 0", "BER 1", "BER 2", "BER 3", "BER 4",
    "FAC 0", "FAC 1", "FAC 2", "FAC 3", "FAC 4", "FAC 5",
    "INS 0", "INS 1", "INS 2", "INS 3", "INS 4", "INS 5",
    "STM 0", "STM 1", "STM 2", "STM 3", "STM 4",
    "disregard_file", "info_Third party", "lop_hulpmiddel", "stm_reaction",
    "target", "type_Background", "type_Implicit", "view_Patient",
    "view_Third party",
]

# --- fixed values: pilot domain codes -> domain ---
PILOT_CODE_MAP = {".B152": "STM", ".B455": "INS", ".D450": "FAC",
                  ".D840-859": "BER"}
PILOT_DOMAINS = ["BER", "FAC", "INS", "STM"]
PILOT_FLAGS = {"disregard": "disregard_file", "target": "target",
               "background": "type_Background"}

# --- fixed values: metadata implied by the two legacy file-name conventions ---
LEGACY8_DEFAULTS = {"year": "2020", "batch": "pilot"}
LEGACY_ROWREF_DEFAULTS = {"institution": "vumc", "year": "2017", "MDN": "", "batch": "pilot"}

# domain tag of each domain in the current tag set (derived from the list)
DOMAIN_TAG = {t[-3:]: t for t in TAGSET_CURRENT if t.startswith(".")}
