"""Codes, word lists, calendar figures and series that queries of this domain have to agree on."""

from __future__ import annotations

# States and the capital's district by name.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT",
    "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

# Answers that name nobody.
JUNK = (
    "generic democrat", "generic republican", "generic ballot", "don't know", "dont know", "undecided", "someone else", "other",
    "would not vote", "neither", "no opinion", "refused", "none of these", "skipped", "will not vote", "not sure",
)

# Offices by a word of their name, in the order in which words are looked for.
OFFICES = {"senate": "Senate", "house": "House", "governor": "Governor"}

# By cycle, the president's party, the final generic-ballot margin, and the eve of the cycle before.
CYCLES = [(2018, "REP", 7.8, "2016-11-01"), (2020, "REP", 7.5, "2018-11-01"), (2022, "DEM", 0.7, "2020-11-01"), (2024, "DEM", 0.1, "2022-11-01")]

# Public series by metric (provider, dataset, code, frequency), and the one that counts as change over a year.
SERIES = {
    "unemployment": ("BLS", "ln", "LNS14000000", "M"), "cpi": ("BLS", "cu", "CUSR0000SA0", "M"), "gas": ("EIA", "PET", "EMM_EPMR_PTE_NUS_DPG.M", "M"),
    "fed_funds": ("FED", "H15", "RIFSPFF_N.M", "M"), "cpi_core": ("BLS", "cu", "CUSR0000SA0L1E", "M"), "unemp_u6": ("BLS", "ln", "LNS13327709", "M"),
}
YEARLY_CHANGE = {"cpi": "inflation"}

# Presidential approval by month, January to December.
APPROVAL = {
    2016: (46, 48, 50, 51, 51, 51, 50, 50, 52, 54, 57, 57),
    2017: (45, 43, 40, 41, 40, 39, 38, 37, 38, 38, 38, 39),
    2018: (40, 40, 41, 42, 42, 43, 43, 42, 43, 44, 43, 43),
    2019: (40, 44, 43, 42, 42, 42, 42, 42, 43, 42, 43, 45),
    2020: (44, 44, 45, 46, 43, 41, 41, 42, 43, 45, 45, 45),
    2021: (55, 55, 54, 54, 54, 52, 50, 49, 46, 43, 43, 43),
    2022: (43, 42, 42, 42, 41, 39, 38, 42, 43, 43, 42, 43),
    2023: (43, 42, 42, 42, 40, 41, 41, 42, 40, 40, 40, 39),
    2024: (40, 38, 38, 39, 39, 38, 38, 40, 42, 42, 40, 40),
}


def approval_rows() -> list[tuple[str, float, str]]:
    """(date, value, metric) of the approval series."""
    return [(f"{year}-{month:02d}-01", float(v), "approval") for year, values in APPROVAL.items() for month, v in enumerate(values, 1)]
