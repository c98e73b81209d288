"""Code dictionaries used by the energy-market cleaning jobs.

FIXED VALUES: the mappings below must equal the source project's dictionaries
for results to match (region names in three spellings, price-area codes, month
names, plant types).  They are stated as plain data, in natural order.
"""

# --- fixed values (energy data code dictionaries) --------------------------
REGION_ENGLISH = {
    "South-East": "SE/CW",
    "North": "N",
    "South": "S",
    "North-East": "NE",
}
REGION_PRICE_AREA = {
    "BRAZIL_SOUTHEAST_CENTRALWEST": "SE/CW",
    "BRAZIL_NORTH": "N",
    "BRAZIL_SOUTH": "S",
    "BRAZIL_NORTHEAST": "NE",
}
REGION_HYDRO_LOCATION = {
    "Brazil-Southeast/Central-West": "SE/CW",
    "Brazil-North": "N",
    "Brazil-South": "S",
    "Brazil-Northeast": "NE",
}
REGION_WIND = {
    "Nordeste": "NE",
    "Norte": "N",
    "Sul": "S",
}
MONTH_NUMBER = {
    "January": 1, "February": 2, "March": 3, "April": 4,
    "May": 5, "June": 6, "July": 7, "August": 8,
    "September": 9, "October": 10, "November": 11, "December": 12,
}
REGION_PORTUGUESE = {
    "Sudeste/Centro-Oeste": "SE/CW",
    "Norte": "N",
    "Sul": "S",
    "Nordeste": "NE",
}
PLANT_TYPE = {
    "HIDROELÉTRICA": "Hydroelectric",
    "TÉRMICA": "Thermal",
    "EOLIELÉTRICA": "Wind",
    "NUCLEAR": "Nuclear",
    "FOTOVOLTAICA": "Solar",
}
REGION_CAPACITY = {
    "SE": "SE/CW",
    "N": "N",
    "S": "S",
    "NE": "NE",
}
ENERGY_REGIONS = ["N", "NE", "S", "SE/CW"]
EXCLUDED_AREA_CODES = ["PY", "BRAZIL_SIN"]
# --- end of fixed values ----------------------------------------------------

# Stand-in dictionary for the driver tables (region.r_name).  MIDDLE EAST is
# deliberately left out so the "unmapped value" paths are exercised.
DRIVER_REGION_CODE = {
    "AFRICA": "AF",
    "AMERICA": "AM",
    "ASIA": "AS",
    "EUROPE": "EU",
}
DRIVER_REGIONS = ["AF", "AM", "AS", "EU", "MIDDLE EAST"]
