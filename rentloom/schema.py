"""Column names, constants and patterns of the listing model.

Everything below is a fixed value: results only agree with existing listing
files, replies and tables when these names, lists, limits and patterns are kept.
"""

from __future__ import annotations

# --- fixed values: listing columns -----------------------------------------
ROW_ID = "ID"
INDEX = "Index"
DATE = "Date"
ADDRESS = "Address"
PRICE = "Price"
CURRENCY = "Currency"
DURATION = "Duration"
FLOOR = "Floor"
FLOORS = "Floors"
FLOOR_AREA = "Floor_area"
ROOMS = "Rooms"
BATHROOMS = "Bathrooms"
CEILING_HEIGHT = "Ceiling_height"
RENOVATION = "Renovation"
CONSTRUCTION = "Construction"
NEW_CONSTRUCTION = "New Construction"
ELEVATOR = "Elevator"
FURNISHED = "Furnished"
BALCONY = "Balcony"
CHILDREN_WELCOME = "Children Welcome"
PETS_ALLOWED = "Pets Allowed"
UTILITY_PAYMENTS = "Utility Payments"
AMENITIES = "Amenities"
APPLIANCES = "Appliances"
PARKING = "Parking"
MONTHLY_USD_PRICE = "Monthly USD Price"
PRICE_BAND = "Price Band"
PRICE_CHANGE = "Price Change"
EXCLUSION_ID = "EXCLUDED_ID"
REASON = "REASON"
PLACE = "Place"
DISTANCE = "Distance From Centre of Yerevan"
PII_COLUMNS = ["Reg_id", "Gender", "Age"]

# --- fixed values: address columns -----------------------------------------
TRANSLATED = "Translated"
BUILDING = "Building"
STREET = "Street"
STREET_NUMBER = "Street Number"
TOWN = "Town"
VILLAGE = "Village"
BLOCK = "Block"
LANE = "Lane"
UNIT = "Administrative District"
NEIGHBOURHOOD = "Neighbourhood"
PROVINCE = "Province"
COUNTRY = "Country"
LATITUDE = "Latitude"
LONGITUDE = "Longitude"
ADDRESS_COLUMNS = [BUILDING, STREET, STREET_NUMBER, TOWN, BLOCK, LANE, UNIT, NEIGHBOURHOOD, PROVINCE, COUNTRY]

# --- fixed values: raw header -> short header ------------------------------
HEADERS = {
    "Children_are_welcome": CHILDREN_WELCOME,
    "Pets_allowed": PETS_ALLOWED,
    "Utility_payments": UTILITY_PAYMENTS,
    "New_construction": NEW_CONSTRUCTION,
    "Floors_in_the_building": FLOORS,
    "Number_of_rooms": ROOMS,
    "Number_of_bathrooms": BATHROOMS,
    "Furniture": FURNISHED,
    "Construction_type": CONSTRUCTION,
    "Datetime": DATE,
    "amenities": AMENITIES,
    "appliances": APPLIANCES,
    "parking": PARKING,
}

# --- fixed values: list families, their column prefixes and rank columns ----
FAMILY_PREFIX = {AMENITIES: "1_", APPLIANCES: "2_", PARKING: "3_"}
FAMILY_RANK = {AMENITIES: "Amenities_Rank", APPLIANCES: "Appliances_Rank", PARKING: "Parking_Rank"}
DROPPED_ITEMS = {AMENITIES: ["Parking Space"]}

# --- fixed values: limits ---------------------------------------------------
NUMERIC_SHARE = 0.8
TRIM_LOW, TRIM_HIGH = 0.01, 0.99
FUZZY_CUTOFF = 90
BAND_EDGES = [0, 800, 2000]
BAND_LABELS = ["Cheap", "Affordable", "Expensive"]
MIN_AREA = 10
NO_RENOVATION = "No Renovation"
CITY_CENTRE = (40.1792, 44.4991)
EARTH_RADIUS_KM = 6371.009
BATCH_ITEMS = 128
BATCH_BYTES = 70_000
AZURE_MIN_SCORE = 0.70

# --- fixed values: country boxes, west, south, east, north -------------------
COUNTRY_BOXES = {
    "Armenia": (43.58, 38.74, 46.51, 41.25),
    "Georgia": (39.96, 41.06, 46.64, 43.55),
    "Azerbaijan": (44.79, 38.27, 50.39, 41.86),
}

# --- fixed values: exclusion reasons ----------------------------------------
R_DATE = "Date was Missing"
R_ADDRESS = "Address was Missing"
R_PRICE = "Price was Missing"
R_FLOOR = "The floor exceeds the number of floors in the building"
R_BATHROOMS = "There were more bathrooms than rooms"
R_AREA = "The area in square metres is 10 or less"
R_CEILING = "The ceiling height was missing or 0"
R_PRICE_TRIM = "The price was outside the 1% to 99% range for its currency and duration"
R_AREA_TRIM = "The floor area was outside the 1% to 99% range"
R_DUPLICATE = "Row was a duplicate"
R_RATE = "The exchange rate was missing"
R_USD_TRIM = "The monthly USD price was outside the 1% to 99% range"

# --- fixed values: what a profile's value axis is called, by method ------------
VALUE_LABELS = {
    "absolute": "Price Change (USD)",
    "percent": "Price Change (%)",
    "log": "Log Price Change",
    "mean": "Average Price",
    "median": "Average Price",
    None: "Monthly USD Price",
}

# --- fixed values: cells read as missing -------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: date formats, tried in this order, day first ---------------
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd",
    "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "d/M/yyyy HH:mm", "d/M/yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
]

# --- fixed values: text patterns (Java syntax) --------------------------------
UNICODE_SPACE = r"\t\n\x0B\f\r \x1c\x1d\x1e\x1f\x85\p{Z}"
FILLER = rf"_|[{UNICODE_SPACE}]+|(?i:none)"
ORDINAL_SUFFIX = "(st|nd|rd|th)"
AREA_SUFFIX = r"(?:district|micro[-\s]?district|micro|neighborhood|quarter)"
ORDINAL = rf"(?i)(\d+)-?{ORDINAL_SUFFIX}"
CODE_WITH_LETTER = r"\b(\d{1,5})\s+([A-Za-z])\b"
STREET_WORD = r"(?i)\b(st\.?|street|str|srteet|stret\.?)\b"
HIGHWAY_WORD = r"(?i)\b(hwy|highway)\b"
AVENUE_WORD = r"(?i)\b(ave|avenue|avenu)\b"
NUMBERED_AREA = rf"(?i)\b(\d+)[\s\-]*({AREA_SUFFIX})\b"
BLOCK_PATTERN = rf"(?i)\b(?:[A-Za-z]+(?:[-\s][A-Za-z]+)*\s+)?\d*(?:{ORDINAL_SUFFIX})?\s*(Block|Blok)\b"
LANE_PATTERN = rf"(?i)\b\d+{ORDINAL_SUFFIX}\s+(?:Lane|Alley|Line|Deadlock)\b"
BUILDING_PATTERN = rf"(?i)\b(?!\d{{1,3}}-?{ORDINAL_SUFFIX}\b)\d{{1,3}}(?:[-/]\d+)?[a-zA-Z]?\b"
AREA_PATTERN = rf"(?i)([A-Za-z0-9\-\s]+?\b{AREA_SUFFIX}\b(?:\s+[A-Za-z0-9\-]+)?)"
NUMBERED_STREETS = {"August": "August 23 Street", "Commissars": "26 Commissars Street"}

# --- fixed values: reply labels -> address columns -----------------------------
DISTRICTS = [
    "Ajapnyak", "Avan", "Davtashen", "Erebuni", "Kanaker-Zeytun", "Kentron", "Malatia-Sebastia", "Nor Nork",
    "Nork-Marash", "Nubarashen", "Shengavit", "Arabkir", "Qanaqer-Zeytun",
]
NOMINATIM_LABELS = {
    "house_number": BUILDING,
    "road": STREET,
    "highway": STREET,
    "country": COUNTRY,
    "state": PROVINCE,
    "state_district": UNIT,
    "municipality": UNIT,
    "city": TOWN,
    "town": TOWN,
    "village": VILLAGE,
    "suburb": NEIGHBOURHOOD,
    "neighbourhood": NEIGHBOURHOOD,
    "quarter": NEIGHBOURHOOD,
    "allotments": NEIGHBOURHOOD,
    "subdivision": NEIGHBOURHOOD,
    "city_block": BLOCK,
}
YANDEX_LABELS = {
    "country": COUNTRY,
    "province": PROVINCE,
    "locality": TOWN,
    "street": STREET,
    "house": BUILDING,
    "area": UNIT,
    "district": NEIGHBOURHOOD,
}
POSTAL_LABELS = {
    "house_number": BUILDING,
    "city": TOWN,
    "state_district": UNIT,
    "state": PROVINCE,
    "country": COUNTRY,
}
PROVIDERS_NON_ASCII = ["Yandex", "Nominatim", "Azure"]
PROVIDERS_ASCII = ["Azure", "Nominatim", "Yandex"]

# --- fixed values: relational tables -------------------------------------------
LISTING_TABLE = [ROW_ID, DATE, PRICE, CURRENCY, DURATION]
ADDRESS_TABLE = [ROW_ID, UNIT, PROVINCE, BUILDING, STREET_NUMBER, STREET, BLOCK, LANE, TOWN, NEIGHBOURHOOD]
PROPERTY_TYPES = {
    ROW_ID: "bigint",
    ADDRESS: "bigint",
    NEW_CONSTRUCTION: "boolean",
    FLOOR: "int",
    FLOORS: "int",
    FLOOR_AREA: "int",
    ROOMS: "int",
    BATHROOMS: "int",
    CEILING_HEIGHT: "double",
    RENOVATION: "string",
    CONSTRUCTION: "string",
    BALCONY: "boolean",
    FURNISHED: "boolean",
    ELEVATOR: "boolean",
    CHILDREN_WELCOME: "int",
    PETS_ALLOWED: "int",
    UTILITY_PAYMENTS: "int",
    "Listing": "bigint",
}
LOAD_ORDER = [
    PROVINCE, TOWN, RENOVATION, CONSTRUCTION, CURRENCY, "Exchange Rate", UNIT, "Listing", ADDRESS, "Property",
    AMENITIES, "Property_Amenities", APPLIANCES, "Property_Appliances", PARKING, "Property_Parking",
]
