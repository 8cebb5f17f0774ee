"""Code tables and identifier codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aircraft category by the low four bits of the position type byte; fixed values.
OGN_CATEGORIES = [
    "unknown", "glider", "tow_tug", "rotorcraft", "skydiver_parachute", "landplane", "hang_glider", "paraglider",
    "landplane", "landplane", "unknown", "balloon", "airship", "drone", "unknown", "static_obstacle",
]
#: Airspace type by number; fixed values.
AIRSPACE_TYPES = [
    "other", "restricted", "danger", "prohibited", "ctr", "tmz", "rmz", "tma", "atz", "matz", "airway", "mtr",
    "alert_area", "warning_area", "protected_area", "htz", "glider_prohibited", "glider_sector", "no_gliders",
    "wave_window", "fir", "uir", "adiz", "atz_p", "atz_mbz", "tfr", "tra", "tsa", "fis", "uas", "rffs", "sport",
    "drop_zone", "gliding", "military_ops",
]
ALTITUDE_UNITS = {0: "FT", 1: "FT", 2: "M", 6: "FL"}
ALTITUDE_REFERENCES = {0: "GND", 1: "MSL", 2: "STD"}
ADDRESS_TYPES = ["unknown", "icao", "flarm", "ogn"]
#: Restrictions of restricted-class registrations by their digit; fixed values.
RESTRICTED_OPERATIONS = {
    "0": "other", "1": "ag_pest_control", "2": "aerial_surveying", "3": "aerial_advertising", "4": "forest",
    "5": "patrolling", "6": "weather_control", "7": "carriage_of_cargo",
}


def lookup(code: Column, table: dict | list, otherwise: str | None = None) -> Column:
    pairs = enumerate(table) if isinstance(table, list) else table.items()
    made = F.create_map(*(F.lit(x) for kv in pairs for x in kv))
    return F.coalesce(F.try_element_at(made, code), F.lit(otherwise))


def ogn_category(byte: Column) -> Column:
    return lookup(byte.bitwiseAND(15).cast("int"), OGN_CATEGORIES)


def airspace_type(code: Column) -> Column:
    return lookup(code.cast("int"), AIRSPACE_TYPES, "not_assigned")


def device_id(raw: Column) -> Column:
    """Struct (address, address_type, category) of an 8- or 10-digit hexadecimal id: the last six digits are the address.

    In the short form the leading byte holds aircraft type (bits 2-5) and address type (bits 0-1), in the long form the
    leading two bytes do (bits 10-13 and bits 4-9). Address types without a name are unknown.
    """
    n = F.length(raw)
    head = F.conv(F.substring(raw, F.lit(1), n - 6), 16, 10).cast("int")
    short = n == 8
    kind = F.when(short, head.bitwiseAND(3)).otherwise(F.shiftright(head, 4).bitwiseAND(63))
    craft = F.when(short, F.shiftright(head, 2).bitwiseAND(15)).otherwise(F.shiftright(head, 10).bitwiseAND(15))
    made = F.struct(
        F.conv(F.substring(raw, n - 5, F.lit(6)), 16, 10).cast("int").alias("address"),
        lookup(kind, ADDRESS_TYPES, "unknown").alias("address_type"),
        ogn_category(craft).alias("category"),
    )
    return F.when(raw.rlike("^([0-9A-Fa-f]{8}|[0-9A-Fa-f]{10})$"), made)


_US_BASE, _US_MOST, _US_BLOCK = 0xA00000, 0xADF669, 1 + 26 + 26 * 26
_CA_BASE, _CA_MOST, _CA_BLOCK = 0xC00000, 0xC0CDF8, 26**3
#: Second letters of Canadian marks in the order of their blocks; the second block is not used. Fixed values.
_CA_LETTERS = "FGHI"


def us_registration_to_icao(reg: Column) -> Column:
    """24-bit address of N + 1-999 + up to two letters in the simple block scheme; null for anything else."""
    parts = "^N([0-9]+)([A-Z]{0,2})$"
    up = F.upper(F.trim(reg))
    number = F.regexp_extract(up, parts, 1).try_cast("int")
    letters = F.regexp_extract(up, parts, 2)
    a, b = F.ascii(letters) - 65, F.ascii(F.substring(letters, 2, 1)) - 65
    suffix = F.when(letters == "", 0).when(F.length(letters) == 1, 1 + a).otherwise(27 + a * 26 + b)
    made = _US_BASE + (number - 1) * _US_BLOCK + suffix + 1
    return F.when(up.rlike(parts) & number.between(1, 999) & (made <= _US_MOST), made)


def icao_to_us_registration(icao: Column) -> Column:
    index = icao - _US_BASE - 1
    number, suffix = F.floor(index / _US_BLOCK) + 1, index % _US_BLOCK
    letter = lambda k: F.char(65 + k)
    two = suffix - 27
    letters = (
        F.when(suffix == 0, "").when(suffix <= 26, letter(suffix - 1)).otherwise(F.concat(letter(F.floor(two / 26)), letter(two % 26)))
    )
    return F.when((index >= 0) & number.between(1, 999) & (icao <= _US_MOST), F.concat(F.lit("N"), number.cast("string"), letters))


def canadian_registration_to_icao(reg: Column) -> Column:
    """24-bit address of C, a block letter and three letters; null for anything else and for block G."""
    up = F.upper(F.trim(reg))
    block = F.instr(F.lit(_CA_LETTERS), F.substring(up, 2, 1)) - 1
    at = lambda k: F.ascii(F.substring(up, k, 1)) - 65
    made = _CA_BASE + block * _CA_BLOCK + at(3) * 676 + at(4) * 26 + at(5) + 1
    return F.when(up.rlike("^C[FHI][A-Z]{3}$") & (made <= _CA_MOST), made)


def icao_to_canadian_registration(icao: Column) -> Column:
    index = icao - _CA_BASE - 1
    block, three = F.floor(index / _CA_BLOCK).cast("int"), index % _CA_BLOCK
    letter = lambda k: F.char(65 + k)
    name = F.concat(F.lit("C"), F.substring(F.lit(_CA_LETTERS), block + 1, F.lit(1)), letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26))
    return F.when((index >= 0) & (icao <= _CA_MOST) & (block != 1), name)


def restricted_operations(class_code: Column, raw: Column) -> Column:
    """Names of the restrictions of class 3, in digit order; empty for other classes."""
    found = F.filter(
        F.array(*(F.when(F.contains(raw, F.lit(d)), name) for d, name in RESTRICTED_OPERATIONS.items())), F.isnotnull
    )
    return F.when(class_code == "3", found).otherwise(F.array().cast("array<string>"))
