"""Palette colour tables: the ladder of checks, descriptors, and entries as 8-bit channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.errors import FORMAT, UNSUPPORTED, error, first_error
from pixelloom.functions import values as V
from pixelloom.functions.dictionaries import tag_text
from pixelloom.operators.dataset import element, getters
from pixelloom.session import bound, once

CHANNELS = ("Red", "Green", "Blue")


def _name(channel: str, what: str) -> str:
    return f"{channel}PaletteColorLookupTable{what}"


def descriptor(e: Column, signed_pixels: Column) -> Column:
    """struct<n, first, bits>: entries (0 means 65,536), first mapped value (signed with signed pixels or VR SS), bits of an entry."""
    b, little = e["value_bytes"], e["is_little_endian"]
    n = V.unsigned(b, 0, 2, little)
    first = F.when(signed_pixels | (e["vr"] == "SS"), V.signed(b, 2, 2, little)).otherwise(V.unsigned(b, 2, 2, little))
    return F.struct(F.when(n == 0, F.lit(65536)).otherwise(n).cast("int").alias("n"), first.cast("int").alias("first"), V.unsigned(b, 4, 2, little).cast("int").alias("bits"))


def entries(x: Column) -> Column:
    """A channel's entries as bytes, of struct<bytes, little, n, bits>: 8-bit ones as they are, 16-bit ones by their high byte."""
    high = F.when(x["little"], F.lit(2)).otherwise(F.lit(1))
    wide = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.hex(F.substring(x["bytes"], i * 2 + high, F.lit(1)))), ""))
    return F.when(x["bits"] == 8, F.substring(x["bytes"], F.lit(1), x["n"])).otherwise(wide)


@once
def palette(column: str = "dataset") -> Column:
    """struct<table, error> of the data set map in `column`: struct<n, first, bits, r, g, b>, or the error of the first check that fails.

    Each element is looked up and each descriptor read once; all checks refer to what was found.
    """
    dataset = F.col(column)
    signed_pixels = getters(column)["is_signed"]
    absent = F.lit(None).cast("struct<n: int, first: int, bits: int>")
    found = []
    for c in CHANNELS:
        described, data = element(dataset, _name(c, "Descriptor")), element(dataset, _name(c, "Data"))
        d = F.when(F.octet_length(described["value_bytes"]) >= 6, descriptor(described, signed_pixels)).otherwise(absent)
        found.append(F.struct(described.isNotNull().alias("described"), described["tag"].alias("tag"), F.octet_length(described["value_bytes"]).alias("size"), d.alias("d"), data["value_bytes"].alias("bytes"), data["is_little_endian"].alias("little")).alias(c))
    segmented = F.lit(False)
    for c in CHANNELS:
        segmented = segmented | element(dataset, f"Segmented{_name(c, 'Data')}").isNotNull()
    enhanced = element(dataset, "EnhancedPaletteColorLookupTableSequence").isNotNull()
    return bound(F.struct(*found, segmented.alias("segmented"), enhanced.alias("enhanced")), _checked)


def _checked(x: Column) -> Column:
    undirect = x["Red"]["bytes"].isNull() | x["Green"]["bytes"].isNull() | x["Blue"]["bytes"].isNull()
    direct = "Only direct Palette Color LUT Data (0028,1201-1203) is supported."
    checks = [
        (x["segmented"] & undirect, error(UNSUPPORTED, f"Segmented Palette Color Lookup Table Data (0028,1221-1223) is unsupported. {direct}")),
        (x["enhanced"] & undirect, error(UNSUPPORTED, f"Enhanced Palette Color Lookup Table Sequence (0028,140B) is unsupported. {direct}")),
    ]
    for what, number, missing in (("Descriptor", 0x1101, lambda c: ~x[c]["described"]), ("Data", 0x1201, lambda c: x[c]["bytes"].isNull())):
        for i, c in enumerate(CHANNELS):
            checks.append((missing(c), error(FORMAT, f"PALETTE COLOR dataset missing {c} Palette Color Lookup Table {what} (0028,{number + i:04X}).")))
    for c in CHANNELS:
        short = F.concat(F.lit("Incomplete Palette Color LUT descriptor ("), tag_text(x[c]["tag"]), F.lit("): expected at least 6 bytes, found "), x[c]["size"].cast("string"), F.lit(" bytes."))
        checks.append((x[c]["size"] < 6, error(FORMAT, short)))
        checks.append((~x[c]["d"]["bits"].isin(8, 16), error(FORMAT, F.concat(F.lit("Invalid Palette Color LUT bitsPerEntry: "), x[c]["d"]["bits"].cast("string"), F.lit(". Must be 8 or 16.")))))
    d = x["Red"]["d"]
    checks.append(((d != x["Green"]["d"]) | (d != x["Blue"]["d"]), error(FORMAT, "Inconsistent Palette Color LUT descriptors across red, green and blue.")))
    need = d["n"] * F.floor(d["bits"] / 8)
    for c in CHANNELS:
        have = F.octet_length(x[c]["bytes"])
        checks.append((have < need, error(FORMAT, F.concat(F.lit(f"Truncated {c} Palette Color LUT data: expected at least "), need.cast("string"), F.lit(" bytes, found "), have.cast("string"), F.lit(".")))))
    failed = first_error(*[(F.coalesce(cond, F.lit(False)), e) for cond, e in checks])
    channel = lambda c: entries(F.struct(x[c]["bytes"].alias("bytes"), x[c]["little"].alias("little"), d["n"].alias("n"), d["bits"].alias("bits")))
    return bound(failed, lambda e: F.struct(F.when(e.isNull(), F.struct(d["n"].alias("n"), d["first"].alias("first"), d["bits"].alias("bits"), *(channel(c).alias(c[0].lower()) for c in CHANNELS))).alias("table"), e.alias("error")))
