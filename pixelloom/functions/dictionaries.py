"""Lookups: data element tags, value representations, transfer syntaxes, photometric interpretations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tag, value representation, keyword and name of the elements with a dictionary entry.
TAGS = """
00020000 UL FileMetaInformationGroupLength File Meta Information Group Length
00020001 OB FileMetaInformationVersion File Meta Information Version
00020002 UI MediaStorageSOPClassUID Media Storage SOP Class UID
00020003 UI MediaStorageSOPInstanceUID Media Storage SOP Instance UID
00020010 UI TransferSyntaxUID Transfer Syntax UID
00080016 UI SOPClassUID SOP Class UID
00080018 UI SOPInstanceUID SOP Instance UID
00080020 DA StudyDate Study Date
00080021 DA SeriesDate Series Date
00080030 TM StudyTime Study Time
00080031 TM SeriesTime Series Time
00080032 TM AcquisitionTime Acquisition Time
00080060 CS Modality Modality
00080070 LO Manufacturer Manufacturer
00080080 LO InstitutionName Institution Name
00081030 LO StudyDescription Study Description
0008103E LO SeriesDescription Series Description
00081110 SQ ReferencedStudySequence Referenced Study Sequence
00081115 SQ ReferencedSeriesSequence Referenced Series Sequence
00081140 SQ ReferencedImageSequence Referenced Image Sequence
00100010 PN PatientName Patient's Name
00100020 LO PatientID Patient ID
00100030 DA PatientBirthDate Patient's Birth Date
00100040 CS PatientSex Patient's Sex
00180050 DS SliceThickness Slice Thickness
0020000D UI StudyInstanceUID Study Instance UID
0020000E UI SeriesInstanceUID Series Instance UID
00200011 IS SeriesNumber Series Number
00200013 IS InstanceNumber Instance Number
00280002 US SamplesPerPixel Samples per Pixel
00280004 CS PhotometricInterpretation Photometric Interpretation
00280006 US PlanarConfiguration Planar Configuration
00280008 IS NumberOfFrames Number of Frames
00280010 US Rows Rows
00280011 US Columns Columns
00280030 DS PixelSpacing Pixel Spacing
00280100 US BitsAllocated Bits Allocated
00280101 US BitsStored Bits Stored
00280102 US HighBit High Bit
00280103 US PixelRepresentation Pixel Representation
00280120 SS PixelPaddingValue Pixel Padding Value
00280121 SS PixelPaddingRangeLimit Pixel Padding Range Limit
00281050 DS WindowCenter Window Center
00281051 DS WindowWidth Window Width
00281052 DS RescaleIntercept Rescale Intercept
00281053 DS RescaleSlope Rescale Slope
00281054 LO RescaleType Rescale Type
00281101 US RedPaletteColorLookupTableDescriptor Red Palette Color Lookup Table Descriptor
00281102 US GreenPaletteColorLookupTableDescriptor Green Palette Color Lookup Table Descriptor
00281103 US BluePaletteColorLookupTableDescriptor Blue Palette Color Lookup Table Descriptor
00281104 US AlphaPaletteColorLookupTableDescriptor Alpha Palette Color Lookup Table Descriptor
00281201 OW RedPaletteColorLookupTableData Red Palette Color Lookup Table Data
00281202 OW GreenPaletteColorLookupTableData Green Palette Color Lookup Table Data
00281203 OW BluePaletteColorLookupTableData Blue Palette Color Lookup Table Data
00281204 OW AlphaPaletteColorLookupTableData Alpha Palette Color Lookup Table Data
00281221 OW SegmentedRedPaletteColorLookupTableData Segmented Red Palette Color Lookup Table Data
00281222 OW SegmentedGreenPaletteColorLookupTableData Segmented Green Palette Color Lookup Table Data
00281223 OW SegmentedBluePaletteColorLookupTableData Segmented Blue Palette Color Lookup Table Data
0028140B SQ EnhancedPaletteColorLookupTableSequence Enhanced Palette Color Lookup Table Sequence
00400275 SQ RequestAttributesSequence Request Attributes Sequence
0040A730 SQ ContentSequence Content Sequence
7FE00010 OW PixelData Pixel Data
"""
DICTIONARY: dict[int, tuple[str, str, str]] = {int(t, 16): (vr, keyword, name) for t, vr, keyword, name in (line.split(" ", 3) for line in TAGS.strip().splitlines())}
TAG = {keyword: tag for tag, (_, keyword, _) in DICTIONARY.items()}
#: Tags that are read by name but have no dictionary entry.
TAG |= {"AcquisitionDate": 0x00080022, "ContentDate": 0x00080023, "PatientAge": 0x00101010, "StudyID": 0x00200010, "SmallestImagePixelValue": 0x00280106, "LargestImagePixelValue": 0x00280107, "WindowCenterWidthExplanation": 0x00281055}

#: Known value representations, and those whose explicit header has a 32-bit length.
VRS = "AE AS AT CS DA DS DT FL FD IS LO LT OB OD OF OL OW PN SH SL SQ SS ST TM UC UI UL UN US UT".split()
LONG_VRS = "OB OD OF OL OW SQ UC UN UT".split()
#: Long headers in the standard too; without them a stream with such an element is misread from there on.
LONGER_VRS = "OV SV UR UV".split()
UNKNOWN = "UNKNOWN"

IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE, RLE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.5"
#: UID, name, explicit VR, little endian, encapsulated.
SYNTAXES: list[tuple[str, str, bool, bool, bool]] = [
    (IMPLICIT_LE, "Implicit VR Little Endian", False, True, False),
    (EXPLICIT_LE, "Explicit VR Little Endian", True, True, False),
    (EXPLICIT_BE, "Explicit VR Big Endian", True, False, False),
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline (8-bit)", True, True, True),
    ("1.2.840.10008.1.2.4.51", "JPEG Extended (12-bit)", True, True, True),
    ("1.2.840.10008.1.2.4.57", "JPEG Lossless", True, True, True),
    ("1.2.840.10008.1.2.4.70", "JPEG Lossless", True, True, True),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000", True, True, True),
    ("1.2.840.10008.1.2.4.91", "JPEG 2000", True, True, True),
    (RLE, "RLE Lossless", True, True, True),
]
#: Photometric interpretations by their spelling in files.
PHOTOMETRIC = {"MONOCHROME1": "monochrome1", "MONOCHROME2": "monochrome2", "RGB": "rgb", "PALETTE COLOR": "paletteColor", "YBR_FULL": "ybrFull", "YBR_FULL_422": "ybrFull", "YBR_PARTIAL_422": "ybrFull"}


def tag_dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary as a table of 62 rows: tag, vr, keyword, name."""
    return spark.createDataFrame([(tag, *entry) for tag, entry in sorted(DICTIONARY.items())], "tag bigint, vr string, keyword string, name string")


def transfer_syntaxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNTAXES, "uid string, name string, is_explicit_vr boolean, is_little_endian boolean, is_encapsulated boolean")


def tag_of(group: Column, element: Column) -> Column:
    """The tag as one number, ordered as (group, element) is."""
    return group.cast("bigint") * 65536 + element


def tag_text(tag: Column) -> Column:
    """(GGGG,EEEE) in upper-case hexadecimal."""
    return F.format_string("(%04X,%04X)", F.shiftright(tag, 16), tag.bitwiseAND(F.lit(0xFFFF)))


def vr_of(tag: Column, found: Column) -> Column:
    """Dictionary VR, else UL for group lengths (element 0), else UN."""
    return F.coalesce(found, F.when(tag.bitwiseAND(F.lit(0xFFFF)) == 0, F.lit("UL")), F.lit("UN"))


def with_vr(elements: DataFrame, tag_col: str = "tag") -> DataFrame:
    """elements with dict_vr, keyword and name; the dictionary is 62 rows, so it is broadcast."""
    d = tag_dictionary(elements.sparkSession).select(F.col("tag").alias("_tag"), F.col("vr").alias("_vr"), "keyword", "name")
    joined = elements.join(F.broadcast(d), elements[tag_col] == d["_tag"], "left")
    return joined.withColumn("dict_vr", vr_of(F.col(tag_col), F.col("_vr"))).drop("_tag", "_vr")


def vr_code(text: Column) -> Column:
    """A known VR's code whatever its case, else UNKNOWN."""
    return F.when(F.upper(text).isin(VRS), F.upper(text)).otherwise(F.lit(UNKNOWN))


def has_long_header(code: Column) -> Column:
    return code.isin(LONG_VRS)


def clean_uid(uid: Column) -> Column:
    return F.replace(F.trim(uid), F.lit("\0"), F.lit(""))


def with_syntax(rows: DataFrame, uid_col: str) -> DataFrame:
    """rows with uid, syntax_name, is_explicit_vr, is_little_endian and is_encapsulated; unknown UIDs count as encapsulated explicit little endian."""
    s = transfer_syntaxes(rows.sparkSession).select(F.col("uid").alias("_uid"), F.col("name").alias("_name"), F.col("is_explicit_vr").alias("_e"), F.col("is_little_endian").alias("_l"), F.col("is_encapsulated").alias("_c"))
    out = rows.withColumn("uid", clean_uid(F.col(uid_col)))
    out = out.join(F.broadcast(s), F.col("uid") == F.col("_uid"), "left")
    named = F.coalesce("_name", F.concat(F.lit("Transfer Syntax "), "uid"))
    return out.select(*rows.columns, *([] if "uid" in rows.columns else ["uid"]), named.alias("syntax_name"), *(F.coalesce(c, F.lit(True)).alias(n) for c, n in (("_e", "is_explicit_vr"), ("_l", "is_little_endian"), ("_c", "is_encapsulated"))))


def syntax_name(uid: Column) -> Column:
    """The transfer syntax's name as an expression."""
    names = F.create_map(*[F.lit(x) for u, n, *_ in SYNTAXES for x in (u, n)])
    return F.coalesce(names[clean_uid(uid)], F.concat(F.lit("Transfer Syntax "), clean_uid(uid)))


def is_encapsulated(uid: Column) -> Column:
    return ~clean_uid(uid).isin([u for u, _, _, _, wrapped in SYNTAXES if not wrapped])


def photometric(text: Column) -> Column:
    """Photometric interpretation, `unsupported` where unknown."""
    names = F.create_map(*[F.lit(x) for kv in PHOTOMETRIC.items() for x in kv])
    return F.coalesce(names[F.upper(F.trim(text))], F.lit("unsupported"))


def is_inverted(kind: Column) -> Column:
    return kind == "monochrome1"


def is_monochrome(kind: Column) -> Column:
    return kind.isin("monochrome1", "monochrome2")
