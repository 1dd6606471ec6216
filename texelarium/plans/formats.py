"""The closed set of pixel and block formats, and the encoders' support, as dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Vulkan's numbers of the first format of each run, and the order of kinds in a run.
_RUNS = {("R8", 1, 1): 9, ("R8G8", 2, 2): 16, ("R8G8B8", 3, 3): 23, ("B8G8R8", 3, 3): 30, ("R8G8B8A8", 4, 4): 37, ("B8G8R8A8", 4, 4): 44}
_KINDS8 = ("UNORM", "SNORM", "USCALED", "SSCALED", "UINT", "SINT", "SRGB")
_WIDE = {16: (70, ("UNORM", "SNORM", "USCALED", "SSCALED", "UINT", "SINT", "SFLOAT")), 32: (98, ("UINT", "SINT", "SFLOAT")), 64: (110, ("UINT", "SINT", "SFLOAT"))}
_BLOCKS = [("BC1_RGB_UNORM", 8, 3), ("BC1_RGB_SRGB", 8, 3), ("BC1_RGBA_UNORM", 8, 4), ("BC1_RGBA_SRGB", 8, 4), ("BC2_UNORM", 16, 4), ("BC2_SRGB", 16, 4), ("BC3_UNORM", 16, 4), ("BC3_SRGB", 16, 4), ("BC4_UNORM", 8, 1), ("BC4_SNORM", 8, 1), ("BC5_UNORM", 16, 2), ("BC5_SNORM", 16, 2), ("BC6H_UFLOAT", 16, 3), ("BC6H_SFLOAT", 16, 3), ("BC7_UNORM", 16, 4), ("BC7_SRGB", 16, 4),
           ("ETC2_R8G8B8_UNORM", 8, 3), ("ETC2_R8G8B8_SRGB", 8, 3), ("ETC2_R8G8B8A1_UNORM", 8, 4), ("ETC2_R8G8B8A1_SRGB", 8, 4), ("ETC2_R8G8B8A8_UNORM", 16, 4), ("ETC2_R8G8B8A8_SRGB", 16, 4), ("EAC_R11_UNORM", 8, 1), ("EAC_R11_SNORM", 8, 1), ("EAC_R11G11_UNORM", 16, 2), ("EAC_R11G11_SNORM", 16, 2)]
_ASTC = [(4, 4), (5, 4), (5, 5), (6, 5), (6, 6), (8, 5), (8, 6), (8, 8), (10, 5), (10, 6), (10, 8), (10, 10), (12, 10), (12, 12)]
#: (name, number, channels, bytes)
_PACKED = [("B10G11R11_UFLOAT_PACK32", 122, 3, 4), ("E5B9G9R9_UFLOAT_PACK32", 123, 3, 4), ("R4G4_UNORM_PACK8", 1, 2, 1), ("R4G4B4A4_UNORM_PACK16", 2, 4, 2), ("B4G4R4A4_UNORM_PACK16", 3, 4, 2), ("R5G6B5_UNORM_PACK16", 4, 3, 2), ("B5G6R5_UNORM_PACK16", 5, 3, 2), ("R5G5B5A1_UNORM_PACK16", 6, 4, 2), ("B5G5R5A1_UNORM_PACK16", 7, 4, 2), ("A1R5G5B5_UNORM_PACK16", 8, 4, 2), ("A4R4G4B4_UNORM_PACK16", 1000340000, 4, 2), ("A4B4G4R4_UNORM_PACK16", 1000340001, 4, 2)]
_A2 = {"A2R10G10B10": 58, "A2B10G10R10": 64}
_DEPTH = [("D16_UNORM", 124, 1, 2), ("X8_D24_UNORM_PACK32", 125, 1, 4), ("D32_SFLOAT", 126, 1, 4), ("S8_UINT", 127, 1, 1), ("D16_UNORM_S8_UINT", 128, 2, 3), ("D24_UNORM_S8_UINT", 129, 2, 4), ("D32_SFLOAT_S8_UINT", 130, 2, 5)]
_ASTC_SFLOAT = 1000066000
#: Encoders in the order of preference, with the formats they write.
ENCODERS = {
    "bc7e": ["BC7_UNORM", "BC7_SRGB"],
    "bc7f": ["BC7_UNORM", "BC7_SRGB"],
    "intel": ["BC1_RGBA_UNORM", "BC1_RGBA_SRGB", "BC3_UNORM", "BC3_SRGB", "BC4_UNORM", "BC5_UNORM", "BC6H_UFLOAT", "BC7_UNORM", "BC7_SRGB", "ETC2_R8G8B8_UNORM", "ETC2_R8G8B8_SRGB"],
    "etcpak": ["ETC2_R8G8B8_UNORM", "ETC2_R8G8B8_SRGB", "ETC2_R8G8B8A8_UNORM", "ETC2_R8G8B8A8_SRGB", "EAC_R11_UNORM", "EAC_R11G11_UNORM", "BC1_RGBA_UNORM", "BC1_RGBA_SRGB", "BC3_UNORM", "BC3_SRGB", "BC4_UNORM", "BC5_UNORM"],
    "amd": ["BC1_RGBA_UNORM", "BC1_RGBA_SRGB", "BC2_UNORM", "BC2_SRGB", "BC3_UNORM", "BC3_SRGB", "BC4_UNORM", "BC4_SNORM", "BC5_UNORM", "BC5_SNORM", "BC6H_UFLOAT", "BC6H_SFLOAT", "BC7_UNORM", "BC7_SRGB"],
    "astcenc": [f"ASTC_{w}x{h}_{k}" for w, h in _ASTC for k in ("UNORM", "SRGB")],
}
# End of the fixed values.


def rows() -> list[tuple]:
    """(vk_format, vk_value, family, channels, bytes_per_pixel, block_w, block_h, bytes_per_block, compressed)."""
    out = []
    for (name, ch, size), first in _RUNS.items():
        out += [(f"{name}_{k}", first + i, k, ch, size, 1, 1, size, False) for i, k in enumerate(_KINDS8)]
    for bits, (first, kinds) in _WIDE.items():
        for ch in range(1, 5):
            name = "".join(f"{c}{bits}" for c in "RGBA"[:ch])
            size = ch * bits // 8
            out += [(f"{name}_{k}", first + (ch - 1) * len(kinds) + i, k, ch, size, 1, 1, size, False) for i, k in enumerate(kinds)]
    out += [(name, n, "UFLOAT" if "UFLOAT" in name else "UNORM", ch, size, 1, 1, size, False) for name, n, ch, size in _PACKED]
    out += [(f"{name}_{k}_PACK32", first + i, k, 4, 4, 1, 1, 4, False) for name, first in _A2.items() for i, k in enumerate(_KINDS8[:6])]
    out += [(name, n, "SFLOAT" if "SFLOAT" in name else "UINT" if name == "S8_UINT" else "UNORM", ch, size, 1, 1, size, False) for name, n, ch, size in _DEPTH]
    out += [(f"ASTC_{w}x{h}_SFLOAT", _ASTC_SFLOAT + i, "SFLOAT", 4, None, w, h, 16, True) for i, (w, h) in enumerate(_ASTC)]
    out += [(name, 131 + i, name.rsplit("_", 1)[1], ch, None, 4, 4, size, True) for i, (name, size, ch) in enumerate(_BLOCKS)]
    out += [(f"ASTC_{w}x{h}_{k}", 157 + 2 * i + j, k, 4, None, w, h, 16, True) for i, (w, h) in enumerate(_ASTC) for j, k in enumerate(("UNORM", "SRGB"))]
    return out


SCHEMA = "vk_format string, vk_value long, family string, channels int, bytes_per_pixel int, block_w int, block_h int, bytes_per_block int, compressed boolean"
BY_NAME = {r[0]: r for r in rows()}
BY_VALUE = {r[1]: r for r in rows()}


def formats(spark: SparkSession) -> DataFrame:
    """The dimension table: under 200 rows, so it may be broadcast."""
    return spark.createDataFrame(rows(), SCHEMA)


def encoders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, k + 1, f) for k, (e, fs) in enumerate(ENCODERS.items()) for f in fs], "encoder string, priority int, vk_format string")


def auto_encoder(vk_format: str) -> str | None:
    return next((e for e, fs in ENCODERS.items() if vk_format in fs), None)


def with_color_space(vk_format: str, srgb: bool) -> str:
    """The format's variant in a colour space; formats without a twin stay."""
    base = vk_format.removesuffix("_SRGB") + "_UNORM" if vk_format.endswith("_SRGB") else vk_format
    twin = base.removesuffix("_UNORM") + "_SRGB"
    return twin if srgb and base.endswith("_UNORM") and twin in BY_NAME else base


def normalize(vk_format: str) -> tuple[str, bool]:
    """(the format without its colour space, whether it was the sRGB variant)."""
    return with_color_space(vk_format, False), vk_format.endswith("_SRGB")


def has_alpha(vk_format: str) -> bool:
    return BY_NAME[vk_format][3] == 4


def channel_bytes(vk_format: str) -> int | None:
    """Bytes of a channel where all have as many; none for blocks, packed and depth formats."""
    _, _, _, channels, size, _, _, _, compressed = BY_NAME[vk_format]
    packed = "PACK" in vk_format or vk_format.startswith(("D16", "D24", "D32", "X8", "S8"))
    return None if compressed or packed else size // channels


@dataclass(frozen=True)
class Kind:
    """How pixels are stored: scalars of some bits, or a packed word; red first or blue first."""

    kind: str
    family: str
    channels: int


def classify(vk_format: str, srgb: bool = False) -> Kind | None:
    """None for what is not loaded as pixels: blocks, depth, 16-bit packed, scaled kinds."""
    if vk_format not in BY_NAME:
        return None
    base, _ = normalize(vk_format)
    _, _, family, channels, size, _, _, _, compressed = BY_NAME[base]
    if compressed or family in ("USCALED", "SSCALED") or base.startswith(("D16", "D32", "X8", "S8", "D24")):
        return None
    if base.endswith("_PACK32"):
        kind = base.removesuffix("_PACK32").lower()
        return Kind(kind, {"UFLOAT": "float"}.get(family, family.lower()), channels)
    if "PACK" in base:
        return None
    if base.startswith("B8"):
        if family != "UNORM":
            return None
        return Kind(("bgra8" if channels == 4 else "bgr8") + ("_srgb" if srgb else ""), "srgb" if srgb else "unorm", channels)
    letter = {"UNORM": "u", "UINT": "u", "SNORM": "i", "SINT": "i", "SFLOAT": "f"}[family]
    bits = size // channels * 8
    if srgb and family == "UNORM" and bits == 8:
        return Kind("srgb8", "srgb", channels)
    return Kind(f"{letter}{bits}", "float" if family == "SFLOAT" else family.lower(), channels)


def lane_type(source: str, target: str) -> str:
    """64-bit integers before 64-bit floats before other integers; 32-bit floats for the rest."""
    kinds = [k for k in (classify(source), classify(target)) if k]
    integer = any(k.family in ("uint", "sint") for k in kinds)
    wide = any(k.kind in ("u64", "i64", "f64") for k in kinds)
    return "u64" if wide and integer else "f64" if wide else "u32" if integer else "f32"


def astc_format(width: int, height: int) -> str | None:
    return f"ASTC_{width}x{height}_UNORM" if (width, height) in _ASTC else None
