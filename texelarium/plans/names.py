"""Names of formats as users write them: WebGPU and Vulkan spellings, block names, encoder prefixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats

# Block names with their aliases, and encoder prefixes.
BLOCK_NAMES = {
    "bc1": "BC1_RGBA_UNORM", "bc2": "BC2_UNORM", "bc3": "BC3_UNORM", "bc4": "BC4_UNORM", "bc4s": "BC4_SNORM", "bc5": "BC5_UNORM", "bc5s": "BC5_SNORM", "bc6h": "BC6H_UFLOAT", "bc6hsf": "BC6H_SFLOAT", "bc6h_sf": "BC6H_SFLOAT", "bc7": "BC7_UNORM",
    "etc1": "ETC2_R8G8B8_UNORM", "etc2_rgb": "ETC2_R8G8B8_UNORM", "etc2_rgba1": "ETC2_R8G8B8A1_UNORM", "etc2_rgb_a1": "ETC2_R8G8B8A1_UNORM", "etc2": "ETC2_R8G8B8A8_UNORM", "etc2_rgba": "ETC2_R8G8B8A8_UNORM",
    "eac_r": "EAC_R11_UNORM", "etc2_r": "EAC_R11_UNORM", "etc2_r11": "EAC_R11_UNORM", "eac_rg": "EAC_R11G11_UNORM", "etc2_rg": "EAC_R11G11_UNORM", "etc2_rg11": "EAC_R11G11_UNORM",
}
SHORT = {"BC1_RGBA_UNORM": "bc1", "BC1_RGB_UNORM": "bc1", "BC6H_UFLOAT": "bc6h", "BC6H_SFLOAT": "bc6hsf", "BC4_SNORM": "bc4s", "BC5_SNORM": "bc5s", "ETC2_R8G8B8_UNORM": "etc1", "ETC2_R8G8B8A1_UNORM": "etc2_rgba1", "ETC2_R8G8B8A8_UNORM": "etc2_rgba", "EAC_R11_UNORM": "eac_r", "EAC_R11G11_UNORM": "eac_rg"}
PREFIXES = ["bc7e", "bc7f", "intel", "etcpak", "amd", "astcenc"]
PACKED_NAMES = {"rg11b10ufloat": "B10G11R11_UFLOAT_PACK32", "rg11b10float": "B10G11R11_UFLOAT_PACK32", "rgb9e5ufloat": "E5B9G9R9_UFLOAT_PACK32", "rgb9e5float": "E5B9G9R9_UFLOAT_PACK32", "rgb10a2unorm": "A2B10G10R10_UNORM_PACK32", "rgb10a2uint": "A2B10G10R10_UINT_PACK32"}
# End of the fixed values.


class FormatNameError(ValueError):
    """A name that no format has."""


@dataclass(frozen=True)
class Target:
    """A format to convert to; ``encoder`` is None for uncompressed ones and ``auto`` without a prefix."""

    vk_format: str
    encoder: str | None = None


def _uncompressed() -> dict[str, str]:
    """All spellings of the plain formats of one, two or four channels, by rule."""
    out = dict(PACKED_NAMES)
    for name in formats.BY_NAME:
        kind = formats.classify(name)
        if kind is None or name.endswith("_SRGB"):
            continue
        low = name.lower()
        if "pack32" in low:
            out |= {low: name, low.removesuffix("_pack32"): name}
            continue
        if kind.channels == 3 or kind.kind.endswith("64") or name.startswith("B8"):
            continue
        stem, suffix = low.rsplit("_", 1)
        bits = 8 * formats.BY_NAME[name][4] // kind.channels
        for s in ("float", "sfloat") if suffix == "sfloat" else (suffix,):
            out |= {f"{stem}_{s}": name, f"{'rgba'[: kind.channels]}{bits}{s}": name}
    for s in ("unorm", "snorm", "uint", "sint"):
        out |= {f"bgra8{s}": f"B8G8R8A8_{s.upper()}", f"b8g8r8a8_{s}": f"B8G8R8A8_{s.upper()}"}
    return out


UNCOMPRESSED = _uncompressed()


def parse_compressed(name: str) -> str:
    low = name.lower()
    if low in BLOCK_NAMES:
        return BLOCK_NAMES[low]
    w, _, h = low.removeprefix("astc_").partition("x")
    found = formats.astc_format(int(w), int(h)) if low.startswith("astc_") and w.isdecimal() and h.isdecimal() else None
    if found is None:
        raise FormatNameError(f"no format is called {name!r}")
    return found


def encoder_for_prefix(name: str) -> tuple[str | None, str]:
    """(encoder, rest) of a name like ``intel_bc7``; longer prefixes are tried first."""
    for p in sorted(PREFIXES, key=len, reverse=True):
        if name.lower().startswith(p + "_"):
            return p, name[len(p) + 1 :]
    return None, name


def parse_format(name: str) -> Target:
    """Uncompressed names first, then an encoder's prefix, then bare block names."""
    low = name.lower()
    if low in UNCOMPRESSED:
        return Target(UNCOMPRESSED[low])
    encoder, rest = encoder_for_prefix(low)
    return Target(parse_compressed(rest), encoder or "auto")


def format_short_name(vk_format: str) -> str:
    base = formats.normalize(vk_format)[0]
    if base != vk_format:  # only the plain variants have short names
        return vk_format.lower()
    if base in SHORT:
        return SHORT[base]
    stem = base.removesuffix("_UNORM").lower()
    return stem if stem in BLOCK_NAMES else base.lower()


def parse_opts(text: str) -> dict[str, str]:
    """``k=v;k=v`` settings; blanks around keys and values go, a pair without a sign is an error."""
    out = {}
    for part in text.split(";"):
        if not part.strip():
            continue
        key, sign, value = part.partition("=")
        if not sign or not key.strip():
            raise ValueError(f"a setting is key=value, not {part!r}")
        out[key.strip()] = value.strip()
    return out


def parse_format_column(name: Column) -> Column:
    """The same for a column of names: a map of all spellings, so no Python runs a row. Unknown names give null."""
    every = UNCOMPRESSED | BLOCK_NAMES | {f"astc_{w}x{h}": f"ASTC_{w}x{h}_UNORM" for w, h in formats._ASTC}
    table = F.create_map(*[F.lit(x) for kv in every.items() for x in kv])
    bare = F.regexp_replace(F.lower(name), f"^({'|'.join(PREFIXES)})_", "")
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.try_element_at(table, bare))
