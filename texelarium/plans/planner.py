"""The conversion planner: rules on metadata alone, decided on the driver."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from . import formats

log = logging.getLogger(__name__)
ALPHA = ("straight", "premultiplied", "opaque")


class ConvertError(ValueError):
    """A conversion that the rules do not allow."""


@dataclass(frozen=True)
class Desc:
    vk_format: str
    srgb: bool
    alpha: str = "straight"

    def validate(self) -> None:
        if self.vk_format not in formats.BY_NAME:
            raise ConvertError(f"unknown format {self.vk_format}")
        if self.alpha not in ALPHA:
            raise ConvertError(f"unknown alpha mode {self.alpha}")
        if formats.with_color_space(self.vk_format, self.srgb) != self.vk_format:
            raise ConvertError(f"{self.vk_format} does not agree with its colour space")


@dataclass(frozen=True)
class Settings:
    vk_format: str | None = None
    encoder: str | None = None
    srgb: bool | None = None
    alpha: str | None = None
    allow_discarding_alpha: bool = False
    swizzle: str | None = None
    mipmap: bool = False
    mip_count: int | None = None
    alpha_cutoff: float | None = None
    mip_filter: str = "triangle"
    #: Settings of the encoder: bc7_alpha (auto, opaque, alpha), channel_weights, perceptual.
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Plan:
    steps: tuple[str, ...]
    lane: str = "f32"
    encoder: str | None = None
    target: Desc | None = field(default=None)
    #: What the store step writes: the target, or what the encoder reads.
    stored: str | None = None
    load_alpha: str = "opaque"
    store_alpha: str = "opaque"


#: The pixels that encoders of a block format read.
ENCODER_INPUT = {"BC4_UNORM": "R8_UNORM", "BC4_SNORM": "R8_SNORM", "BC5_UNORM": "R8G8_UNORM", "BC5_SNORM": "R8G8_SNORM", "BC6H_UFLOAT": "R16G16B16A16_SFLOAT", "BC6H_SFLOAT": "R16G16B16A16_SFLOAT", "EAC_R11_UNORM": "R8_UNORM", "EAC_R11G11_UNORM": "R8G8_UNORM"}


def required_input(vk_format: str) -> str:
    return ENCODER_INPUT.get(formats.normalize(vk_format)[0], "R8G8B8A8_UNORM")


def alpha_routes(keeps_alpha: bool, target: str, source: str) -> tuple[str, str]:
    """(alpha mode of the load, of the store); without a target alpha at most one of them touches colours."""
    if keeps_alpha:
        return source, target
    if target == "premultiplied":
        return ("straight" if source == "straight" else "opaque"), "opaque"
    return "opaque", ("straight" if source == "premultiplied" else "opaque")


def families_compatible(source: str, target: str) -> bool:
    """Integers and floats do not convert into each other; blocks need the float side."""
    kinds = [formats.classify(x) for x in (source, target)]
    return None not in kinds and len({k.family in ("uint", "sint") for k in kinds}) == 1


def effective_cutoff(settings: Settings, keeps_alpha: bool, source: str, target: str) -> float | None:
    """The alpha cutoff, or none where it does not apply; then its range does not matter."""
    cutoff = settings.alpha_cutoff
    if cutoff is None or not settings.mipmap or not keeps_alpha or "opaque" in (source, target):
        return None
    if not 0 < cutoff <= 1:
        raise ConvertError("an alpha cutoff lies in (0, 1]")
    return cutoff


def plan(source: Desc, settings: Settings, volume: bool = False) -> Plan:
    """The steps of a conversion in order; raises ConvertError where it is not allowed."""
    source.validate()
    srgb = source.srgb if settings.srgb is None else settings.srgb
    alpha = settings.alpha or source.alpha
    name = formats.with_color_space(settings.vk_format or source.vk_format, srgb)
    target = Desc(name, srgb, alpha)
    target.validate()
    encoder, stored = None, name
    if formats.BY_NAME[name][8] and name != source.vk_format:
        encoder = settings.encoder if settings.encoder not in (None, "auto") else formats.auto_encoder(name)
        if encoder is None or name not in formats.ENCODERS.get(encoder, ()):
            raise ConvertError(f"no encoder writes {name}" if encoder is None else f"{encoder} does not write {name}")
        stored = required_input(name)
    keeps = formats.has_alpha(name)
    if formats.has_alpha(source.vk_format) and not keeps and alpha == "straight" and not settings.allow_discarding_alpha:
        log.warning("alpha of %s is discarded by %s", source.vk_format, name)
    cutoff = effective_cutoff(settings, keeps, source.alpha, alpha)
    # identity: also an identity swizzle counts as work
    if source == target and settings.swizzle is None and not settings.mipmap:
        return Plan(("passthrough",), target=target, stored=name)
    if formats.BY_NAME[source.vk_format][8]:
        raise ConvertError("block-compressed input cannot be processed again")
    if volume:
        raise ConvertError("3D textures pass through only")
    lane = formats.lane_type(source.vk_format, stored)
    if not families_compatible(source.vk_format, stored):
        raise ConvertError("integer and float formats do not convert into each other")
    integer = lane.startswith("u")
    if integer and (settings.mipmap or srgb != source.srgb or alpha != source.alpha):
        raise ConvertError("integer formats take no mipmaps and no change of colour space or alpha")
    if lane == "f64" and (settings.mipmap or srgb or source.srgb):
        raise ConvertError("64-bit floats take no mipmaps and no sRGB")
    if settings.mipmap and settings.mip_count == 0:
        raise ConvertError("a mip chain has at least one level")
    load_alpha, store_alpha = ("opaque", "opaque") if integer else alpha_routes(keeps, alpha, source.alpha)
    steps = ["load"] + ["eotf"] * (source.srgb and not integer) + ["premultiply"] * (load_alpha == "straight")
    steps += ["swizzle"] * (settings.swizzle is not None)
    if settings.mipmap:
        steps += ["mips"] + ["coverage"] * (cutoff is not None)
    steps += ["unpremultiply"] * (store_alpha == "straight") + ["oetf"] * (srgb and not integer) + ["store"]
    steps += ["tile", "encode"] * (encoder is not None)
    return Plan(tuple(steps), lane, encoder, target, stored, load_alpha, store_alpha)
