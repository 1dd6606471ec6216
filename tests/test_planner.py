import pytest
from texelarium.plans import formats
from texelarium.plans.planner import ConvertError, Desc, Settings, plan

RGBA = Desc("R8G8B8A8_SRGB", True)


def test_passthrough_only_without_work():
    assert plan(RGBA, Settings()).steps == ("passthrough",)
    assert plan(RGBA, Settings(swizzle="rgba")).steps != ("passthrough",)


def test_order_of_steps():
    p = plan(RGBA, Settings(vk_format="BC7_UNORM", mipmap=True, swizzle="bgra", alpha_cutoff=0.5))
    assert p.steps == ("load", "eotf", "premultiply", "swizzle", "mips", "coverage", "unpremultiply", "oetf", "store", "tile", "encode")
    assert p.encoder == "bc7e" and p.target.vk_format == "BC7_SRGB"


@pytest.mark.parametrize("source,settings", [
    (Desc("BC7_SRGB", True), Settings(vk_format="R8G8B8A8_UNORM")),
    (Desc("R8_UINT", False), Settings(vk_format="R8_UNORM")),
    (Desc("R8_UINT", False), Settings(mipmap=True)),
    (Desc("R8G8B8A8_UNORM", True), Settings()),
    (RGBA, Settings(vk_format="ETC2_R8G8B8A1_UNORM")),
    (RGBA, Settings(vk_format="BC7_UNORM", encoder="etcpak")),
    (RGBA, Settings(mipmap=True, alpha_cutoff=1.5)),
    (Desc("R64G64_SFLOAT", False), Settings(mipmap=True)),
])
def test_refused(source, settings):
    with pytest.raises(ConvertError):
        plan(source, settings)


def test_formats():
    assert formats.with_color_space("BC1_RGBA_UNORM", True) == "BC1_RGBA_SRGB"
    assert formats.with_color_space("R16_UNORM", True) == "R16_UNORM"
    assert formats.BY_NAME["ASTC_12x12_SRGB"][1] == 184 and formats.BY_NAME["BC1_RGB_UNORM"][1] == 131
    assert formats.BY_NAME["R16G16B16A16_SFLOAT"][1] == 97 and formats.BY_NAME["R32G32B32A32_SFLOAT"][1] == 109
    assert len(formats.BY_VALUE) == len(formats.rows())
