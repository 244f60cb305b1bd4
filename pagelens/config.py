"""What an extraction takes for granted, in one place."""

from __future__ import annotations

from dataclasses import dataclass


# Hosts, attribute names, patterns and sizes that results depend on.
@dataclass(frozen=True)
class ExtractConfig:
    carousel_hosts: tuple[str, ...] = ("instagram.com",)
    lazy_attributes: tuple[str, ...] = ("data-src", "data-original", "data-lazy-src", "data-lazy", "data-image", "data-url", "data-hi-res-src", "data-large-file")
    ui_asset: str = r"(?i)/rsrc\.php/|static\.cdninstagram\.com|/static\.xx\.fbcdn\.net/"
    post_path: str = r"(?i)(?:^|/)(?:p|reel|reels|tv)/([^/?#]+)"
    image_url: str = r"""(?i)https?://[^\s"'`<>{}\[\]]+?\.(?:jpe?g|png|gif|webp|heic|heif|bmp|svg|avif)(?:\?[^\s"'`<>{}\[\]]*)?"""
    css_url: str = r"""url\(["']?([^"')]+)["']?\)"""
    next_label: str = r"(?i)^(next|次へ|次の.{0,6})$"
    previous_label: str = r"(?i)^(prev|previous|back|前へ|戻る|前の.{0,6})$"
    # how many are looked at; None for all
    source_matches: int | None = 800
    styled_elements: int | None = 4000
    sprite_box: int = 60
    max_steps: int = 30
    budget_ms: int = 900
    size_tiers: tuple[int, ...] = (0, 300, 650)


DEFAULT = ExtractConfig()
#: Every match and every element, however many a page has.
WHOLE = ExtractConfig(source_matches=None, styled_elements=None)
