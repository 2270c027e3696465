"""Switches of the extraction and rule jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from labelscope.functions import patterns as P


@dataclass(frozen=True)
class Options:
    confidence_gating: bool = True
    fuzzy_labels: bool = True
    origin_overrides_importer: bool = True
    unit_sale_price_applicable: bool | None = None
    dimensions_applicable: bool | None = False
    descriptors: tuple[str, ...] = field(default_factory=lambda: tuple(P.DESCRIPTORS))


DEFAULT = Options()
